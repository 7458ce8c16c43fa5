"""Prefix trie of conversations by heavy-path decomposition.

Every turn gets a hash keyed by its content and depth; the exclusive or of
those up to a depth names the prefix, in 128 bits, without any text on the way.
Equal conversations become one with a weight before anything meets by prefix.
Each node's largest child (most members, then the least conversation) is on
its heavy path, so a path ends in a childless node and lies within the least
conversation that ends there: one window over that conversation's turns finds
it. What a path's subtree adds up to is attached to the parent of its top, in
one round for each number of light edges above it, of which there are at most
log2 of the distinct conversations; running sums from the bottom of each path
then give every node its subtree's sums.

No node's members come together in one task: they are counted before they are
shuffled, nodes with over a 1024th of all rows (at most 1024) are broadcast,
and the ids of conversations that end in a node are sorted by ranges and joined
to chunks before a digest reads them in order.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longwatch.llm.common import cut, lean, read

_SALT = "longwatch"
#: A node with this share of all rows or more is sent to every task; there can be no more of them than this.
_HOT = 1024
#: Characters of ids in a chunk.
_CHUNK = 1 << 20
#: Conversations of a family share up to this many less one first turns in the registered query, and their ids one multiple of FAMILY.
HEADS, FAMILY = 9, 5


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv, depth, key, bytes): turns from depth 1, key a digest of role and text, bytes those of the text.

    Turns go by turn, nulls first, then by role and by the digest. Null roles
    and texts are empty. Rows without a conv_id belong to no conversation and
    are left out. Other columns are ignored.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), key.alias("key"), F.octet_length(text).cast("long").alias("bytes"))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "key")
    return rows.select("conv", F.row_number().over(order).cast("long").alias("depth"), "key", "bytes")


def rooted(turns: DataFrame) -> DataFrame:
    """The turns with one row of depth 0 for each conversation."""
    top = F.struct(F.lit(0).cast("long").alias("depth"), F.lit(b"").alias("key"), F.lit(0).cast("long").alias("bytes"))
    own = F.struct("depth", "key", "bytes")
    return turns.select("conv", F.explode(F.when(F.col("depth") == 1, F.array(top, own)).otherwise(F.array(own))).alias("_")).select("conv", "_.*")


def rebuilt(turns: DataFrame) -> DataFrame:
    """Rooted turns with a conversation's first h turns replaced by those of conversation c - c % 5; h = crc32 of c in decimal, modulo 9."""
    heads = lambda c: F.crc32(c.cast("string").cast("binary")) % HEADS
    base = lambda c: c - c % FAMILY
    conv = F.col("conv")
    own = rooted(turns).select(conv, F.when(F.col("depth") == 0, 0).otherwise(2).alias("part"), "depth", "key", "bytes", ((F.col("depth") == 0) | (F.col("depth") > heads(conv))).alias("stays"))
    lent = turns.where((F.col("depth") < HEADS) & (conv == base(conv))).withColumn("to", F.explode(F.sequence(conv - FAMILY + 1, conv + FAMILY - 1)))
    lent = lent.where((base(F.col("to")) == conv) & (F.col("depth") <= heads(F.col("to")))).select(F.col("to").alias("conv"), F.lit(1).alias("part"), "depth", "key", "bytes", F.lit(True).alias("stays"))
    whole = Window.partitionBy("conv")
    upto = whole.orderBy("part", "depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = own.union(lent).select("conv", "key", "bytes", "stays", F.min("part").over(whole).alias("first"), (F.sum(F.col("stays").cast("long")).over(upto) - 1).alias("at"))
    return rows.where("stays AND first = 0").select("conv", F.col("at").alias("depth"), "key", "bytes")


def _named(rows: DataFrame) -> DataFrame:
    """Adds the prefix's name (a, b), its parent's (pa, pb) and whether the conversation ends there."""
    order = Window.partitionBy("conv").orderBy("depth")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    there = F.when(F.col("depth") > 0, F.xxhash64("key", "depth")).otherwise(0)
    also = F.when(F.col("depth") > 0, F.xxhash64(F.lit(_SALT), "key", "depth")).otherwise(0)
    rows = rows.select("conv", "depth", "bytes", there.alias("x"), also.alias("y"), F.bit_xor(there).over(upto).alias("a"), F.bit_xor(also).over(upto).alias("b"), F.lead("depth").over(order).isNull().alias("last"))
    return rows.select("conv", "depth", "bytes", "a", "b", F.col("a").bitwiseXOR(F.col("x")).alias("pa"), F.col("b").bitwiseXOR(F.col("y")).alias("pb"), "last")


def _ends(named: DataFrame) -> DataFrame:
    """(a, b, ends_sha256) of the prefixes that conversations end with."""

    def chunks(batches):
        now, first, held, size = None, 0, [], 0

        def done():
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((*now, first, ",".join(held)), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["a", "b", "first", "ids"])

        for batch in batches:
            for a, b, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (a, b) or size >= _CHUNK:
                    if held:
                        yield done()
                    now, first, held, size = (a, b), conv, [], 0
                held.append(str(conv))
                size += len(held[-1]) + 1
        if held:
            yield done()

    def digests(batches):
        now, state = None, None
        names, kinds = ["a", "b", "ends_sha256"], (pa.int64(), pa.int64(), pa.string())
        for batch in batches:
            out = []
            for a, b, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (a, b):
                    if now:
                        out.append((*now, state.hexdigest()))
                    now, state = (a, b), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip((*now, state.hexdigest()), kinds, strict=True)], names=names)

    ids = named.where("last").select("a", "b", "conv").repartitionByRange("a", "b", "conv").sortWithinPartitions("a", "b", "conv")
    texts = ids.mapInArrow(lean(chunks), "a long, b long, first long, ids string")
    return texts.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(lean(digests), "a long, b long, ends_sha256 string")


def _nodes(rows: DataFrame) -> DataFrame:
    """One row for each prefix: the least member, counts, and whether it is the largest child of its parent."""
    nodes = cut(
        rows.groupBy("a", "b").agg(
            F.min("conv").alias("node"), F.sum("weight").alias("n_convs"), F.count("*").alias("rows"), F.first("pa").alias("pa"), F.first("pb").alias("pb"), F.min("depth").alias("at"),
        )
    )
    size = F.struct(F.col("n_convs"), -F.col("node"))
    chosen = cut(nodes.where("at > 0").groupBy(F.col("pa").alias("qa"), F.col("pb").alias("qb")).agg(F.count("*").alias("n_children"), F.max_by(F.struct("a", "b"), size).alias("big")))
    of = chosen.select(F.col("qa").alias("a"), F.col("qb").alias("b"), "n_children")
    big = chosen.select(F.col("big.a").alias("a"), F.col("big.b").alias("b"), F.lit(1).alias("heavy"))
    return nodes.join(of, ["a", "b"], "left").join(big, ["a", "b"], "left").select("a", "b", "node", "n_convs", "rows", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.coalesce("heavy", F.lit(0)).alias("heavy"))


def _meet(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each row with its node. Nodes of a 1024th of all rows or more, at most 1024, are broadcast, so no key of the shuffled join is hot."""
    share = max(rows.count() // _HOT, 1)
    hot, rest = nodes.where(F.col("rows") > share).drop("rows"), nodes.where(F.col("rows") <= share).drop("rows")
    hot = F.broadcast(hot)
    return rows.join(hot, ["a", "b"]).unionByName(rows.join(hot.select("a", "b"), ["a", "b"], "left_anti").join(rest, ["a", "b"]))


def _paths(rows: DataFrame) -> DataFrame:
    """Each node once, on its heavy path: the path is named by the least conversation that ends where it does."""
    whole = Window.partitionBy("conv")
    deeper = whole.orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(
        "*", F.lag("node").over(whole.orderBy("depth")).alias("parent"), F.min("heavy").over(deeper).alias("below"),
        F.sum(F.when((F.col("depth") > 0) & (F.col("heavy") == 0), 1).otherwise(0)).over(whole).alias("level"),
        F.max(F.col("last") & (F.col("n_children") == 0)).over(whole).alias("leads"),
    )
    rows = rows.where(F.col("leads") & (F.coalesce("below", F.lit(1)) == 1))
    return rows.select(
        F.col("conv").alias("path"), "depth", "node", "parent", "a", "b", "n_convs", "n_children", "level",
        (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"),
    )


def _attached(paths: DataFrame) -> DataFrame:
    """(node, depth, leaves, saved): sums of the light subtrees that hang on a node, from the innermost level outwards."""
    own = cut(paths.groupBy("path").agg(F.max("level").alias("level"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.min_by("parent", "depth").alias("parent"), F.min("depth").alias("top")))
    levels = own.agg(F.max("level")).first()[0] or 0
    found, inner = None, None
    for level in range(levels, 0, -1):
        here = own.where(F.col("level") == level)
        if inner is not None:
            added = inner.join(paths.where(F.col("level") == level).select("path", "node", "depth"), ["node", "depth"]).groupBy("path").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
            here = here.join(added, "path", "left").withColumns({"leaves": F.col("leaves") + F.coalesce("l", F.lit(0)), "saved": F.col("saved") + F.coalesce("s", F.lit(0))})
        inner = cut(here.groupBy(F.col("parent").alias("node"), (F.col("top") - 1).alias("depth")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))
        found = inner if found is None else found.union(inner)
    return paths.sparkSession.createDataFrame([], "node long, depth long, leaves long, saved long") if found is None else found


def trie(rows: DataFrame) -> DataFrame:
    """The trie of rooted turns: a row for each distinct prefix, by its least conversation and its depth.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256); saved_tokens sums over the subtree, itself
    included, what all members but one need not store of the node's last turn,
    in UTF-8 bytes. The root has depth 0 and no parent. Without a conversation
    there is no node.
    """
    named = cut(_named(rows))
    ends = named.where("last").groupBy("a", "b").agg(F.min("conv").alias("conv"), F.count("*").alias("weight")).select("conv", "weight")
    distinct = cut(named.join(ends, "conv"))
    paths = cut(_paths(_meet(distinct, cut(_nodes(distinct)))))
    light = _attached(paths).select("node", "depth", F.col("leaves").alias("l"), F.col("saved").alias("s"))
    upto = Window.partitionBy("path").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    sums = lambda own, more: F.sum(F.col(own) + F.coalesce(more, F.lit(0))).over(upto)
    nodes = paths.join(light, ["node", "depth"], "left").select("*", sums("leaves", "l").alias("n_leaves"), sums("saved", "s").alias("saved_tokens"))
    none = F.lit(hashlib.sha256().hexdigest())
    return nodes.join(_ends(named), ["a", "b"], "left").select(
        F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256")
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations as they are; see turn_rows for nulls and ties, trie for the columns."""
    return trie(rooted(turn_rows(conversations)))


def op13_heavy_path_trie(spark, sf_dir) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return trie(rebuilt(cut(turn_rows(read(spark, sf_dir, "conversations")))))


OP13_SQL = r"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn ASC NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS nth
  FROM conversations WHERE conv_id IS NOT NULL
), crc AS (
  SELECT c, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, x: list_reduce(list_prepend(xor(a, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v // 2, (v % 2) * 3988292384))
  ), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT c FROM t)
), r AS (
  SELECT crc.c, 0 AS part, t.nth, t.role, t.text FROM crc JOIN t ON t.c = crc.c - crc.c % 5 AND t.nth <= crc.h
  UNION ALL
  SELECT crc.c, 1, t.nth, t.role, t.text FROM crc JOIN t ON t.c = crc.c AND t.nth > crc.h
), d AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, nth) AS depth, role, text FROM r
), p AS (
  SELECT c, depth, strlen(text) AS bytes,
         string_agg(sha256(strlen(role)::VARCHAR || ':' || role || text), '') OVER (PARTITION BY c ORDER BY depth) AS key
  FROM d
  UNION ALL SELECT c, 0, 0, '' FROM crc
), n AS (
  SELECT key, min(c) AS c, depth, count(*) AS n_convs, min(bytes) AS bytes, left(key, length(key) - 64) AS above FROM p GROUP BY key, depth
), e AS (
  SELECT key, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends FROM (SELECT c, arg_max(key, depth) AS key FROM p GROUP BY c) GROUP BY key
), k AS (
  SELECT above AS key, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY above
), s AS (
  SELECT p.key, count(*) FILTER (WHERE k.key IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.bytes)::BIGINT AS saved
  FROM n JOIN p ON p.c = n.c AND p.depth <= n.depth LEFT JOIN k ON k.key = n.key GROUP BY p.key
)
SELECT n.c AS conv_id, n.depth, up.c AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children,
       s.n_leaves, s.saved AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM n LEFT JOIN n up ON n.depth > 0 AND up.key = n.above LEFT JOIN k ON k.key = n.key JOIN s ON s.key = n.key LEFT JOIN e ON e.key = n.key
"""
