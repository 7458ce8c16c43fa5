"""SimHash near-dedup over BK-trees.

Every text gets a 64-bit SimHash of its word shingles. Equal fingerprints are
one class. Distinct fingerprints are routed to tree shards: within radius r
two fingerprints agree on at least one of r + 1 bit blocks, so a shard holds
the fingerprints that agree on one block and no link is lost. A shard with
more fingerprints than one tree may hold is split into several trees; each of
its fingerprints is then broadcast to all trees of that shard. Every tree keys
children by their integer distance to the parent and a search follows only the
edges within the radius.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longwatch.llm.common import components, cut, lean, least_labels, read, texts

SHINGLE = 3
RADIUS = 2
#: Fingerprints in one tree; larger shards are split.
TREE = 4096
_BLOCK = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_PLANES = (np.arange(8, dtype=np.int32) * 256)[None, :]
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def word_blocks(data: bytes, overlap: int) -> Iterator[list[bytes]]:
    """Words of a text in blocks; each block starts with the last words of the one before."""
    at, kept = 0, []
    while at < len(data):
        end = at + _BLOCK
        if end < len(data):
            m = _SPACE.search(data, end)
            end = m.start() if m else len(data)
        words = kept + data[at:end].split()
        at = end
        yield words
        kept = words[max(0, len(words) - overlap):] if overlap else []


def shingle_hashes(text: str, k: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of k lower-cased words, repeats included."""
    data = text.encode("utf-8", "surrogatepass").lower()
    out, short = [], []
    digest = xxhash.xxh64_intdigest
    for words in word_blocks(data, k - 1):
        if len(words) < k:
            short = words
            continue
        rows = zip(*(words[i:] for i in range(k)), strict=False)
        out.append(np.array([digest(s, 42) for s in map(b" ".join, rows)], np.uint64))
    if out:
        return np.concatenate(out)
    return np.array([digest(b" ".join(short), 42)] if short else [], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; none: zero."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros((8, 256), np.int64)
    for i in range(0, n, _BLOCK):
        rows = hashes[i:i + _BLOCK].view(np.uint8).reshape(-1, 8) + _PLANES
        ones += np.bincount(rows.ravel(), minlength=2048).reshape(8, 256)
    counts = (ones @ _BITS).ravel()
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The given rows with a column fp (long, the fingerprint's 64 bits).

    Null and empty texts have fingerprint zero. All other columns pass through.
    """
    schema = docs.drop("fp").schema.add("fp", "long")
    at = docs.drop("fp").columns.index(text_col)

    def run(batches):
        for b in batches:
            fp = np.array([simhash(shingle_hashes(x, shingle)) for x in texts(b.column(at))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp)], names=[*b.schema.names, "fp"])

    return docs.drop("fp").mapInArrow(lean(run), schema)


class Forest:
    """BK-trees over 64-bit values, one tree for each group, built level by level."""

    def __init__(self, values: np.ndarray, group: np.ndarray):
        """group: ascending numbers from 0 without a gap; of equal values in a group only one is a node."""
        self.values, self.group, n = values, group, len(values)
        self.root = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
        slot = np.full(n, -1, np.int64)  # parent and distance
        at = self.root[group]
        open_ = np.flatnonzero(at != np.arange(n))
        while open_.size:
            d = np.bitwise_count(values[open_] ^ values[at[open_]]).astype(np.int64)
            open_, d = open_[d > 0], d[d > 0]
            slots, first, of = np.unique(at[open_] * 65 + d, return_index=True, return_inverse=True)
            node = open_[first]
            slot[node] = slots
            at[open_] = node[of]
            open_ = open_[at[open_] != open_]
        kids = np.flatnonzero(slot >= 0)
        self.order = kids[np.argsort(slot[kids], kind="stable")]
        self.begin = np.zeros(n * 65 + 1, np.int32)  # a node's children from each distance on, in order
        np.cumsum(np.bincount(slot[kids], minlength=n * 65), out=self.begin[1:])

    def search(self, queries: np.ndarray, group: np.ndarray, radius: int, most: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Yields (query index, node index) within the radius, at most so many pairs at a time.

        What is still to be visited waits as ranges of children on a stack, so
        that no more than that is held for each level of the trees.
        """
        for i in range(0, len(queries), most):
            q = np.arange(i, min(i + most, len(queries)))
            node, stack = self.root[group[q]], []
            while True:
                d = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
                hit = d <= radius
                if hit.any():
                    yield q[hit], node[hit]
                low = self.begin[node * 65 + np.maximum(d - radius, 0)]
                count = self.begin[node * 65 + np.minimum(d + radius, 64) + 1] - low
                more = np.flatnonzero(count)
                if more.size:
                    stack.append((q[more], low[more], count[more]))
                if not stack:
                    break
                q, low, count = stack.pop()
                upto = np.cumsum(count)
                if upto[-1] > most:
                    k = max(1, int(np.searchsorted(upto, most, "right")))
                    stack.append((q[k:], low[k:], count[k:]))
                    q, low, count, upto = q[:k], low[:k], count[:k], upto[:k]
                node = self.order[np.repeat(low - (upto - count), count) + np.arange(int(upto[-1]))]
                q = np.repeat(q, count)


def shard_links(values: np.ndarray, group: np.ndarray, in_tree: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each group, links that connect what lies within the radius of a tree member: at most one from each value."""
    n = len(values)
    members = np.flatnonzero(in_tree)
    codes, tree_group = np.unique(group[members], return_inverse=True)
    forest = Forest(values[members], tree_group)
    asks = np.isin(group, codes)
    rows = np.flatnonzero(asks)
    where = np.searchsorted(codes, group[rows])
    label = np.arange(n)
    for q, node in forest.search(values[rows], where, radius):
        a, b = rows[q], members[node]
        differ = a != b
        if differ.any():
            label = least_labels(n, a[differ], b[differ], label)
    moved = np.flatnonzero(label != np.arange(n))
    return values[moved], values[label[moved]]


def _search(radius: int):
    def run(batches):
        held: list[pa.RecordBatch] = []

        def done(table: pa.Table):
            shard, number = table["shard"].to_numpy(), table["tree"].to_numpy()
            group = np.cumsum(np.r_[False, (shard[1:] != shard[:-1]) | (number[1:] != number[:-1])])
            a, b = shard_links(table["fp"].to_numpy().view(np.uint64), group, table["member"].to_numpy(), radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for b in batches:
            held.append(b)
            table = pa.Table.from_batches(held)
            last = table.slice(table.num_rows - 1, 1)
            same = np.flatnonzero((table["shard"].to_numpy() != last["shard"][0].as_py()) | (table["tree"].to_numpy() != last["tree"][0].as_py()))
            cut_at = same[-1] + 1 if len(same) else 0
            if cut_at > 4096:
                yield done(table.slice(0, cut_at).combine_chunks())
                held = table.slice(cut_at).to_batches()
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            if table.num_rows:
                yield done(table)

    return run


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """Links (a, b) that connect distinct fingerprints (column fp) within the radius."""
    blocks = radius + 1
    edge = [round(64 * i / blocks) for i in range(blocks + 1)]
    keys = F.array(*[
        F.xxhash64(F.lit(i), F.shiftrightunsigned(F.shiftleft("fp", 64 - edge[i + 1]), 64 - edge[i + 1] + edge[i])) for i in range(blocks)
    ])
    routed = fps.select("fp", F.explode(keys).alias("shard"))
    sizes = routed.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1")
    held = routed.join(sizes, "shard").withColumn("trees", F.ceil(F.col("n") / tree).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int")
    spread = held.select("fp", "shard", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("tree"))
    rows = spread.select("shard", "tree", "fp", (F.col("own") == F.col("tree")).alias("member"))
    return rows.repartition("shard", "tree").sortWithinPartitions("shard", "tree").mapInArrow(lean(_search(radius)), "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Near-duplicate groups: (id_col, fp, component_id) for every row.

    component_id is the least id reachable over links of at most radius
    differing bits, the row itself included. Null and empty texts share
    fingerprint zero and link like any other. Repeated rows each keep a row;
    rows with a null id take the least id of their group, null if it has none.
    Other columns are ignored.
    """
    printed = cut(fingerprints(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_text", shingle).select("_id", "fp"))
    classes = printed.groupBy("fp").agg(F.min("_id").alias("least"))
    roots = components(fingerprint_links(classes.select("fp"), radius))
    labelled = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = labelled.join(ids, "root").select("fp", "component_id")
    return printed.join(by_fp, "fp").select(F.col("_id").alias(id_col), "fp", "component_id")


def op4_simhash_bk_trees(spark, sf_dir) -> DataFrame:
    """Fingerprint and component of every document."""
    rows = simhash_groups(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
