"""Near-duplicate texts by SimHash and BK-trees, at a word-shingle similarity.

At a Jaccard similarity of 0.8 two SimHashes differ in some ten of their 64
bits, too many for shards by equal bit blocks. Here a tree shard holds the
documents that share the least shingle hash of one of a few hash ranges; two
documents at the threshold share none with a chance of about 0.2 ** 6. First
each document is checked exactly against one other that shares three of those
hashes, which links most copies. What these links leave apart is searched: the
shard's documents are dealt into blocks, each block is a BK-tree that the
shard's other blocks are searched against, and only edges within a wide radius
are followed. A small signature drops most pairs found; the documents of the
others meet again with their shingles, and every such pair between two
components is checked exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longwatch.llm.common import components, cut, lean, texts
from longwatch.llm.simhash import TREE, Forest, shingle_hashes, simhash

SHINGLE = 5
SIMILARITY = 0.8
#: Bits by which two texts at the similarity differ but for a chance of some 1 in 300,000, small sets of shingles included.
RADIUS = 26
#: Deviations of its estimate by which a pair that is not checked exactly is below the threshold.
SLACK = 4.5
#: Documents that are checked against the same one at first.
_STAR = 1024
_RANGES = 6
_BINS = 128
_SHIFT = 64 - _BINS.bit_length() + 1
_EMPTY = 0xFF


def _sketch(text: str, shingle: int) -> tuple[int, bytes, list[int | None], bytes | None]:
    """(SimHash, signature, least shingle hash of each range or None, digest) of the set of a text's shingles."""
    u = np.unique(shingle_hashes(text, shingle))
    at = np.searchsorted(u, np.arange(_BINS, dtype=np.uint64) << np.uint64(_SHIFT))
    there = np.append(u, np.uint64(0))[at]
    full = (at < len(u)) & ((there >> np.uint64(_SHIFT)) == np.arange(_BINS))
    sign = np.where(full, there % np.uint64(_EMPTY), _EMPTY).astype(np.uint8)
    range_of = (u >> np.uint64(8)) % np.uint64(_RANGES)
    keys = [int(x.min().view(np.int64)) if len(x := u[range_of == k]) else None for k in range(_RANGES)]
    return simhash(u), sign.tobytes(), keys, xxhash.xxh3_128_digest(u.tobytes()) if len(u) else None


def _sketches(shingle: int):
    def run(batches):
        for b in batches:
            made = [_sketch(x, shingle) for x in texts(b.column(1))]
            fp, sign, keys, same = zip(*made, strict=True) if made else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(sign, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(same, pa.binary())],
                names=["id", "fp", "sign", "keys", "same"],
            )

    return run


def likeness(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated Jaccard similarity of rows of signatures, and the bins that it rests on."""
    either = ((a != _EMPTY) | (b != _EMPTY)).sum(1)
    return ((a == b) & (a != _EMPTY)).sum(1) / np.maximum(either, 1), either


def floor(similarity: float, bins: np.ndarray) -> np.ndarray:
    """The estimate from so many bins that a pair with the similarity reaches but for a chance of some 1 in 300,000."""
    return similarity - SLACK * np.sqrt(similarity * (1 - similarity) / np.maximum(bins, 1))


_ASKED = "shard long, low int, high int, block int, id long, root long, fp long, sign binary, keys array<bigint>, same binary"


def _whole_groups(batches, names=("shard", "low", "high")) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, and each row's group number, from rows that are sorted by the names."""
    held: list[pa.RecordBatch] = []

    def numbered(t: pa.Table):
        change = np.zeros(t.num_rows, bool)
        for k in names:
            x = t[k].to_numpy()
            change[1:] |= x[1:] != x[:-1]
        return t, np.cumsum(change)

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        t = pa.Table.from_batches(held)
        other = np.zeros(t.num_rows, bool)
        for k in names:
            x = t[k].to_numpy()
            other |= x != x[-1]
        other = np.flatnonzero(other)
        if len(other) and other[-1] >= TREE:
            yield numbered(t.slice(0, other[-1] + 1))
            held = t.slice(other[-1] + 1).to_batches()
    if held:
        yield numbered(pa.Table.from_batches(held))


def _likely(t: pa.Table, group: np.ndarray, radius: int, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of different components within the radius whose estimate reaches the similarity's floor, each pair in one shard only."""
    low, high, block, shard = (t[c].to_numpy() for c in ("low", "high", "block", "shard"))
    root, fp = t["root"].to_numpy(), t["fp"].to_numpy().view(np.uint64)
    sign = np.frombuffer(b"".join(t["sign"].to_pylist()), np.uint8).reshape(-1, _BINS)
    given = pa.concat_arrays(x.flatten() for x in t["keys"].chunks)
    keys, full = (np.reshape(x.to_numpy(zero_copy_only=False), (-1, _RANGES)) for x in (given.fill_null(0), given.is_valid()))
    members = np.flatnonzero(block == low)
    codes, tree_group = np.unique(group[members], return_inverse=True)
    rows = np.flatnonzero((block == high) & np.isin(group, codes))
    forest = Forest(fp[members], tree_group)
    # equal fingerprints are one node, and one search serves all rows that have them
    nodes = _Classes(tree_group, fp[members])
    asks = _Classes(np.searchsorted(codes, group[rows]), fp[rows])
    for q, node in forest.search(fp[rows][asks.first], np.searchsorted(codes, group[rows][asks.first]), radius):
        for a, b in _expanded(asks, nodes, q, nodes.of[node]):
            a, b = rows[a], members[b]
            ok = (root[a] != root[b]) & ((low[a] != high[a]) | (a < b))
            a, b = a[ok], b[ok]
            alike = (keys[a] == keys[b]) & full[a] & full[b]
            ok = keys[a, alike.argmax(1)] == shard[a]
            a, b = a[ok], b[ok]
            w, bins = likeness(sign[a], sign[b])
            good = w >= floor(similarity, bins)
            yield a[good], b[good]


class _Classes:
    """Rows of equal group and value: of gives each row's class, and rows() those of a class."""

    def __init__(self, group: np.ndarray, values: np.ndarray):
        self.order = np.lexsort((np.arange(len(values)), values, group))
        g, v = group[self.order], values[self.order]
        new = np.r_[True, (g[1:] != g[:-1]) | (v[1:] != v[:-1])] if len(v) else np.zeros(0, bool)
        self.begin = np.flatnonzero(new)
        self.size = np.diff(np.r_[self.begin, len(v)])
        self.first = self.order[self.begin]
        self.of = np.empty(len(v), np.int64)
        self.of[self.order] = np.cumsum(new) - 1


def _expanded(asks: _Classes, nodes: _Classes, q: np.ndarray, node: np.ndarray, most: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of the classes q[i] and node[i], so many at a time."""
    wide = asks.size[q]
    q, node, nth = np.repeat(q, wide), np.repeat(node, wide), _within(wide)
    a = asks.order[asks.begin[q] + nth]
    count = nodes.size[node]
    upto = np.cumsum(count)
    at = 0
    while at < len(a):
        k = max(at + 1, int(np.searchsorted(upto, most + (int(upto[at - 1]) if at else 0), "right")))
        n = count[at:k]
        yield np.repeat(a[at:k], n), nodes.order[np.repeat(nodes.begin[node[at:k]], n) + _within(n)]
        at = k


def _within(size: np.ndarray) -> np.ndarray:
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


def _mark(radius: int, similarity: float):
    """The rows that have a likely pair."""

    def run(batches):
        for t, group in _whole_groups(batches):
            there = np.zeros(t.num_rows, bool)
            for a, b in _likely(t, group, radius, similarity):
                there[a] = there[b] = True
            yield from t.filter(pa.array(there)).to_batches()

    return run


def _decide(radius: int, similarity: float):
    """Links (a, b) of rows that also have their shingles: all that join two components."""

    def run(batches):
        for t, group in _whole_groups(batches):
            ids, sets = t["id"].to_numpy(), [np.frombuffer(x, np.uint32) for x in t["set"].to_pylist()]
            size = np.array(list(map(len, sets)))
            _, label = np.unique(np.stack([group, t["root"].to_numpy()]), axis=1, return_inverse=True)
            out: list[tuple[int, int]] = []
            for a, b in _likely(t, group, radius, similarity):
                near = np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b])
                a, b = a[near], b[near]
                order = np.argsort(a, kind="stable")
                for rows in np.split(order, np.flatnonzero(np.diff(a[order])) + 1):
                    if len(rows):
                        _join(int(a[rows[0]]), b[rows], sets, size, label, similarity, out)
            yield _pairs([(ids[a], ids[b]) for a, b in out])

    return run


def _join(a: int, to: np.ndarray, sets: list[np.ndarray], size: np.ndarray, label: np.ndarray, similarity: float, out: list[tuple[int, int]]):
    """Checks a row against others that are not in its component yet; label is brought up to date."""
    for at in range(0, len(to), 256):
        part = to[at:at + 256]
        part = part[label[part] != label[a]]
        if not len(part):
            continue
        every, own = np.concatenate([sets[b] for b in part]), sets[a]
        there = own[np.minimum(np.searchsorted(own, every), len(own) - 1)] == every
        common = np.add.reduceat(there.astype(np.int64), np.cumsum(size[part]) - size[part])
        for b in part[common >= similarity * (size[a] + size[part] - common)].tolist():
            if label[a] != label[b]:
                label[label == label[b]] = label[a]
                out.append((a, b))


def _sets(shingle: int):
    def run(batches):
        for b in batches:
            rows = [shingle_hashes(x, shingle) for x in texts(b.column(1))]
            same = [xxhash.xxh3_128_digest(np.unique(h).tobytes()) for h in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(same, pa.binary()), pa.array([_set(h).tobytes() for h in rows], pa.binary())], names=["id", "same", "set"])

    return run


def _set(hashes: np.ndarray) -> np.ndarray:
    return np.unique((hashes >> np.uint64(16)).astype(np.uint32))


def _verify(shingle: int, similarity: float):
    def shingles(batches):
        for b in batches:
            rows = [[], [], [], []]
            for i, text, ends in zip(b.column(0).to_pylist(), texts(b.column(1)), b.column(2).to_pylist(), strict=True):
                h = _set(shingle_hashes(text, shingle)).tobytes()
                for e in ends:
                    for column, x in zip(rows, (e["a"], e["b"], i == e["a"], h), strict=True):
                        column.append(x)
                if len(rows[0]) >= 256:
                    yield _sides(rows)
                    rows = [[], [], [], []]
            yield _sides(rows)

    def alike(sets: tuple[list, list]) -> bool:
        for x in sets[0]:
            for y in sets[1]:
                common = len(np.intersect1d(x, y, assume_unique=True))
                if common and common >= similarity * (len(x) + len(y) - common):
                    return True
        return False

    def compare(batches):
        pair, sets = None, ([], [])
        for b in batches:
            out = []
            for a, c, side, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                if pair != (a, c):
                    if alike(sets):
                        out.append(pair)
                    pair, sets = (a, c), ([], [])
                sets[side].append(np.frombuffer(x.as_py(), np.uint32))
            yield _pairs(out)
        yield _pairs([pair] if alike(sets) else [])

    return shingles, compare


def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _sides(rows: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names=["a", "b", "side", "set"])


def _exact(lone: DataFrame, likely: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) of which some texts have the exact similarity."""
    ends = likely.select(F.col("a").alias("id"), "a", "b").union(likely.select(F.col("b").alias("id"), "a", "b"))
    ends = ends.groupBy("id").agg(F.collect_list(F.struct("a", "b")).alias("ends"))
    shingles, compare = _verify(shingle, similarity)
    sets = lone.join(ends.hint("shuffle_hash"), "id").select("id", "text", "ends").mapInArrow(lean(shingles), "a long, b long, side boolean, set binary")
    return sets.repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(lean(compare), "a long, b long")


def _first_pairs(sketches: DataFrame) -> DataFrame:
    """(a, b): each document with the least of those that share its first or last three range hashes; hot groups have one for each part."""
    three = lambda at: F.when(F.exists(F.slice("keys", at, 3), lambda k: k.isNotNull()), F.xxhash64(F.lit(at), F.slice("keys", at, 3)))
    one = sketches.select("id", F.explode(F.array(three(1), three(4))).alias("key")).where("key IS NOT NULL")
    sizes = one.groupBy("key").agg(F.ceil(F.count("*") / _STAR).cast("int").alias("parts"), F.min("id").alias("first")).where("parts > 1")
    parted = one.join(sizes, "key", "left").select("id", "key", "first", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).alias("part"))
    least = parted.groupBy("key", "part").agg(F.min("id").alias("b"), F.first("first").alias("first"))
    pairs = parted.select("id", "key", "part").join(least.select("key", "part", "b"), ["key", "part"]).select(F.col("id").alias("a"), "b")
    return pairs.union(least.where("first IS NOT NULL").select(F.col("b").alias("a"), F.col("first").alias("b"))).where("a != b").distinct()


def _blocks(sketches: DataFrame, roots: DataFrame, tree: int) -> DataFrame:
    """The rows of _ASKED: each shard's documents in blocks, once for each pair of blocks that may hold two components.

    The documents of a shard's largest component meet all others but not each other.
    """
    placed = sketches.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    one = placed.select("id", "root", "same", F.explode("keys").alias("shard")).where("shard IS NOT NULL")
    per_root = one.groupBy("shard", "root").agg(F.count("*").alias("n"))
    shards = per_root.groupBy("shard").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1")
    routed = one.select("id", "same", "root", "shard").join(shards.drop("roots"), "shard")
    apart = F.col("n") > tree
    rest = F.when(apart, F.ceil((F.col("n") - F.col("most")) / tree)).otherwise(1).cast("int")
    mains = F.when(apart, F.ceil(F.col("most") / tree)).otherwise(0).cast("int")
    routed = routed.withColumns({"rest": rest, "mains": mains}).withColumn("in_main", (F.col("root") == F.col("main")) & (F.col("mains") > 0))
    block = F.when(F.col("in_main"), F.col("rest") + F.pmod(F.xxhash64("id"), F.col("mains"))).otherwise(F.pmod(F.xxhash64("id"), F.col("rest"))).cast("int")
    routed = routed.withColumn("block", block)
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    others = F.when(F.col("in_main"), upto(F.col("rest"))).otherwise(upto(F.col("rest") + F.col("mains")))
    routed = routed.select("shard", "id", "same", "block", F.explode(others).alias("other"))
    routed = routed.select("shard", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id", "same")
    return routed.join(placed.select("id", "same", "root", "fp", "sign", "keys"), ["id", "same"]).select([c.split()[0] for c in _ASKED.split(", ")])


def near_text_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """(id, component_id) for each distinct non-null id that shares a group with a lesser id.

    Groups are the components of links between texts whose sets of word
    shingles (lower-cased A-Z, so many words; fewer words are one shingle) have
    the Jaccard similarity, and between equal texts. Texts without words link
    only with equal ones; a null text equals an empty one. component_id is the
    least id of the group. Rows with a null id take no part. Of rows that share
    an id, all texts count as that document's.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    summed = cut(rows.select("id", F.sha2("text", 256).alias("sum")).distinct())
    least = summed.groupBy("sum").agg(F.min("id").alias("least"))
    copies = summed.join(least, "sum").where("least < id").select(F.col("id").alias("a"), F.col("least").alias("b"))
    first = summed.join(least, "sum").where("least = id").select("id").distinct()
    lone = rows.join(first.hint("shuffle_hash"), "id")
    sketches = cut(lone.mapInArrow(lean(_sketches(shingle)), "id long, fp long, sign binary, keys array<bigint>, same binary").where("same is not null").distinct())
    least = sketches.groupBy("same").agg(F.min("id").alias("least"))
    copies = copies.union(sketches.join(least, "same").where("least < id").select(F.col("id").alias("a"), F.col("least").alias("b")))
    sketches = sketches.join(least, "same").where("least = id").drop("least")
    roots = components(_exact(lone, _first_pairs(sketches), shingle, similarity).union(copies))
    keys = ["shard", "low", "high"]
    asked = _blocks(sketches, roots, tree).repartition(*keys).sortWithinPartitions(*keys)
    marked = cut(asked.mapInArrow(lean(_mark(radius, similarity)), _ASKED))
    wanted = marked.select("id").distinct()
    sets = lone.join(wanted.hint("shuffle_hash"), "id").select("id", "text").mapInArrow(lean(_sets(shingle)), "id long, same binary, set binary").distinct()
    ready = marked.join(sets, ["id", "same"]).repartition(*keys).sortWithinPartitions(*keys)
    found = ready.mapInArrow(lean(_decide(radius, similarity)), "a long, b long")
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(found)).where("node != root").select(F.col("node").alias(id_col), F.col("root").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of the least id of each group of near-duplicate texts; repeated rows of an id are one. Rows with a null id stay."""
    later = near_text_groups(docs, id_col, text_col, **options).select(id_col)
    kept = docs.join(later.hint("shuffle_hash"), id_col, "left_anti")
    twice = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").limit(1).count()
    if not twice:
        return kept
    named = kept.where(F.col(id_col).isNotNull()).dropDuplicates([id_col])
    return named.unionByName(kept.where(F.col(id_col).isNull()))
