"""Embedding near-dedup by NN-descent.

A neighbour graph starts from exact neighbours inside random sign buckets and
is refined by joins of neighbours of neighbours: each vector compares its
neighbours and those that have it as neighbour with one another. A list that is
full of links is saturated, so each vector has a second list of the nearest
vectors outside its component: a link in it joins two components, and then
makes room. Rounds go on, with new buckets each, until none joins components
and a sampled audit against brute force, averaged over vectors, passes; if none
does, all vectors are compared block by block. The pairs of a component are
compared exactly in blocks, so every link in it is counted without being sent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from longwatch.llm.common import components, cut, lean, read

THRESHOLD = 0.9
LIST = 8
ROUNDS = 4
#: Vectors of the audit, and the share of their links that must be in their components.
AUDIT = 256
RECALL = 0.99
_TABLES = 3
_BUCKET = 512
_BLOCK = 1024
_SEED = 5


def spanning(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Indices of a spanning forest of heaviest links."""
    parent = list(range(n))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    kept = []
    for k in np.argsort(-weight, kind="stable").tolist():
        x, y = top(int(a[k])), top(int(b[k]))
        if x != y:
            parent[x] = y
            kept.append(k)
    return np.array(kept, np.int64)


def _unit(column: pa.Array) -> np.ndarray:
    """Rows of float32 bytes as unit vectors in double precision."""
    x = np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), -1).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _usable(batches):
    """(id, dim, vec): vec as float32 bytes, null where the vector links with nothing."""
    for b in batches:
        dims, out = [], []
        for v in b.column(1).to_pylist():
            ok = bool(v) and None not in v
            x = np.array(v, np.float32) if ok else np.zeros(0, np.float32)
            ok = ok and bool(np.isfinite(x).all()) and bool(x.any())
            dims.append(len(x) if ok else 0)
            out.append((x + np.float32(0)).tobytes() if ok else None)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], names=["id", "dim", "vec"])


def _groups(batches, *keys):
    """Tables of whole groups of rows that are sorted by the keys, with each row's group number; small groups come together."""
    held: list[pa.RecordBatch] = []

    def numbered(t: pa.Table):
        change = np.zeros(t.num_rows, bool)
        for k in keys:
            x = t[k].to_numpy()
            change[1:] |= x[1:] != x[:-1]
        return t.combine_chunks(), np.cumsum(change)

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        t = pa.Table.from_batches(held)
        last = np.zeros(t.num_rows, bool)
        for k in keys:
            x = t[k].to_numpy()
            last |= x != x[-1]
        whole = np.flatnonzero(last)
        if len(whole) and whole[-1] >= 2000:
            yield numbered(t.slice(0, whole[-1] + 1))
            held = t.slice(whole[-1] + 1).to_batches()
    if held:
        yield numbered(pa.Table.from_batches(held))


def _pairs(a, b, s) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(a), pa.int64()), pa.array(np.asarray(b), pa.int64()), pa.array(np.asarray(s), pa.float64())], names=["u", "v", "sim"])


def _none() -> pa.RecordBatch:
    return _pairs(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _start(size: int):
    """Exact nearest vectors inside each bucket, in blocks of bounded size."""

    def run(batches):
        for t, group in _groups(batches, "bucket"):
            ids = t["id"].to_numpy()
            begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            for i, j in zip(begin, [*begin[1:], len(ids)], strict=True):
                for at in range(i, j, _BLOCK):
                    part = slice(at, min(at + _BLOCK, j))
                    x = _unit(t["vec"].slice(part.start, part.stop - part.start))
                    if len(x) < 2:
                        continue
                    s = x @ x.T
                    np.fill_diagonal(s, -2)
                    k = min(size, len(x) - 1)
                    own, root = ids[part], t["root"].to_numpy()[part]
                    for side in (s, np.where(root[:, None] != root[None, :], s, -2)):
                        near = np.argpartition(-side, k - 1, axis=1)[:, :k]
                        sim = np.take_along_axis(side, near, 1).ravel()
                        good = sim > -1.5
                        yield _pairs(np.repeat(own, k)[good], own[near].ravel()[good], sim[good])
        yield _none()

    return run


def _refine(batches):
    """Pairs of the members of each centre that would enter one of their lists."""
    for t, group in _groups(batches, "w"):
        ids, inner, outer, root = (t[c].to_numpy() for c in ("id", "inner", "outer", "root"))
        x = _unit(t["vec"]) if len(set(t["dim"].to_pylist())) == 1 else None
        begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        us, vs, ss = [], [], []
        for i, j in zip(begin, [*begin[1:], len(ids)], strict=True):
            y = x[i:j] if x is not None else _unit(t["vec"].slice(i, j - i))
            s = y @ y.T
            np.fill_diagonal(s, -2)
            a, b = np.nonzero(s > np.where(root[i:j][:, None] == root[i:j][None, :], inner[i:j][:, None], outer[i:j][:, None]))
            us.append(ids[i + a])
            vs.append(ids[i + b])
            ss.append(s[a, b])
        u, v, s = np.concatenate(us), np.concatenate(vs), np.concatenate(ss)
        # the same pair from many centres of this batch is sent once
        order = np.lexsort((v, u))
        u, v, s = u[order], v[order], s[order]
        first = np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])] if len(u) else np.zeros(0, bool)
        yield _pairs(u[first], v[first], s[first])
    yield _none()


def _best(pairs: DataFrame, roots: DataFrame, size: int) -> DataFrame:
    """The first size neighbours of each vector inside its component, and as many outside, by similarity and then id."""
    pairs = pairs.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    pairs = pairs.join(roots.select(F.col("id").alias("u"), F.col("root").alias("_u")), "u").join(roots.select(F.col("id").alias("v"), F.col("root").alias("_v")), "v")
    pairs = pairs.select("u", "v", "sim", (F.col("_u") != F.col("_v")).alias("out"))
    order = Window.partitionBy("u", "out").orderBy(F.desc("sim"), "v")
    return pairs.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= size)


def _sign_buckets(vectors: DataFrame, n: int, turn: int) -> DataFrame:
    """(bucket, id, vec, root) for each table of random hyperplanes; each turn has its own."""
    bits = max(0, int(np.ceil(np.log2(max(1, n / _BUCKET)))))

    def run(batches):
        for b in batches:
            for dim in sorted(set(b.column(1).to_pylist())):
                rows = b.filter(pa.compute.equal(b.column(1), dim))
                x = _unit(rows.column(2))
                planes = np.random.default_rng([_SEED, dim, turn]).standard_normal((dim, max(1, bits) * _TABLES))
                signs = (x @ planes > 0).reshape(len(x), _TABLES, -1)
                code = (signs * (1 << np.arange(signs.shape[2]))).sum(2) if bits else np.zeros((len(x), _TABLES), np.int64)
                for k in range(_TABLES):
                    bucket = (dim * _TABLES + k) * (1 << 40) + code[:, k]
                    yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), rows.column(0), rows.column(2), rows.column(3)], names=["bucket", "id", "vec", "root"])

    return vectors.select("id", "dim", "vec", "root").mapInArrow(lean(run), "bucket long, id long, vec binary, root long")


def _descend(graph: DataFrame, vectors: DataFrame, size: int) -> DataFrame:
    """One round: neighbours of neighbours are compared at the vector between them."""
    order = Window.partitionBy("v").orderBy(F.desc("sim"), "u")
    back = graph.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= size)
    around = graph.select(F.col("u").alias("w"), F.col("v").alias("id")).union(back.select(F.col("v").alias("w"), F.col("u").alias("id")))
    around = around.union(graph.select(F.col("u").alias("w"), F.col("u").alias("id"))).distinct()
    last = lambda side: F.when(F.count_if(side) >= size, F.min(F.when(side, F.col("sim")))).otherwise(F.lit(-1.5))
    floors = graph.groupBy(F.col("u").alias("id")).agg(last(~F.col("out")).alias("inner"), last(F.col("out")).alias("outer"))
    known = vectors.join(floors, "id", "left").select("id", "dim", "vec", "root", F.coalesce("inner", F.lit(-1.5)).alias("inner"), F.coalesce("outer", F.lit(-1.5)).alias("outer"))
    asked = around.join(known, "id").repartition("w").sortWithinPartitions("w")
    return asked.select("w", "id", "dim", "vec", "root", "inner", "outer").mapInArrow(lean(_refine), "u long, v long, sim double")


def _audit(vectors: DataFrame, roots: DataFrame, threshold: float, sample: int) -> float:
    """Share of the links of a seeded sample, by brute force over all vectors, whose ends share a component, averaged over the vectors."""
    placed = vectors.join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", "dim", "vec", F.coalesce("root", "id").alias("root"))
    drawn = placed.orderBy(F.xxhash64(F.lit(_SEED), "id"), "id").limit(sample).collect()  # bounded by sample
    by_dim: dict[int, list] = {}
    for r in drawn:
        by_dim.setdefault(r.dim, []).append(r)
    queries = {d: (np.array([r.id for r in rows]), np.array([r.root for r in rows]), _unit(pa.array([bytes(r.vec) for r in rows]))) for d, rows in by_dim.items()}

    def run(batches):
        true, found = {}, {}
        for b in batches:
            for dim, (qid, qroot, q) in queries.items():
                rows = b.filter(pa.compute.equal(b.column(1), dim))
                if rows.num_rows:
                    hit = (q @ _unit(rows.column(2)).T >= threshold) & (qid[:, None] != rows.column(0).to_numpy()[None, :])
                    kept = hit & (qroot[:, None] == rows.column(3).to_numpy()[None, :])
                    for q, t, f in zip(qid.tolist(), hit.sum(1).tolist(), kept.sum(1).tolist(), strict=True):
                        true[q], found[q] = true.get(q, 0) + t, found.get(q, 0) + f
        yield pa.RecordBatch.from_arrays([pa.array(list(true), pa.int64()), pa.array(list(true.values()), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["q", "t", "f"])

    share = placed.mapInArrow(lean(run), "q long, t long, f long").groupBy("q").agg((F.sum("f") / F.nullif(F.sum("t"), F.lit(0))).alias("share"))
    found = share.agg(F.avg("share")).first()[0]
    return 1.0 if found is None else found


def _all_links(vectors: DataFrame, n: int, threshold: float) -> DataFrame:
    """Links (a, b) that connect all that is linked: every two blocks of vectors are compared."""
    blocks = max(1, -(-n // _BLOCK))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    other = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: F.struct(F.least(b, own).alias("low"), F.greatest(b, own).alias("high")))
    asked = vectors.select("id", "dim", "vec", F.explode(other).alias("p")).select("dim", "p.low", "p.high", "id", "vec")

    def run(batches):
        for t, group in _groups(batches, "dim", "low", "high"):
            ids, begin = t["id"].to_numpy(), np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            for i, j in zip(begin, [*begin[1:], len(ids)], strict=True):
                x = _unit(t["vec"].slice(i, j - i))
                a, b = np.nonzero(np.triu(x @ x.T >= threshold, 1))
                keep = spanning(j - i, a, b, np.zeros(len(a)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[i + a[keep]]), pa.array(ids[i + b[keep]])], names=["a", "b"])

    return asked.repartition("dim", "low", "high").sortWithinPartitions("dim", "low", "high").mapInArrow(lean(run), "a long, b long")


def _count(threshold: float):
    """Links of each member of a component's pair of blocks with the other block, counting copies."""

    def run(batches):
        for t, group in _groups(batches, "root", "low", "high"):
            ids, mult, own = t["id"].to_numpy(), t["n"].to_numpy(), t["block"].to_numpy()
            low, high = t["low"].to_numpy(), t["high"].to_numpy()
            begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            out_id, out_n = [], []
            for i, j in zip(begin, [*begin[1:], len(ids)], strict=True):
                x, part = _unit(t["vec"].slice(i, j - i)), own[i:j]
                a, b = np.flatnonzero(part == low[i]), np.flatnonzero(part == high[i])
                s = x[a] @ x[b].T >= threshold
                s &= a[:, None] != b[None, :]
                out_id.append(ids[i + a])
                out_n.append(s.astype(np.float64) @ mult[i + b])
                if low[i] != high[i]:
                    out_id.append(ids[i + b])
                    out_n.append(s.T.astype(np.float64) @ mult[i + a])
            if out_id:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_id)), pa.array(np.concatenate(out_n).astype(np.int64))], names=["id", "links"])

    return run


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, size: int = LIST, rounds: int = ROUNDS, audit: int = AUDIT) -> DataFrame:
    """One row for each vector: id_col, n_links, component_id and kept.

    Vectors that are null, zero or empty, or hold null or non-finite
    components, link with nothing; vectors of different length do not link.
    Equal vectors are one class and link with each other. component_id is the
    least id over links, kept whether that is the row's own id. Rows with a null
    id count as other vectors; a component of such rows alone has a null id and
    is not kept. Other columns are ignored.
    """
    given = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    flat = cut(given.mapInArrow(lean(_usable), "id long, dim int, vec binary"))
    classes = flat.where(F.col("vec").isNotNull()).groupBy("dim", "vec").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()))
    n = classes.count()
    vectors = classes.select("id", "dim", "vec")
    links = lambda g: g.where(F.col("sim") >= threshold).select(F.col("u").alias("a"), F.col("v").alias("b"))
    graph, edges, state, sure = None, None, None, False
    placed = vectors.withColumn("root", F.col("id"))
    for k in range(2 * rounds):
        buckets = _sign_buckets(placed, n, k).repartition("bucket").sortWithinPartitions("bucket")
        pairs = buckets.mapInArrow(lean(_start(size)), "u long, v long, sim double")
        if graph is not None:
            pairs = pairs.union(_descend(graph, placed, size)).union(graph.select("u", "v", "sim"))
        graph = cut(_best(pairs, placed, size))
        edges = links(graph) if edges is None else edges.union(links(graph))
        roots = components(edges)
        placed = cut(vectors.join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", "dim", "vec", F.coalesce("root", "id").alias("root")))
        edges = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        graph = cut(_best(graph.select("u", "v", "sim"), placed, size))
        before, state = state, placed.agg(F.bit_xor(F.xxhash64("id", "root"))).first()[0]
        if before == state:
            sure = _audit(vectors, roots, threshold, audit) >= RECALL
            if sure:
                break
            size *= 2
    if not sure:
        roots = components(_all_links(vectors, n, threshold))
    placed = classes.join(roots.withColumnRenamed("node", "id"), "id")
    sizes = placed.groupBy("root").agg(F.count("*").alias("members"))
    wide = placed.join(sizes, "root").withColumn("blocks", F.ceil(F.col("members") / _BLOCK).cast("int"))
    wide = wide.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.least(b, F.col("block")).alias("low"), F.greatest(b, F.col("block")).alias("high")))
    asked = wide.select("root", "id", "n", "vec", "block", F.explode(other).alias("p")).select("root", "p.low", "p.high", "block", "id", "n", "vec")
    asked = asked.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high")
    counts = asked.mapInArrow(lean(_count(threshold)), "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    found = classes.join(counts, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left").join(least, "root", "left")
    found = found.select("vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.when(F.col("root").isNotNull(), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
    linked = flat.where(F.col("vec").isNotNull()).join(found, "vec").select("id", "n_links", "component_id")
    alone = flat.where(F.col("vec").isNull()).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    done = linked.union(alone)
    return done.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op5_nn_descent(spark, sf_dir) -> DataFrame:
    """Links, component and whether it is kept for every vector."""
    return near_vectors(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
