"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it is unset a temporary folder takes its place, but only under a local
    master, as in tests: elsewhere other machines could not read it, which is an
    error at once and not lost data later.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="longwatch-")
    spark.sparkContext.setCheckpointDir(own)
    return own


#: Lets Spark remove a query's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint; the shuffles behind them go at once."""
    spark = df.sparkSession
    shared_dir(spark)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


#: Bytes of a batch that goes to a Python worker, unless the session has a size of its own.
_BATCH, _BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


def lean(work):
    """A function over batches that gives the memory it has freed back to the system at its end, as Python workers wait on for other tasks.

    Also bounds the session's batches by bytes where that is at Spark's default: texts can be long.
    """
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.conf.get(_BATCH) == "67108864b":
        spark.conf.set(_BATCH, _BATCH_BYTES)

    def run(batches):
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return run


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(column: pa.Array) -> list[str]:
    """An Arrow string column as Python strings; a null is an empty text."""
    return [x or "" for x in column.to_pylist()]


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Links that a task reduces at a time.
LINKS = 1 << 20


def least_labels(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Labels after links a-b: each item takes the least label that it reaches over them and label's pointers."""
    while True:
        la, lb = label[a], label[b]
        if (la == lb).all():
            return label
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def _stars(batches):
    """Links (u, v) as links to the least node that each reaches, for so many links at a time."""

    def reduced(held):
        u, v = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]) for k in (0, 1))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        label = least_labels(len(nodes), at[:len(u)], at[len(u):], np.arange(len(nodes)))
        far = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[far], pa.int64()), pa.array(nodes[label[far]], pa.int64())], names=["u", "v"])

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= LINKS:
            yield reduced(held)
            held, n = [], 0
    if n:
        yield reduced(held)


def components(edges: DataFrame) -> DataFrame:
    """Connected components: (a, b) longs in, (node, root) out, root the least node.

    Each task reduces its links to stars around least nodes, so many at a time.
    While they still fill several tasks, large-star and small-star rounds
    follow; each is two grouped minima (combined before the shuffle) and joins,
    and its rows never exceed the edges. Nodes without an edge to another node
    have no row. Rows with a null end are ignored.
    """
    spark = edges.sparkSession
    width = shuffle_width(spark)
    real = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    links = cut(real.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v")).coalesce(width).mapInArrow(lean(_stars), "u long, v long"))
    state = _digest(links)
    while state[0]:
        tasks = -(-state[0] // LINKS)
        links = links.coalesce(min(tasks, width)).mapInArrow(lean(_stars), "u long, v long")
        if tasks == 1:
            links = cut(links)
            break
        links = cut(links.distinct())
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(least, "u")
        small = (
            near.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .where("u != v").distinct()
        )
        links = cut(small)
        now = _digest(links)
        if now == state:
            break
        state = now
    if not state[0]:
        return spark.createDataFrame([], "node long, root long")
    roots = links.select("v").distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))


def _digest(links: DataFrame) -> tuple[int, int]:
    n, x = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return n, x or 0


def buckets_by_range(df: DataFrame, key: str, n: int) -> list[int]:
    """At most n ascending cut points of a long column, by approximate quantiles.

    The result is bounded by n whatever the table's size.
    """
    if n < 2:
        return []
    share = F.array(*[F.lit(i / n) for i in range(1, n)])
    found = df.select(F.percentile_approx(key, share, F.lit(20 * n)).alias("q")).first()[0]
    return sorted(set(found or []))
