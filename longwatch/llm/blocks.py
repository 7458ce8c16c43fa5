"""Packed blocks: how operators on substrings send many small facts about documents through a shuffle.

A batch of documents sends each shard one binary block of columns, and what it
knows of a document itself goes straight on, as rows with a shard beyond the
last. Every join is on the id alone, so that one shuffle of the texts serves
all passes over them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text from which a batch is worked on.
BATCH = 1 << 25
#: Shards for each shuffle partition; a task works on one shard at a time.
SHARDS = 8


def first_texts(docs: DataFrame, id_col: str, text_col: str, other: list[str]) -> DataFrame:
    """(_id, _row, _data, _state): the other columns, the text's bytes, and its place among equal ids and texts.

    _state.whole: a lesser id, _state.least, has an equal text. _state.nth: the
    number of the text among those that share the id. A null id is below all
    others.
    """
    own = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    data = F.col(text_col).cast("binary")
    rows = docs.select(own.alias("_id"), F.struct(*[docs[c] for c in other]).alias("_row"), data.alias("_data"), F.unhex(F.sha2(F.coalesce(data, F.lit(b"")), 256)).alias("_sum"))
    rows = rows.where("_sum IS NOT NULL")  # always so; said here, it does not turn up in some branches alone and split the shuffle
    pairs = rows.select("_id", "_sum").distinct()
    least = pairs.groupBy("_sum").agg(F.min("_id").alias("least"))
    of = F.struct("_sum", (F.col("least") < F.col("_id")).alias("whole"), "least")
    pairs = pairs.join(least, "_sum").groupBy("_id").agg(F.sort_array(F.collect_list(of)).alias("_texts"))
    nth = F.array_position(F.col("_texts._sum"), F.col("_sum")).cast("int")
    state = F.struct(nth.alias("nth"), F.element_at("_texts.whole", nth).alias("whole"), F.element_at("_texts.least", nth).alias("least"))
    return rows.join(pairs.hint("shuffle_hash"), "_id").select("_id", "_row", "_data", state.alias("_state"))


def pack(*columns: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def unpack(data: bytes, *kinds) -> list[np.ndarray]:
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(data) // sum(sizes), 0, []
    for k, size in zip(kinds, sizes, strict=True):
        out.append(np.frombuffer(data, k, n, at))
        at += n * size
    return out


def by_value(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stable order, starts of the equal stretches in that order)."""
    order = np.argsort(values, kind="stable")
    there = values[order]
    return order, np.flatnonzero(np.r_[True, there[1:] != there[:-1]]) if len(there) else np.zeros(0, np.int64)


def grouped_texts(batches, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes], list]]:
    """Regroups (_id, _row, _data, _state, _found?) rows as (id, nth, bytes, flags) until they hold enough bytes; ordered by id."""
    rows, held = [], 0

    def done():
        rows.sort(key=lambda r: r[:2])
        ids, nths, data, flags = zip(*rows, strict=True)
        return np.array(ids, np.int64), np.array(nths, np.int32), list(data), list(flags)

    for b in batches:
        flags = b.column(4).to_pylist() if b.num_columns > 4 else [None] * b.num_rows
        for i, state, x, f in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), b.column(2), flags, strict=True):
            x = x.as_py() or b""
            rows.append((i, state["nth"], x, found_for(f, state["nth"])))
            held += len(x)
            if held >= most:
                yield done()
                rows, held = [], 0
    if rows:
        yield done()


def found_for(found: list[dict] | None, nth: int) -> list[bytes]:
    return [f["data"] for f in found or [] if f["nth"] == nth]


def block_rows(out: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) if out else [(), (), (), ()]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["shard", "id", "nth", "data"])


ROWS = "shard long, id long, nth int, data binary"


def by_value_rows(values: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, its rows) for each distinct value; rows keep their order."""
    order, begin = by_value(values)
    for i, x in zip(begin, np.split(rows[order], begin[1:]), strict=False):
        yield values[order[i]], x


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return (h % np.uint64(shards)).astype(np.int64)


def by_shard(work, shards: int):
    """Runs work, which gives one batch of rows or many, over the blocks of one shard at a time; rows come sorted by shard."""

    def done(held):
        rows = work(held)
        yield from [rows] if isinstance(rows, pa.RecordBatch) else rows

    def run(batches):
        now, held = None, []
        for b in batches:
            known = b.filter(pa.compute.greater_equal(b.column(0), shards))
            if known.num_rows:
                yield known
            b = b.filter(pa.compute.less(b.column(0), shards))
            for s, x in zip(b.column(0).to_pylist(), b.column(3), strict=True):
                if s != now and held:
                    yield from done(held)
                    held = []
                now = s
                held.append(x.as_py())
        if held:
            yield from done(held)

    return run


def join_blocks(blocks: list[bytes], *kinds) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*(unpack(b, *kinds) for b in blocks), strict=True)]


def per_document(ids: np.ndarray, nths: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """One row with the packed columns for each document."""
    order = np.lexsort((nths, ids))
    i, n = ids[order], nths[order]
    begin = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (n[1:] != n[:-1])]) if len(i) else np.zeros(0, np.int64)
    return block_rows([(0, int(ids[x[0]]), int(nths[x[0]]), pack(*(c[x] for c in columns))) for x in np.split(order, begin[1:]) if len(x)])


def dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("shard").sortWithinPartitions("shard")


def by_id(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.col("id").alias("_id")).agg(F.collect_list(F.struct("nth", "data")).alias("_found"))
