"""Recovery of failed requests by halving their ranges, under a shared budget.

A budget is spent depth first, so a document's chunks come as one row, which is
worked through alone, and documents run in parallel, many to a batch. The model
is a function of a range and an attempt, as a scripted table or a provider.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_REQUESTS = 64
LIMIT = 100_000
RECOVERABLE = ("invalid_model_output", "truncated_output")
ATTEMPTS = "doc_id string, step int, lo int, hi int, depth int, outcome string, error string, recovery boolean"
NAMES = ["doc_id", "step", "lo", "hi", "depth", "outcome", "error", "recovery"]
KINDS = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_()]


def checked_limit(value: int) -> int:
    """(V7)"""
    if isinstance(value, bool) or not isinstance(value, int) or not 0 <= value <= LIMIT:
        raise ValueError(f"max_requests must be a whole number from 0 to {LIMIT}")
    return value


def work_through(chunks: list[tuple[int, int]], answer: Callable[[int, int], str | None], budget: int) -> list[tuple]:
    """(lo, hi, depth, outcome, error, recovery) of each request and each range given up, in order.

    answer(lo, hi) is None or the class of its failure. A recoverable failure of
    a range of several sections is halved; requests for halves use the budget,
    first halves first; a class that cannot be recovered ends the document.
    """
    out: list[tuple] = []
    for lo, hi in chunks:
        open_ = [(lo, hi, 0)]
        while open_:
            a, b, depth = open_.pop()
            if depth and budget <= 0:
                out.append((a, b, depth, "failed", "recovery_limit_exhausted", False))
                continue
            budget -= depth > 0
            error = answer(a, b)
            if error is None:
                out.append((a, b, depth, "succeeded", None, depth > 0))
            elif error not in RECOVERABLE:
                return [*out, (a, b, depth, "aborted", error, depth > 0)]
            elif a == b or budget <= 0:
                out.append((a, b, depth, "failed", error, depth > 0))
            else:
                out.append((a, b, depth, "split", error, depth > 0))
                middle = a + (b - a + 1) // 2 - 1
                open_ += [(middle + 1, b, depth + 1), (a, middle, depth + 1)]
    return out


def recover(chunks: DataFrame, failures: DataFrame, max_requests: int = MAX_REQUESTS) -> DataFrame:
    """Attempts by document for chunks (doc_id, lo, hi) and scripted failures (doc_id, section, error).

    A request fails with the class of the first failing section in its range.
    """
    limit = checked_limit(max_requests)
    c = F.col
    ranges, failed = F.struct("lo", "hi"), F.struct("section", "error")
    rows = chunks.select("doc_id", ranges.alias("range"), F.lit(None).alias("failure")).unionByName(failures.select("doc_id", F.lit(None).alias("range"), failed.alias("failure")))
    rows = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list("range")).alias("ranges"), F.sort_array(F.collect_list("failure")).alias("failures")).where(F.size("ranges") > 0)
    rows = rows.select(c("doc_id").cast("string").alias("doc_id"), c("ranges.lo").alias("lo"), c("ranges.hi").alias("hi"), c("failures.section").alias("section"), c("failures.error").alias("error"))

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, lo, hi, section, error in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                bad = dict(zip(section, error, strict=True))
                places = sorted(bad)

                def answer(a: int, b: int) -> str | None:
                    k = bisect_left(places, a)  # noqa: B023
                    return bad[places[k]] if k < len(places) and places[k] <= b else None  # noqa: B023

                out += [(doc_id, k, *r) for k, r in enumerate(work_through(list(zip(lo, hi, strict=True)), answer, limit))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(KINDS)], NAMES)

    return rows.mapInArrow(run, ATTEMPTS)


def failure_leaves(planned: DataFrame, succeeded: DataFrame, leaves: DataFrame) -> DataFrame:
    """(doc_id, ord, section_id, category, char_count) of planned sections without success.

    planned (doc_id, ord, section_id, char_count), succeeded (doc_id,
    section_id), leaves (doc_id, section_id, category): where several leaves
    name a section, the least category stands; where none does, its answer
    could not be read.
    """
    key = ["doc_id", "section_id"]
    known = leaves.groupBy(*key).agg(F.min("category").alias("category"))
    failed = planned.join(succeeded.select(*key), key, "left_anti").join(known, key, "left")
    return failed.select("doc_id", "ord", "section_id", F.coalesce("category", F.lit(RECOVERABLE[0])).alias("category"), "char_count")
