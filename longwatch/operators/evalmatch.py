"""Matching findings to gold labels, one to one."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCHES = "doc_id string, expected_id string, matched_finding_id string, matched boolean, reason string, type_agreement boolean"
NAMES = ["doc_id", "expected_id", "matched_finding_id", "matched", "reason", "type_agreement"]
KINDS = [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.bool_()]


def match_document(labels: list[dict], findings: list[dict]) -> Iterator[tuple]:
    """Each label in order takes the first free finding that fits, of its own type if there is one."""
    free = {k: (f["finding_type"], f["section_id"] or "", " ".join(f["quotes"] or ()), f["id"]) for k, f in enumerate(findings)}
    for label in labels:
        section, quote, kind = label["section_id_contains"] or "", label["quote_contains"] or "", label["finding_type"]
        best, reason = None, "no candidate"
        for k, (own, place, quotes, _) in free.items():
            same = own == kind
            if not (section or quote):
                failed = "" if same else "type mismatch (no evidence constraints)"
            elif section not in place:
                failed = "evidence constraints; section failed"
            else:
                failed = "" if quote in quotes else "evidence constraints; quote failed"
            if failed:
                reason = failed
                continue
            if best is None:
                best = k
            if same:
                best = k
                break
        if best is None:
            yield label["id"], None, False, reason, None
            continue
        own, _, _, found = free.pop(best)
        yield label["id"], found, True, "matched" if own == kind else "matched; finding_type disagreement", own == kind


def match_findings(labels: DataFrame, findings: DataFrame) -> DataFrame:
    """labels (doc_id, ord, id, finding_type, section_id_contains, quote_contains) against findings (doc_id, idx, id, finding_type, section_id, quotes).

    A document's labels and findings come as one row, by ord and idx, many documents to a batch.
    """
    label = F.struct(F.isnull("ord").alias("last"), "ord", "id", "finding_type", "section_id_contains", "quote_contains")
    finding = F.struct(F.isnull("idx").alias("last"), "idx", "id", "finding_type", "section_id", "quotes")
    rows = labels.select("doc_id", label.alias("label"), F.lit(None).alias("finding")).unionByName(findings.select("doc_id", F.lit(None).alias("label"), finding.alias("finding")))
    rows = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list("label")).alias("labels"), F.sort_array(F.collect_list("finding")).alias("findings")).where(F.size("labels") > 0)

    def run(batches):
        for batch in batches:
            docs = zip(*(x.to_pylist() for x in batch.columns), strict=True)
            out = [(doc_id, *r) for doc_id, own, found in docs for r in match_document(own, found)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(KINDS)], NAMES)

    return rows.select(F.col("doc_id").cast("string").alias("doc_id"), "labels", "findings").mapInArrow(run, MATCHES)


def recall(found: Column, expected: Column) -> Column:
    """(A10)"""
    return F.when(expected == 0, 1.0).otherwise(found / F.when(expected != 0, expected))


def summary(matches: DataFrame) -> DataFrame:
    sums = matches.groupBy("doc_id").agg(F.count("*").alias("expected_count"), F.count_if("matched").alias("true_positives"))
    return sums.withColumn("false_negatives", F.col("expected_count") - F.col("true_positives")).withColumn("recall", recall(F.col("true_positives"), F.col("expected_count")))
