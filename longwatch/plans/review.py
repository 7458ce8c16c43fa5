"""A section-aware review: sections and the answers to their requests in, findings and validated runs out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longwatch.operators.findings import bind_sections, finding_rows, parse_responses, renumber
from longwatch.operators.grounding import verify_sources
from longwatch.operators.recovery import RECOVERABLE, failure_leaves
from longwatch.operators.report import VERSIONS
from longwatch.storage import computed_once


def reviewed_findings(packed: DataFrame, responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings, outcomes) of the answers to packed requests.

    packed: sections of pack(); responses (doc_id, request, content), request
    the chunk's number. An answer that cannot be read, one that names a
    reference outside its request, and a request without an answer fail whole;
    answers to requests that are not planned are left out. Of several answers
    to one request all that can be read count. Findings have ids in the order
    of their sections; a finding is source_verified by the text of the section
    that it names, or of any of its request's if it names none.
    """
    c = F.col
    keys = ["doc_id", "request"]
    bindings = packed.select("doc_id", c("chunk_index").alias("request"), "ord", "ref", "id", "text")
    planned = bindings.select(*keys).distinct()
    answers = responses.join(planned, keys, "left_semi")
    parsed = computed_once(parse_responses(answers))  # findings, refusals and outcomes all come from it
    rows = finding_rows(parsed)
    bound = bind_sections(rows, bindings)
    refused = rows.select(*keys).distinct().join(bound.select(*keys).distinct(), keys, "left_anti").withColumn("refused", F.lit(True))
    read = parsed.groupBy(*keys).agg(F.bool_or(c("error").isNull()).alias("read"))
    succeeded = F.coalesce("read", F.lit(False)) & c("refused").isNull()
    outcomes = planned.join(read, keys, "left").join(refused, keys, "left").select(*keys, succeeded.alias("succeeded"), F.when(~succeeded, RECOVERABLE[0]).alias("category"))

    return numbered_findings(bound, packed), outcomes


def numbered_findings(bound: DataFrame, packed: DataFrame) -> DataFrame:
    """Findings (doc_id, request, item, canonical_id and the rest) checked against their sources, with ids in the order of sections."""
    c = F.col
    keys = ["doc_id", "request"]
    at = F.struct("request", "item")
    own = bound.select("doc_id", at.alias("finding_id"), "request", c("canonical_id").alias("named"), F.explode("evidence.quote").alias("quote"))
    every = own.join(packed.select("doc_id", c("chunk_index").alias("request"), "id"), keys).where(F.coalesce(c("named") == c("id"), F.lit(True)))
    evidence = every.select("doc_id", "finding_id", c("id").alias("section_id"), "quote")
    checked = verify_sources(evidence, packed.select("doc_id", c("id").alias("section_id"), "text")).select("doc_id", "finding_id", "source_verified")
    named = bound.withColumn("finding_id", at).drop("section_id").withColumnRenamed("canonical_id", "section_id")
    full = named.join(checked, ["doc_id", "finding_id"], "left").withColumn("source_verified", F.coalesce("source_verified", F.lit(False)))
    numbered = renumber(full.withColumn("position", c("finding_id")), packed.select("doc_id", "id", "ord"))
    return numbered.drop("finding_id", "position")


def reviewed_runs(packed: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One run of the current version for each document, under which no rule of violations() is broken.

    run_id is the document's id. A run is partial if one of its requests failed.
    Second requests count as repairs where outcomes have repair_requests.
    """
    c = F.col
    sized = packed.select("doc_id", "ord", c("id").alias("section_id"), F.length("text").alias("char_count"), c("chunk_index").alias("request"))
    done = sized.join(outcomes.where("succeeded").select("doc_id", "request"), ["doc_id", "request"], "left_semi")
    known = sized.join(outcomes.where("NOT succeeded").select("doc_id", "request", "category"), ["doc_id", "request"]).select("doc_id", "section_id", "category")
    leaves = failure_leaves(sized.drop("request"), done, known)
    leaf = F.struct("ord", F.struct("section_id", "category", "char_count").alias("leaf"))
    failed = leaves.groupBy("doc_id").agg(F.sort_array(F.collect_list(leaf))["leaf"].alias("unanalyzed_sections"), F.sum("char_count").alias("failed_chars"))
    counts = sized.groupBy("doc_id", "request").agg(F.count("*").alias("n"), F.sum("char_count").alias("chars"))
    sums = counts.groupBy("doc_id").agg(
        F.count("*").cast("int").alias("analysis_request_count"), F.sum("n").cast("int").alias("sections_analyzed"), F.sum("chars").alias("analyzed_chars"),
        F.sort_array(F.collect_list(F.struct("request", "n")))["n"].cast("array<int>").alias("chunk_section_counts"),
    )
    lost = F.coalesce("unanalyzed_sections", F.array().cast(failed.schema["unanalyzed_sections"].dataType))
    rows = sums.join(failed, "doc_id", "left").withColumns({"unanalyzed_sections": lost, "failed_chars": F.coalesce("failed_chars", F.lit(0).cast("long"))})
    n_failed = F.size("unanalyzed_sections")
    zero = F.lit(0)
    if "repair_requests" in outcomes.columns:
        rows = rows.join(outcomes.groupBy("doc_id").agg(F.sum("repair_requests").cast("int").alias("repairs")), "doc_id", "left")
    repairs = F.coalesce("repairs", zero) if "repairs" in rows.columns else zero
    return rows.select(
        c("doc_id").alias("run_id"), F.lit(VERSIONS[-1]).alias("schema_version"), F.lit("section_aware").alias("analysis_mode"),
        F.when(F.array_max("chunk_section_counts") > 1, "section_chunks").otherwise("per_section").alias("request_batching"), "analysis_request_count", repairs.alias("repair_request_count"),
        (c("analysis_request_count") + repairs).alias("total_provider_request_count"), "chunk_section_counts", (n_failed == 0).alias("coverage_complete"), "sections_analyzed", "analyzed_chars",
        F.when(n_failed == 0, "complete").otherwise("partial").alias("analysis_status"), (c("sections_analyzed") - n_failed).alias("sections_succeeded"), n_failed.alias("sections_failed"),
        (c("analyzed_chars") - c("failed_chars")).alias("succeeded_chars"), "failed_chars", zero.alias("recovery_split_count"), zero.alias("recovery_request_count"),
        c("unanalyzed_sections.section_id").alias("failed_section_ids"), "unanalyzed_sections",
    )
