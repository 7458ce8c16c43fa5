"""Row types and closed vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SECTIONS = "doc_id string, ord int, id string, title string, text string, level int, start_char int, end_char int, parent_id string"
SECTION_COLUMNS = [c.split()[0] for c in SECTIONS.split(", ")]
EVIDENCE = "struct<quote:string,section_id:string,note:string>"
CLAIM = "struct<value:string,precision:string>"
REPRESENTATION = f"struct<width_bits:int,signed:boolean,epoch_kind:string,epoch:timestamp,unit:string,ticks_per_second:double,claimed_horizon:{CLAIM},rollover_behavior:string>"
FINDINGS = (
    "doc_id string, ord int, id string, finding_type string, title string, description string, severity string, confidence string, domains array<string>, "
    f"section_id string, evidence array<{EVIDENCE}>, machine_interpretation string, validation_status string, source_verified boolean, "
    f"time_representation {REPRESENTATION}, scope_relevance string, scope_rationale string, disposition string"
)

# Tokens that stored findings and reports use.
VOCABULARIES = {
    "finding_type": ("explicit_defect", "internal_inconsistency", "missing_documentation", "implied_assumption", "time_assurance_gap", "lifetime_representation_mismatch"),
    "severity": ("critical", "high", "medium", "low", "info"),
    "confidence": ("high", "medium", "low"),
    "domain": (
        "y2036", "y2038", "y2100", "y2106", "epoch", "representation", "signedness", "date_range", "calendar", "leap_year", "leap_second", "utc", "tai", "gps_time",
        "monotonic", "relative_vs_absolute", "serialization", "persistence", "synchronization", "archival", "certificate_validity", "scheduling", "migration", "rollover",
        "missing_documentation", "other",
    ),
    "validation_status": ("unverified", "verified", "failed", "not_applicable"),
    "disposition": ("new", "accepted", "rejected", "needs_review", "edited"),
    "scope_relevance": ("core", "supporting", "incidental", "out_of_scope"),
    "horizon_precision": ("year", "month", "day", "instant"),
    "epoch_kind": ("unix", "ntp", "gps", "mjd", "ntfs", "uuid", "tai_1958", "other"),
    "unit": ("seconds", "milliseconds", "microseconds", "nanoseconds", "days", "weeks", "ticks"),
    "analysis_mode": ("whole_document", "section_aware", "hybrid"),
    "request_batching": ("whole_document", "per_section", "section_chunks"),
    "analysis_status": ("complete", "partial"),
    "failure_category": ("invalid_model_output", "truncated_output", "recovery_limit_exhausted"),
    "privacy_mode": ("ephemeral", "persist_outputs", "workspace"),
    "reasoning_effort": ("none", "low", "medium", "high", "xhigh", "max"),
    "media_type": ("text", "docx", "pdf", "zip", "tar", "html", "unknown"),
    # in the order of a summary
    "assurance_status": ("rejected", "human_confirmed", "cross_model_supported", "deterministically_validated", "source_verified", "candidate", "deferred"),
}


def vocabulary(spark: SparkSession, name: str) -> DataFrame:
    """(ord, value) of a closed vocabulary."""
    return spark.createDataFrame(list(enumerate(VOCABULARIES[name])), "ord int, value string")
