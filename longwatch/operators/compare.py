"""Fields in which two sets of reports differ."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What a comparison of reports looks at; a dot goes into a nested field.
FIELDS = (
    "schema_version", "provider", "model", "reasoning_effort", "analysis_mode", "request_batching", "analysis_request_count", "repair_request_count", "chunk_section_counts",
    "coverage_complete", "finding_count", "estimated_cost_usd", "actual_usage.input_tokens", "actual_usage.output_tokens", "actual_usage.reasoning_tokens", "actual_cost_usd",
)


def _has(runs: DataFrame, path: str) -> bool:
    kind = runs.schema
    for name in path.split("."):
        if not hasattr(kind, "fieldNames") or name not in kind.fieldNames():
            return False
        kind = kind[name].dataType
    return True


def comparison_fields(runs: DataFrame, keys: list[str], fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(keys, field, value): one row for each field of each run, value its text; a field that runs do not have is null."""
    text = {f: (F.to_json(f) if runs.select(f).schema[0].dataType.typeName() in ("array", "struct", "map") else F.col(f).cast("string")) if _has(runs, f) else F.lit(None).cast("string") for f in fields}
    wide = runs.select(*keys, *[v.alias(f) for f, v in text.items()])
    return wide.unpivot(keys, [F.col(f"`{f}`").alias(f) for f in fields], "field", "value")


def differences(left: DataFrame, right: DataFrame, keys: list[str], fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(keys, field, left, right): fields in which runs of equal keys differ, nulls being equal to each other.

    A run that only one side has gives one row, with the field run and the value
    present on its side.
    """
    a, b = comparison_fields(left, keys, fields), comparison_fields(right, keys, fields)
    both = a.join(b.withColumnRenamed("value", "_right"), [*keys, "field"]).where(~F.col("value").eqNullSafe(F.col("_right")))
    rows = both.select(*keys, "field", F.col("value").alias("left"), F.col("_right").alias("right"))
    none = F.lit(None).cast("string")
    only = lambda x, y, l, r: x.select(*keys).join(y.select(*keys), keys, "left_anti").select(*keys, F.lit("run").alias("field"), l.alias("left"), r.alias("right"))
    here = F.lit("present")
    return rows.union(only(left, right, here, none)).union(only(right, left, none, here))
