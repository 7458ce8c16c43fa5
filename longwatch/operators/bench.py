"""Matrices of documents and configurations: jobs, resumption, manifests and their metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["bench_id", "config_id"]
#: Fields of an artefact that must agree with its job, in the order in which a difference is told.
COMPARED = ("schema_version", "doc_id", "provider", "model", "reasoning_effort", "prompt_version")


def config_id(provider: Column, model: Column, effort: Column) -> Column:
    """A name for a configuration; what is not safe in it is told by 12 digits of a digest."""
    raw = F.concat_ws("__", F.lower(provider), F.lower(model), F.lower(effort))
    safe = F.regexp_replace(raw, r"[^a-z0-9._-]+", "-")
    return F.when(safe == raw, safe).otherwise(F.concat_ws("-", safe, F.substring(F.sha2(raw, 256), 1, 12)))


#: Configurations that a matrix may have: they are sent to every task.
MOST_CONFIGS = 1000


def short_list(configs: DataFrame) -> DataFrame:
    """The caller's configurations for a broadcast; more than MOST_CONFIGS are an error: at once where the plan knows its rows, else when it runs.

    No job is spent on counting them.
    """
    known = configs._jdf.queryExecution().optimizedPlan().stats().rowCount()
    if known.isDefined() and int(str(known.get())) > MOST_CONFIGS:
        raise ValueError(f"a matrix has {MOST_CONFIGS} configurations at most")
    few = configs.limit(MOST_CONFIGS + 1)
    error = F.raise_error(F.lit(f"a matrix has {MOST_CONFIGS} configurations at most")).cast("boolean")
    # all of them are in one row for a moment, so that they are counted on the way
    listed = few.agg(F.collect_list(F.struct(*configs.columns)).alias("_all")).where(F.when(F.size("_all") > MOST_CONFIGS, error).otherwise(True))
    return F.broadcast(listed.select(F.inline("_all")))


def jobs(documents: DataFrame, configs: DataFrame) -> DataFrame:
    """Every document under every configuration, which are a short list."""
    return documents.crossJoin(short_list(configs))


def merge_manifest(planned: DataFrame, prior: DataFrame, carried: tuple[str, ...] = ("status", "attempts", "runtime_seconds")) -> DataFrame:
    """Planned jobs with what a prior manifest knows of them: planned values go first where both have one."""
    old = prior.select(*KEYS, *[F.col(c).alias(f"_{c}") for c in carried if c in prior.columns])
    out = planned.join(old, KEYS, "left")
    for c in carried:
        both = [F.col(x) for x in (c, f"_{c}") if x in out.columns]
        out = out.withColumn(c, F.coalesce(*both)) if both else out
    return out.drop(*[f"_{c}" for c in carried])


def first_mismatch(fields: tuple[str, ...] = COMPARED, left: str = "", right: str = "found_") -> Column:
    """The name of the first field in which a job and an artefact differ, or null. (V8)"""
    return F.coalesce(*[F.when(~F.col(left + f).eqNullSafe(F.col(right + f)), F.lit(f)) for f in fields])


def classify(planned: DataFrame, artefacts: DataFrame, fields: tuple[str, ...] = COMPARED, overwrite: bool = False) -> DataFrame:
    """Adds decision (run, render, skip or conflict) and mismatch to planned jobs.

    artefacts: KEYS, has_json, has_markdown and the compared fields.
    """
    found = artefacts.select(*KEYS, "has_json", "has_markdown", *[F.col(f).alias(f"found_{f}") for f in fields])
    rows = planned.join(found, KEYS, "left").withColumn("mismatch", F.when(F.coalesce("has_json", F.lit(False)), first_mismatch(fields)))
    there = F.coalesce("has_json", F.lit(False))
    decision = (
        F.when(F.lit(overwrite) | ~there, F.when(~there & F.coalesce("has_markdown", F.lit(False)) & ~F.lit(overwrite), "conflict").otherwise("run"))
        .when(F.col("mismatch").isNotNull(), "conflict").when(F.col("has_markdown"), "skip").otherwise("render")
    )
    return rows.withColumn("decision", decision).drop("has_json", "has_markdown", *[f"found_{f}" for f in fields])


def remaining(planned: DataFrame, done: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Planned rows that are not done."""
    return planned.join(done.select(*keys), keys, "left_anti")


def metric(values: Column, name: str) -> list[Column]:
    """Known count, sum, and whether all rows are known."""
    return [F.count(values).alias(f"{name}_known"), F.sum(values).alias(f"{name}_sum"), ((F.count(values) == F.count("*")) & (F.count("*") > 0)).alias(f"{name}_complete")]


def usage_totals(usages: DataFrame, key: str) -> DataFrame:
    """Sums of token usages; reasoning tokens are null where none are known."""
    return usages.groupBy(key).agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("reasoning_tokens").alias("reasoning_tokens"),
        F.count_if(F.col("attempt") == 1).alias("primary_requests"), F.count_if(F.col("attempt") > 1).alias("repair_requests"),
    )


def pivot_costs(rows: DataFrame, configs: list[str]) -> DataFrame:
    """Documents by configuration."""
    return rows.groupBy("doc_id").pivot("config_id", configs).agg(F.first("usd"))
