"""Resumable runs of many jobs: a table that grows by whole buckets, under one definition.

Jobs are dealt into buckets by a hash of their keys, and a folder holds one
partition for each bucket. A run takes the jobs that are not done (an
anti-join), works on so many buckets at a time, and replaces these buckets'
partitions by what they held and what is new. Replacing a bucket twice gives
the same bucket, so a run that is cut off anywhere can be started again. What
was run is told by a definition, of which a digest is kept beside the table;
another definition is refused by the name of the first field that differs.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longwatch.operators.bench import KEYS
from longwatch.storage import computed_once

BUCKETS, AT_A_TIME = 64, 16
#: States after which a job is not run again unless it is asked for.
DONE = ("executed", "skipped", "rendered", "failed")


class OtherDefinition(ValueError):
    """The folder holds jobs of another definition; field is the first that differs."""

    def __init__(self, name: str):
        super().__init__(f"the folder's jobs were made under another definition: {name}")
        self.field = name


@dataclass(frozen=True)
class Definition:
    """What a run is, without what changes from call to call.

    documents: a digest of the documents, see documents_digest(); configurations
    and controls are the caller's, as plain values.
    """

    tag: str | None = None
    documents: str = ""
    configurations: tuple = ()
    controls: dict = field(default_factory=dict)
    version: str | None = None

    def text(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    def digest(self) -> str:
        return hashlib.sha256(self.text().encode()).hexdigest()

    def first_difference(self, other: str) -> str | None:
        mine, there = json.loads(self.text()), json.loads(other)
        return next((k for k in mine if mine[k] != there.get(k)), None)


def documents_digest(documents: DataFrame, columns: list[str]) -> str:
    """A digest of rows in any order: their number, and the exclusive or of 128 bits of each row's hash."""
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    half = lambda k: F.bit_xor(F.conv(F.substring(F.sha2(text, 256), 15 * k + 1, 15), 16, 10).cast("long"))
    got = documents.agg(F.count("*").alias("n"), half(0).alias("a"), half(1).alias("b")).first()
    return f"{got.n}-{got.a or 0:015x}{got.b or 0:015x}"


def _stored(spark: SparkSession, path: str, kind: str) -> DataFrame | None:
    try:
        return spark.read.text(path, wholetext=True) if kind == "text" else spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def claim(spark: SparkSession, folder: str, definition: Definition) -> None:
    """Writes the definition of a new folder; OtherDefinition if it has another one."""
    found = _stored(spark, f"{folder}/definition", "text")
    if found is None:
        spark.createDataFrame([(definition.text(),)], "value string").coalesce(1).write.text(f"{folder}/definition")
        return
    there = found.first()
    if there is None or there.value.strip() != definition.text():
        raise OtherDefinition(definition.first_difference(there.value) if there else "definition")


def job_table(spark: SparkSession, folder: str) -> DataFrame | None:
    """What the folder knows of its jobs, or None."""
    return _stored(spark, f"{folder}/jobs", "parquet")


def run_jobs(
    planned: DataFrame, work: Callable[[DataFrame], DataFrame], folder: str, definition: Definition, keys: list[str] = KEYS, buckets: int = BUCKETS, at_a_time: int = AT_A_TIME,
    again: tuple[str, ...] = (), most_rounds: int | None = None,
) -> int:
    """Runs the planned jobs that are not done; the number of rounds that it took.

    work gets rows of planned and gives their keys, status (executed or failed,
    null for executed) and any other columns; a job that it gives no row for
    has failed. States of `again` are run once more. most_rounds ends the call
    early, as if it were cut off.
    """
    spark = planned.sparkSession
    claim(spark, folder, definition)
    rounds = 0
    for low in range(0, buckets, at_a_time):
        if most_rounds is not None and rounds >= most_rounds:
            break
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        mine = planned.withColumn("bucket", bucket).where(F.col("bucket").between(low, low + at_a_time - 1))
        old = job_table(spark, folder)
        if old is not None:
            old = old.where(F.col("bucket").between(low, low + at_a_time - 1))
            stays = old.where(~F.col("status").isin(*again)) if again else old
            todo = mine.join(stays.select(*keys), keys, "left_anti")
            tried = old.select(*keys, F.col("attempts").alias("_tried"))
        else:
            todo, tried, stays = mine, None, None
        done = computed_once(work(todo.drop("bucket")))
        missing = todo.select(*keys, "bucket").join(done, keys, "left")
        came = done.select(*keys, F.lit(True).alias("_came"))
        fresh = missing.join(came, keys, "left").withColumn("status", F.when(F.col("_came").isNull(), "failed").otherwise(F.coalesce("status", F.lit("executed")))).drop("_came")
        if tried is None:
            fresh = fresh.withColumn("attempts", F.lit(1))
        else:
            fresh = fresh.join(tried, keys, "left").withColumn("attempts", F.coalesce("_tried", F.lit(0)) + 1).drop("_tried")
        fresh = computed_once(fresh.withColumn("attempts", F.col("attempts").cast("int")))
        touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]  # at_a_time rows at most
        if not touched:
            continue
        rounds += 1
        rows = fresh if stays is None else computed_once(stays.where(F.col("bucket").isin(touched)).unionByName(fresh, allowMissingColumns=True))
        rows.repartition(len(touched), "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{folder}/jobs")
    return rounds


def job_states(planned: DataFrame, folder: str, keys: list[str] = KEYS) -> DataFrame:
    """Planned jobs with what the folder knows of them; a job that was not run yet is pending."""
    found = job_table(planned.sparkSession, folder)
    if found is None:
        return planned.withColumns({"status": F.lit("pending"), "attempts": F.lit(0)})
    out = planned.join(found.drop("bucket"), keys, "left")
    return out.withColumns({"status": F.coalesce("status", F.lit("pending")), "attempts": F.coalesce("attempts", F.lit(0))})
