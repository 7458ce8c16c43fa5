"""Stored JSON: reports, gold labels and manifests read back; texts, raw answers and tables written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from longwatch.functions.text import byte_prefix, safe_filename
from longwatch.operators.findings import strictly_json
from longwatch.schemas import VOCABULARIES

MAX_RAW_BYTES = 256 << 10
# The version of a manifest, and the fields that it must have.
MANIFEST_VERSION = "1"
MANIFEST_FIELDS = ("benchmark_tag", "documents", "configurations", "controls", "git_commit", "git_dirty", "jobs")
LABELS = "findings array<struct<id:string,finding_type:string,domains:array<string>,section_id_contains:string,quote_contains:string,notes:string>>"
REPORT = "schema_version string, document struct<doc_id:string,title:string>, findings array<struct<id:string,finding_type:string,title:string,severity:string>>"


def read_objects(spark: SparkSession, path: str, schema: str, needed: tuple[str, ...] = ()) -> DataFrame:
    """(path, json, value, error) of files that hold one JSON object each.

    error is invalid_json for what is no strict JSON object, else names the
    first field that is missing; value is null where there is an error. An empty
    folder gives no rows.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("json"))
    sound = strictly_json("json") & F.col("json").rlike(r"\A\s*\{")
    absent = [F.when(~F.coalesce(F.array_contains(F.json_object_keys("json"), k), F.lit(False)), f"missing {k}") for k in needed]
    error = F.when(~sound, "invalid_json").otherwise(F.coalesce(*absent, F.lit(None)))
    return files.withColumn("error", error).select("path", "json", F.when(F.col("error").isNull(), F.from_json("json", schema)).alias("value"), "error")


def read_reports(spark: SparkSession, path: str, schema: str = REPORT) -> DataFrame:
    """Stored reports under the caller's schema."""
    return read_objects(spark, path, schema, ("document", "findings"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(path, ord, id, finding_type, domains, section_id_contains, quote_contains, notes, error): gold labels in order.

    A file that cannot be read is one row with its error; a label without an id
    or of an unknown type or domain has the error invalid_field.
    """
    c = F.col
    each = read_objects(spark, path, LABELS).select("path", "error", F.posexplode_outer("value.findings").alias("ord", "l"))
    strange = F.exists(F.coalesce("l.domains", F.array().cast("array<string>")), lambda d: ~F.coalesce(d.isin(*VOCABULARIES["domain"]), F.lit(False)))
    bad = c("l.id").isNull() | ~F.coalesce(c("l.finding_type").isin(*VOCABULARIES["finding_type"]), F.lit(False)) | strange
    error = F.coalesce("error", F.when(c("ord").isNotNull() & bad, "invalid_field"))
    return each.where(c("ord").isNotNull() | c("error").isNotNull()).select("path", "ord", "l.*", error.alias("error"))


def read_manifests(spark: SparkSession, path: str, schema: str, version: str = MANIFEST_VERSION) -> DataFrame:
    """Stored manifests under the caller's schema; another version is an error."""
    found = read_objects(spark, path, schema, ("manifest_format_version", *MANIFEST_FIELDS))
    other = F.coalesce(F.get_json_object("json", "$.manifest_format_version") != version, F.lit(False))
    error = F.coalesce("error", F.when(other, "unsupported_version"))
    return found.select("path", "json", F.when(error.isNull(), F.col("value")).alias("value"), error.alias("error"))


def write_texts(texts: DataFrame, path: str, name: str = "doc_id", text: str = "text", mode: str = "error") -> None:
    """Converted texts, each under a safe file name of its own. (K3)

    Null texts are empty files' content; a name that is not safe gets a digest, so names never meet.
    """
    rows = texts.select(safe_filename(F.col(name).cast("string")).alias("name"), F.coalesce(text, F.lit("")).alias("value"))
    rows.write.mode(mode).partitionBy("name").option("lineSep", "\n").text(path)


def raw_answers(responses: DataFrame, failed: Column, most: int = MAX_RAW_BYTES) -> DataFrame:
    """Raw answers of failed requests, cut to so many bytes at a whole character, with the bytes that they had. (K4)"""
    size = F.octet_length("content").cast("long")
    return responses.where(failed).withColumns({"bytes": size, "cut": size > most, "content": byte_prefix(F.col("content"), most)})


def write_table(rows: DataFrame, path: str, kind: str = "json", mode: str = "error") -> None:
    """Rows as JSON lines, CSV with a header, or Parquet; an existing target is an error unless the mode says otherwise. (K5)"""
    if kind not in ("json", "csv", "parquet"):
        raise ValueError(f"unknown kind {kind!r}")
    writer = rows.write.mode(mode)
    if kind == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(kind).save(path)
