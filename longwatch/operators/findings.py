"""Model output as findings: strict JSON, item checks, numbering, status and summaries."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from datetime import date, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longwatch.schemas import VOCABULARIES

MAX_DIGITS = 40
MAX_FLOAT_CHARS = 64
REQUIRED = ("finding_type", "title", "description", "severity", "confidence", "domains", "evidence", "machine_interpretation", "scope_relevance", "scope_rationale")
OPTIONAL = ("recommendation_level1", "time_representation", "section_id", "section_title")
REPRESENTATION = ("width_bits", "signed", "epoch_kind", "epoch", "unit", "ticks_per_second", "claimed_horizon", "rollover_behavior")
ENUMS = {"finding_type": "finding_type", "severity": "severity", "confidence": "confidence", "scope_relevance": "scope_relevance"}
_THINKING = re.compile(r"<think>.*?</think>|<thinking>.*?</thinking>", re.DOTALL | re.IGNORECASE)
_FENCE = re.compile(r"\A```(?:json)?[ \t]*\r?\n(.*?)\r?\n?```\s*\Z", re.DOTALL | re.IGNORECASE)
_QUOTES = str.maketrans({"\u201c": '"', "\u201d": '"', "\u2018": "'", "\u2019": "'"})
_TRAILING_COMMA = re.compile(r",(\s*[}\]])")


class Rejected(ValueError):
    """Why a response is refused: a class, the field, and whether asking again can help."""

    def __init__(self, kind: str, field: str = "", repairable: bool = True):
        super().__init__(kind)
        self.kind, self.field, self.repairable = kind, field, repairable


def strict_loads(text: str, unique_keys: bool = True):
    """JSON with bounded numbers, no NaN or infinity, and no key twice."""

    def whole(token: str) -> int:
        if len(token.lstrip("-")) > MAX_DIGITS:
            raise Rejected("number", repairable=False)
        return int(token)

    def real(token: str) -> float:
        value = float(token) if len(token) <= MAX_FLOAT_CHARS else math.inf
        if not math.isfinite(value):
            raise Rejected("number", repairable=False)
        return value

    def constant(_: str):
        raise Rejected("number", repairable=False)

    def pairs(items: list[tuple]) -> dict:
        out = dict(items)
        if unique_keys and len(out) < len(items):
            raise Rejected("duplicate_key", repairable=False)
        return out

    try:
        return json.loads(text, parse_int=whole, parse_float=real, parse_constant=constant, object_pairs_hook=pairs)
    except Rejected:
        raise
    except (ValueError, RecursionError):
        raise Rejected("json") from None


def findings_object(text: str) -> dict:
    """The findings object of a response: thinking dropped, one fence opened, one repair of quotes and commas tried."""
    text = _THINKING.sub("", text).strip()
    if m := _FENCE.match(text):
        text = m[1].strip()
    try:
        data = strict_loads(text)
    except Rejected as e:
        if e.kind != "json":
            raise
        data = strict_loads(_TRAILING_COMMA.sub(r"\1", text.translate(_QUOTES)))
    if not isinstance(data, dict):
        raise Rejected("root")
    if not isinstance(data.get("findings"), list):
        raise Rejected("findings")
    return data


def _text(item: dict, field: str, path: str = "", optional: bool = False) -> str | None:
    value = item.get(field)
    if optional and value is None:
        return None
    if not isinstance(value, str) or not (value.strip() or optional):
        raise Rejected("invalid_field", path + field)
    return value.strip() or None


def _token(value, vocabulary: str, field: str) -> str:
    token = value.strip().casefold() if isinstance(value, str) else None
    if token not in VOCABULARIES[vocabulary]:
        raise Rejected("invalid_field", field)
    return token


def claim_form_ok(value, precision: str) -> bool:
    """Whether a claim is written just as its precision asks. (M8)"""
    if not isinstance(value, str):
        return False
    try:
        if precision == "year":
            return bool(re.fullmatch(r"\d{4}", value)) and 1 <= int(value) <= 9999
        if precision == "month":
            return bool(re.fullmatch(r"\d{4}-(0[1-9]|1[0-2])", value)) and int(value[:4]) >= 1
        if precision == "day":
            return bool(re.fullmatch(r"\d{4}-\d{2}-\d{2}", value)) and date.fromisoformat(value) is not None
        return datetime.fromisoformat(value[:-1] + "+00:00" if value.endswith("Z") else value).tzinfo is not None
    except ValueError:
        return False


def _representation(value) -> dict | None:
    at = "time_representation"
    if value is None:
        return None
    if not isinstance(value, dict) or set(value) - set(REPRESENTATION):
        raise Rejected("invalid_field", at)
    width, signed, rate, claim = (value.get(k) for k in ("width_bits", "signed", "ticks_per_second", "claimed_horizon"))
    if width is not None and (isinstance(width, bool) or not isinstance(width, int)):
        raise Rejected("invalid_field", f"{at}.width_bits")
    if width is not None and not 1 <= width <= 256:
        raise Rejected("invalid_field", f"{at}.width_bits", repairable=False)
    if signed is not None and not isinstance(signed, bool):
        raise Rejected("invalid_field", f"{at}.signed")
    if rate is not None and (isinstance(rate, bool) or not isinstance(rate, (int, float)) or rate <= 0):
        raise Rejected("invalid_field", f"{at}.ticks_per_second")
    if claim is not None:
        if not isinstance(claim, dict) or set(claim) != {"value", "precision"} or not isinstance(claim["precision"], str):
            raise Rejected("invalid_field", f"{at}.claimed_horizon")
        precision = _token(claim["precision"], "horizon_precision", f"{at}.claimed_horizon.precision")
        if not claim_form_ok(claim["value"], precision):
            raise Rejected("invalid_field", f"{at}.claimed_horizon.value")
        claim = {"value": claim["value"], "precision": precision}
    unit = None if value.get("unit") is None else _token(value["unit"], "unit", f"{at}.unit")
    kind = None if value.get("epoch_kind") is None else _token(value["epoch_kind"], "epoch_kind", f"{at}.epoch_kind")
    out = {"width_bits": width, "signed": signed, "epoch_kind": kind, "epoch": _text(value, "epoch", f"{at}.", True), "unit": unit, "ticks_per_second": None if rate is None else float(rate),
           "claimed_horizon": claim, "rollover_behavior": _text(value, "rollover_behavior", f"{at}.", True)}
    return out if any(v is not None for v in out.values()) else None


def checked_item(item) -> dict:
    """One finding with its tokens normalised, or Rejected."""
    if not isinstance(item, dict):
        raise Rejected("not_an_object")
    for field in REQUIRED:
        if field not in item:
            raise Rejected("missing_field", field)
    if set(item) - set(REQUIRED) - set(OPTIONAL):
        raise Rejected("unexpected_field")
    out = {f: _text(item, f) for f in ("title", "description", "machine_interpretation", "scope_rationale")}
    out |= {f: _token(item[f], v, f) for f, v in ENUMS.items()}
    if not isinstance(item["domains"], list) or not item["domains"]:
        raise Rejected("invalid_field", "domains")
    out["domains"] = list(dict.fromkeys(_token(d, "domain", "domains") for d in item["domains"]))
    if not isinstance(item["evidence"], list) or not item["evidence"]:
        raise Rejected("invalid_field", "evidence")
    out["evidence"] = []
    for e in item["evidence"]:
        if not isinstance(e, dict) or set(e) - {"quote", "note"}:
            raise Rejected("invalid_field", "evidence")
        out["evidence"].append({"quote": _text(e, "quote", "evidence."), "note": _text(e, "note", "evidence.", True)})
    section = item.get("section_id")
    if section is not None and not isinstance(section, str):
        raise Rejected("invalid_field", "section_id")
    out |= {"section_id": section, "section_title": _text(item, "section_title", "", True), "recommendation_level1": _text(item, "recommendation_level1", "", True)}
    out["time_representation"] = _representation(item.get("time_representation"))
    return out


@F.pandas_udf(T.BooleanType())
def strictly_json(texts: pd.Series) -> pd.Series:
    """Whether each text is strict JSON; null for null."""

    def one(text):
        try:
            strict_loads(text)
        except Rejected:
            return False
        return True

    return texts.map(one, na_action="ignore")


FINDING = (
    "finding_type string, title string, description string, severity string, confidence string, domains array<string>, evidence array<struct<quote:string,note:string>>, machine_interpretation string, "
    "scope_relevance string, scope_rationale string, section_id string, section_title string, recommendation_level1 string, time_representation struct<width_bits:int,signed:boolean,epoch_kind:string,"
    "epoch:string,unit:string,ticks_per_second:double,claimed_horizon:struct<value:string,precision:string>,rollover_behavior:string>"
)


#: Classes of an answer that is no findings object at all; every other class is that of an item.
ENVELOPE_ERRORS = ("json", "root", "findings", "number", "duplicate_key")


def read_answers(answers: DataFrame, content: str = "content") -> DataFrame:
    """The rows with items, bad_item, error, field and repairable instead of their content.

    items: the checked findings before the first bad one, as JSON texts with ids
    F-001 and so on; bad_item: that one's place from 0, null if the answer as a
    whole cannot be read or all is well. Each content is read once.
    """

    def one(text) -> tuple:
        items: list[str] = []
        try:
            for item in findings_object(text or "")["findings"]:
                try:
                    items.append(json.dumps({"id": f"F-{len(items) + 1:03d}", **checked_item(item)}))
                except Rejected as e:
                    return items, len(items), e.kind, e.field or None, e.repairable
        except Rejected as e:
            return [], None, e.kind, e.field or None, e.repairable
        return items, None, None, None, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [one(t) for t in pdf[content]]
            cols = list(zip(*found, strict=True)) if found else [()] * 5
            yield pdf.drop(columns=content).assign(items=list(cols[0]), bad_item=pd.array(list(cols[1]), "Int32"), error=list(cols[2]), field=list(cols[3]), repairable=pd.array(list(cols[4]), "boolean"))

    rows = answers.select(*[c for c in answers.columns if c != content], content)
    schema = T.StructType(rows.drop(content).schema.fields)
    for name, kind in (("items", T.ArrayType(T.StringType())), ("bad_item", T.IntegerType()), ("error", T.StringType()), ("field", T.StringType()), ("repairable", T.BooleanType())):
        schema = schema.add(name, kind)
    return rows.mapInPandas(run, schema)


def parse_responses(responses: DataFrame) -> DataFrame:
    """(doc_id, request, findings, error, field, repairable) for (doc_id, request, content); one bad item refuses all.

    findings hold ids F-001 and so on, as an array of JSON texts in item order.
    """
    read = read_answers(responses.select("doc_id", "request", "content"))
    none = F.array().cast("array<string>")
    return read.select("doc_id", "request", F.when(F.col("error").isNull(), F.col("items")).otherwise(none).alias("findings"), "error", "field", "repairable")


def finding_rows(parsed: DataFrame) -> DataFrame:
    """One row for each finding of the accepted responses."""
    each = parsed.where("error IS NULL").select("doc_id", "request", F.posexplode("findings").alias("item", "json"))
    return each.select("doc_id", "request", "item", F.from_json("json", "id string, " + FINDING).alias("f")).select("doc_id", "request", "item", "f.*")


def bind_sections(findings: DataFrame, bindings: DataFrame) -> DataFrame:
    """Findings with their sections' canonical ids; a response with a reference outside its request is refused whole."""
    keys = ["doc_id", "request"]
    known = bindings.select(*keys, F.col("ref").alias("section_id"), F.col("id").alias("canonical_id"))
    refused = findings.where("section_id IS NOT NULL").join(known, [*keys, "section_id"], "left_anti").select(*keys).distinct()
    return findings.join(refused, keys, "left_anti").join(known, [*keys, "section_id"], "left")


def renumber(findings: DataFrame, sections: DataFrame) -> DataFrame:
    """Findings with ids in the order of their sections; unknown sections come last."""
    rank = sections.select("doc_id", F.col("id").alias("section_id"), F.col("ord").alias("_rank"))
    order = Window.partitionBy("doc_id").orderBy(F.col("_rank").asc_nulls_last(), "position")
    joined = findings.drop("id").join(rank, ["doc_id", "section_id"], "left")
    return joined.withColumn("id", F.format_string("F-%03d", F.row_number().over(order))).drop("_rank")


def assurance_status(disposition: Column, validation: Column, source_verified: Column) -> Column:
    """(V4)"""
    return (
        F.when(disposition == "rejected", "rejected").when(disposition == "accepted", "human_confirmed").when(disposition == "needs_review", "deferred")
        .when(validation == "verified", "deterministically_validated").when(source_verified, "source_verified").otherwise("candidate")
    )


# What reports call each status.
LABELS = {
    "candidate": "candidate for review", "source_verified": "source-verified candidate", "deterministically_validated": "deterministically checked candidate",
    "cross_model_supported": "cross-model supported candidate", "human_confirmed": "validated finding (human-confirmed)", "rejected": "rejected", "deferred": "deferred",
}


def assurance_label(status: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair]), status)


def counts(findings: DataFrame, column: str, vocabulary: str | None = None) -> DataFrame:
    """(ord, value, n) without zeros: in the vocabulary's order, else by name. (A2, A3, A4)"""
    sums = findings.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    if vocabulary is None:
        return sums.withColumn("ord", F.row_number().over(Window.orderBy("value")) - 1).select("ord", "value", "n")
    order = F.array_position(F.array(*map(F.lit, VOCABULARIES[vocabulary])), F.col("value")) - 1
    return sums.select(order.cast("int").alias("ord"), "value", "n")


def report_scope(findings: DataFrame) -> DataFrame:
    """Findings that a report shows, and in which part."""
    part = F.when(F.col("scope_relevance").isin("core", "supporting"), "primary").when(F.col("scope_relevance") == "incidental", "incidental")
    return findings.withColumn("part", part).where("part IS NOT NULL")
