"""Why a provider refused a request: classes of error bodies, and the texts that may be shown of failures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from longwatch.functions.text import redact_secrets

# How much of a body and of one of its fields is looked at, and which fields.
BODY_CHARS, FIELD_CHARS = 8192, 512
FIELDS = ("code", "type", "status", "param", "message")
# Names of the feature by family, and words of a supplied schema that is at fault itself.
FEATURES = {
    "openai": ("response_format", "response_format.type", "response_format.json_schema", "json_schema"),
    "gemini": ("responseschema", "response_schema", "responsemimetype", "response_mime_type", "generationconfig.responseschema", "generationconfig.responsemimetype"),
}
SCHEMA_WORDS = ("minlength", "maxlength", "pattern", "format", "minimum", "maximum", "exclusiveminimum", "exclusivemaximum", "multipleof", "minitems", "maxitems", "uniqueitems", "additionalproperties")
UNKNOWN_NAME = r"unknown\s+(?:parameter|field|name)\s*:?\s*[\"']([^\"']+)[\"']"
UNKNOWN_AT_CONFIG = r"unknown name\s+[\"']?(responseschema|response_schema|responsemimetype|response_mime_type)[\"']?\s+at\s+[\"']generation[_]?config[\"'](?!\.)"


def error_fields(body: Column) -> Column:
    """struct of the known fields of an error body, empty where it has none.

    The error is the object error, or the first of an array of them; texts and
    whole numbers count, cut to FIELD_CHARS. A body that is no JSON has none.
    """
    data = F.try_parse_json(F.substring(body, 1, BODY_CHARS))

    def field(name: str) -> Column:
        one = lambda path: F.coalesce(
            F.when(F.schema_of_variant(F.try_variant_get(data, path, "variant")).isin("STRING", "BIGINT"), F.try_variant_get(data, path, "string")), F.lit("")
        )
        kind = F.schema_of_variant(F.try_variant_get(data, "$.error", "variant"))
        return F.substring(F.when(kind.startswith("ARRAY"), one(f"$.error[0].{name}")).otherwise(one(f"$.error.{name}")), 1, FIELD_CHARS)

    return F.struct(*[field(n).alias(n) for n in FIELDS])


def _any(text: Column, *parts: str) -> Column:
    found = F.lit(False)
    for p in parts:
        found |= F.contains(text, F.lit(p))
    return found


def unsupported_feature(family: Column, fields: Column) -> Column:
    """Whether an error says without doubt that the provider does not know structured output.

    Rules in order, the first that fits decides: a defect of the schema itself,
    another parameter named, no word of unknown or unsupported, the feature's
    own parameter named, another name given as unknown, and at last the
    feature's name in the text. What is in doubt is no.
    """
    code, param, message = (F.trim(F.lower(fields["code"])), F.trim(F.lower(fields["param"])), F.lower(fields["message"]))
    bare = F.replace(message, F.lit("_"), F.lit(""))
    named_schema = _any(message, "json_schema", "responseschema", "response_schema")
    defect = (
        (code == "invalid_json_schema") | _any(message, "invalid_json_schema", "invalid schema", "invalid json schema", "unsupported keyword", "unknown keyword")
        | (_any(message, "invalid value") & named_schema) | (_any(message, "invalid property") & (_any(message, "json_schema", "response_schema") | _any(bare, "responseschema")))
        | message.rlike(r"\b(?:" + "|".join(SCHEMA_WORDS) + r")\b")
    )
    own = {k: param.isin(*v) for k, v in FEATURES.items()}
    refused = _any(message, "does not support", "not supported")
    name = F.trim(F.regexp_extract(message, UNKNOWN_NAME, 1))
    openai = (
        F.when(defect | ((param != "") & ~own["openai"]), False).when(~(_any(message, "unknown parameter", "unknown field") | refused), False).when(own["openai"], True)
        .when(name != "", name.isin(*FEATURES["openai"])).otherwise(refused & _any(message, "json_schema", "structured output"))
    )
    gemini = (
        F.when(defect | _any(message, "generation_config.response_schema", "generation_config.response_mime") | ((param != "") & ~own["gemini"]), False)
        .when(message.rlike(UNKNOWN_AT_CONFIG), True).otherwise(refused & _any(bare, "responseschema", "responsemimetype"))
    )
    return F.when(family == "openai", openai).when(family == "gemini", gemini).otherwise(F.lit(False))


def provider_label(provider: Column) -> Column:
    return F.when(F.trim(F.coalesce(provider, F.lit(""))) == "", "LLM").otherwise(redact_secrets(F.trim(provider)))


def endpoint(url: Column) -> Column:
    """Scheme, host, port and path of a provider's address, without user, query and fragment."""
    parts = r"\A([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#]*@)?([^/?#@]*)([^?#]*)"
    shown = F.concat(F.lower(F.regexp_extract(url, parts, 1)), F.lit("://"), F.lower(F.regexp_extract(url, parts, 2)), F.regexp_extract(url, parts, 3))
    return F.when(url.rlike(parts), shown).otherwise("<unparseable-url>")


def http_failure(provider: Column, status: Column, url: Column, retryable: Column, attempts: Column) -> Column:
    """What is told of a state of 400 or more; attempts null leaves them out."""
    kind = F.when(retryable, " (retryable)").otherwise(" (non-retryable)")
    tries = F.when(attempts.isNotNull(), F.concat(F.lit(" after "), attempts.cast("string"), F.lit(" attempt(s)"))).otherwise("")
    return F.concat(provider_label(provider), F.lit(" HTTP "), status.cast("string"), F.lit(" for "), endpoint(url), kind, tries)


def request_failure(provider: Column, category: Column, url: Column, retryable: Column, attempts: Column) -> Column:
    """What is told of a request that was given up."""
    kind = F.when(retryable, " (retryable)").otherwise(" (non-retryable)")
    return F.concat(provider_label(provider), F.lit(" request failed after "), attempts.cast("string"), F.lit(" attempt(s) to "), endpoint(url), F.lit(": "), category, kind)


# Classes of failures, the exit state of a command that ends with one, and whether its text may be shown.
CLASSES = {
    "invalid_model_output": (1, True), "truncated_output": (1, True), "provider_request": (1, True), "not_configured": (2, True), "budget_exceeded": (3, True), "unreliable_sections": (1, True),
    "ingest": (1, True), "recovery_limit_exhausted": (1, True), "internal": (1, False),
}


def shown_failure(kind: Column, message: Column) -> Column:
    """The text that may be shown of a failure: its own for a known class, else only its class."""
    public = F.array(*[F.lit(k) for k, (_, shown) in CLASSES.items() if shown])
    return F.when(F.array_contains(public, kind), redact_secrets(message)).otherwise("internal error")
