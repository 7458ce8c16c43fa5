"""Token usage and the state of an answer, read from a provider's raw JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where each provider's answer holds its text and its counts of tokens.
FIELDS = {
    "openai": ("$.choices[0].message.content", "$.usage.prompt_tokens", "$.usage.completion_tokens"),
    "anthropic": ("$.content[*].text", "$.usage.input_tokens", "$.usage.output_tokens"),
    "gemini": ("$.candidates[0].content.parts[*].text", "$.usageMetadata.promptTokenCount", "$.usageMetadata.candidatesTokenCount"),
    "ollama": ("$.message.content", "$.prompt_eval_count", "$.eval_count"),
}
REASONING = "$.usage.completion_tokens_details.reasoning_tokens"
#: How an answer of this provider that is not "stop" is told; any other ending is a wrong shape.
ENDINGS = {"length": "truncated", "content_filter": "rejected", "tool_calls": "unexpected_output", "function_call": "unexpected_output"}


def _by_provider(provider: Column, values: dict[str, Column]) -> Column:
    out = F.lit(None)
    for name, value in values.items():
        out = F.when(F.lower(provider) == name, value).otherwise(out)
    return out


def token_usage(provider: Column, body: Column) -> Column:
    """struct(input_tokens, output_tokens, reasoning_tokens, error) of a response.

    A missing count is 0, missing reasoning tokens are null. A count that is not
    a whole number of at least 0 is the error "shape".
    """
    count = lambda path: F.get_json_object(body, path)
    given = [_by_provider(provider, {p: count(f[k]) for p, f in FIELDS.items()}) for k in (1, 2)]
    given.append(F.when(F.lower(provider) == "openai", count(REASONING)))
    wrong = F.lit(False)
    for x in given:
        wrong |= F.coalesce(~x.rlike(r"\A\d{1,18}\z"), F.lit(False))
    number = lambda x: F.when(~wrong, F.try_to_number(x, F.lit("9" * 18)).cast("long"))
    zero = lambda x: F.when(~wrong, F.coalesce(number(x), F.lit(0)).cast("long"))
    return F.struct(zero(given[0]).alias("input_tokens"), zero(given[1]).alias("output_tokens"), number(given[2]).alias("reasoning_tokens"), F.when(wrong, "shape").alias("error"))


def answer_state(provider: Column, body: Column) -> Column:
    """ok, truncated, rejected, unexpected_output or shape: whether a response ends as it should and holds a text."""
    end, refusal = F.get_json_object(body, "$.choices[0].finish_reason"), F.get_json_object(body, "$.choices[0].message.refusal")
    told = F.when(end == "stop", F.when(F.trim(refusal) != "", "shape").otherwise("ok"))
    for name, state in ENDINGS.items():
        told = told.when(end == name, state)
    text = _by_provider(provider, {p: F.get_json_object(body, f[0]) for p, f in FIELDS.items()})
    told = F.when(F.lower(provider) == "openai", told).otherwise("ok")
    return F.when(F.coalesce(told, F.lit("shape")) != "ok", F.coalesce(told, F.lit("shape"))).when(text.isNull() & F.lower(provider).isin("openai", "gemini"), "shape").otherwise("ok")
