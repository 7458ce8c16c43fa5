"""The plan of a scan: every document under every model configuration, costed, before any model is asked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longwatch.functions.pricing import WHOLE_DOCUMENT_OUTPUT, context_window, rates, raw_cost, request_input_tokens, round6, with_prices
from longwatch.functions.text import REQUEST_OVERHEAD_TOKENS, estimate_tokens
from longwatch.operators.bench import short_list
from longwatch.operators.chunks import MAX_OUTPUT_TOKENS, SECTIONS_PER_REQUEST, pack, requests
from longwatch.operators.scope import apply_scope
from longwatch.operators.segment import parse_health

# The default configurations of a matrix.
CONFIGS = (("openai-mini", "openai", "gpt-4.1-mini"), ("openai-luna", "openai", "gpt-6-luna"), ("anthropic-sonnet", "anthropic", "claude-sonnet-4-5"), ("gemini-flash", "gemini", "gemini-3.6-flash"))


def configs(spark: SparkSession, rows: tuple = CONFIGS, max_output: int = MAX_OUTPUT_TOKENS) -> DataFrame:
    """(config_id, provider, model, window, max_output, rates) of the configurations."""
    given = spark.createDataFrame(list(rows), "config_id string, provider string, model string")
    priced = with_prices(given)
    return priced.withColumn("window", context_window(F.col("provider"), F.col("model"))).withColumn("max_output", F.lit(max_output))


def document_modes(docs: DataFrame, models: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, config_id, tokens, mode): whole if the tokens fit what window, reserve and overhead leave."""
    sized = docs.select("doc_id", estimate_tokens(F.length(text_col)).alias("tokens"))
    room = F.col("window") - F.col("max_output") - REQUEST_OVERHEAD_TOKENS
    whole = (room > 0) & (F.col("tokens") <= room)
    return sized.crossJoin(short_list(models)).withColumn("mode", F.when(whole, "whole_document").otherwise("section_aware"))


def request_costs(modes: DataFrame) -> DataFrame:
    """Adds input_tokens, output_tokens and raw_usd of one request for a whole document."""
    tokens = request_input_tokens(F.col("tokens"))
    rate_in, rate_out = rates(F.col("provider"), F.col("model"), tokens, F.col("input_rate"), F.col("output_rate"))
    out = F.lit(WHOLE_DOCUMENT_OUTPUT)
    return modes.withColumn("input_tokens", tokens).withColumn("output_tokens", out.cast("long")).withColumn("raw_usd", raw_cost(tokens, out, rate_in, rate_out))


def plan_sections(
    sections: DataFrame, models: DataFrame, window: int, max_output: int = MAX_OUTPUT_TOKENS, cap: int = SECTIONS_PER_REQUEST, max_cost_usd: float | None = None, max_tokens: int | None = None, **scope,
) -> DataFrame:
    """(doc_id, config_id, requests, tokens, usd, within_budget, error): a section-aware plan with its budget.

    Each request is priced on its own and rounded, and so is their sum. An
    unhealthy split or a section that fits no request is an error of the row.
    """
    packed = pack(apply_scope(sections, **scope), window, max_output, cap)
    each = requests(packed, max_output).crossJoin(short_list(models))
    rate_in, rate_out = rates(F.col("provider"), F.col("model"), F.col("est_in"), F.col("input_rate"), F.col("output_rate"))
    each = each.withColumn("usd", round6(raw_cost(F.col("est_in"), F.col("est_out"), rate_in, rate_out)))
    sums = each.groupBy("doc_id", "config_id").agg(
        F.count("*").alias("requests"), F.sum("est_in").alias("input_tokens"), F.sum("est_out").alias("output_tokens"),
        F.when(F.count("usd") == F.count("*"), F.sum("usd")).alias("usd"),
    ).withColumn("usd", round6(F.col("usd")))
    errors = packed.groupBy("doc_id").agg(F.max("error").alias("oversized")).join(parse_health(sections).select("doc_id", "ok"), "doc_id", "left")
    error = F.coalesce(F.when(~F.col("ok"), "unreliable_sections"), F.col("oversized"))
    out = sums.join(errors, "doc_id", "left").withColumn("error", error).drop("oversized", "ok")
    over = F.lit(False)
    if max_tokens is not None:
        over |= F.col("input_tokens") + F.col("output_tokens") > max_tokens
    if max_cost_usd is not None:
        over |= F.coalesce(F.col("usd") > max_cost_usd, F.lit(False))
    return out.withColumn("within_budget", ~over)
