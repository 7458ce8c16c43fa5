"""Model prices and policies as small broadcast tables, and cost expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from longwatch.functions.text import REQUEST_OVERHEAD_TOKENS

# Indicative list prices, USD per million tokens, in table order.
PRICES = (
    ("openai", "gpt-4.1-mini", 0.40, 1.60),
    ("openai", "gpt-4.1", 2.00, 8.00),
    ("anthropic", "claude-sonnet-4-5", 3.00, 15.00),
    ("anthropic", "claude-haiku-4-5", 1.00, 5.00),
    ("gemini", "gemini-3.6-flash", 1.50, 7.50),
    ("gemini", "gemini-3.5-flash", 1.50, 9.00),
    ("gemini", "gemini-3.5-flash-lite", 0.30, 2.50),
    ("gemini", "gemini-2.5-flash", 0.30, 2.50),
    ("gemini", "gemini-2.5-pro", 1.25, 10.00),
)
# The model whose price depends on a request's input tokens.
TIERED = {"provider": "openai", "model": "gpt-6-luna", "input": 0.10, "output": 0.50, "long_input": 0.20, "long_output": 0.75, "threshold": 272_000}
# Context windows by provider, and the models that have their own.
WINDOWS = {"openai": 1_000_000, "anthropic": 200_000, "gemini": 1_000_000}
OWN_WINDOWS = {("openai", "gpt-6-luna"): 1_050_000}
DEFAULT_WINDOW = 128_000
PLANNED_OUTPUT_PER_SECTION = 1500
WHOLE_DOCUMENT_OUTPUT = 4096


def price_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *p) for i, p in enumerate(PRICES)], "price_ord int, price_provider string, price_model string, input_rate double, output_rate double")


def with_prices(models: DataFrame) -> DataFrame:
    """Adds input_rate and output_rate to (provider, model) rows: exact, else the first table row that the model starts with."""
    models = models.withColumn("_row", F.monotonically_increasing_id())
    p = F.broadcast(price_table(models.sparkSession))  # 9 rows
    m = F.lower("model")
    found = models.join(p, (F.lower("provider") == F.col("price_provider")) & m.startswith(F.col("price_model")), "left")
    first = Window.partitionBy("_row").orderBy(F.coalesce(F.lower("model") != F.col("price_model"), F.lit(True)), "price_ord")
    return found.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_row", "price_ord", "price_provider", "price_model")


def is_tiered(provider: Column, model: Column) -> Column:
    return (F.lower(provider) == TIERED["provider"]) & (F.lower(model) == TIERED["model"])


def rates(provider: Column, model: Column, tokens: Column, input_rate: Column, output_rate: Column) -> tuple[Column, Column]:
    """Input and output rates of one request."""
    tiered, long = is_tiered(provider, model), tokens > TIERED["threshold"]
    pick = lambda a, b, c: F.when(tiered & long, F.lit(TIERED[a])).when(tiered, F.lit(TIERED[b])).otherwise(c)
    return pick("long_input", "input", input_rate), pick("long_output", "output", output_rate)


def raw_cost(tokens_in: Column, tokens_out: Column, rate_in: Column, rate_out: Column) -> Column:
    """Unrounded USD of one request, null without a price."""
    return tokens_in / F.lit(1_000_000) * rate_in + tokens_out / F.lit(1_000_000) * rate_out


def round_places(x: Column, places: int) -> Column:
    """So many places as the exact binary value rounds, halves to even; the built-in rounds the decimal text. (H3)

    A product with a power of ten is taken with its error, which a fused
    multiply-add gives exactly, so that it is known on which side of a half it
    is. Values from 2**52 units of the last place on stay as they are.
    """
    unit = F.lit(10.0**places)
    scaled = x * unit
    error = F.java_method(F.lit("java.lang.Math"), F.lit("fma"), x, unit, -scaled).cast("double")
    near = F.rint(scaled)
    rest = scaled - near
    whole = F.when((rest == 0.5) & (error > 0), near + 1).when((rest == -0.5) & (error < 0), near - 1).otherwise(near)
    return F.when(x.isNull() | F.isnan(x), None).when(F.abs(scaled) >= 2.0**52, x).otherwise(whole / unit)


def round6(x: Column) -> Column:
    """Six places, as round_places rounds. (H3)"""
    return round_places(x, 6)


def pricing_tier(provider: Column, model: Column, tokens: Column, input_rate: Column) -> Column:
    """(M19)"""
    return (
        F.when(is_tiered(provider, model) & (tokens > TIERED["threshold"]), "luna_long").when(is_tiered(provider, model), "luna_short")
        .when(input_rate.isNull(), "unknown").otherwise("table")
    )


# How tiers are told.
TIER_LABELS = {"luna_long": "GPT-6 Luna long-context rates", "luna_short": "GPT-6 Luna short-context rates", "table": "indicative table rates"}


def pricing_line(tiers: Column, provider: Column, model: Column) -> Column:
    """How many requests use which rates, from the tiers of a plan's requests in order; an unknown one tells that alone."""
    labels = F.create_map(*[F.lit(x) for kv in TIER_LABELS.items() for x in kv])
    count = lambda t: F.size(F.filter(tiers, lambda x: x == t))
    part = F.transform(F.array_distinct(tiers), lambda t: F.concat(count(t).cast("string"), F.when(count(t) == 1, " request uses ").otherwise(" requests use "), F.element_at(labels, t)))
    unknown = F.concat(F.lit("pricing: USD estimate unavailable (no table entry for "), provider, F.lit(":"), model, F.lit(")"))
    return F.when(F.array_contains(tiers, "unknown"), unknown).when(F.size(tiers) > 0, F.concat(F.lit("pricing: "), F.array_join(part, "; ")))


def context_window(provider: Column, model: Column) -> Column:
    """(M21)"""
    out = None
    for (p, m), n in OWN_WINDOWS.items():
        hit = (F.lower(provider) == p) & (F.lower(model) == m)
        out = F.when(hit, n) if out is None else out.when(hit, n)
    for p, n in WINDOWS.items():
        out = out.when(F.lower(provider) == p, n)
    return out.otherwise(DEFAULT_WINDOW)


def request_input_tokens(content_tokens: Column) -> Column:
    return F.greatest(content_tokens, F.lit(0)) + REQUEST_OVERHEAD_TOKENS


def planned_output(sections: Column, most: Column) -> Column:
    return F.when(sections <= 0, 0).otherwise(F.least(most, sections * PLANNED_OUTPUT_PER_SECTION))


def reasoning_effort(provider: Column, model: Column, requested: Column) -> tuple[Column, Column]:
    """(effort to record, error): only the tiered model takes an effort."""
    token = F.lower(F.trim(requested))
    able = is_tiered(provider, model)
    known = token.isin("none", "low", "medium", "high", "xhigh", "max")
    error = F.when(requested.isNotNull() & (token == ""), "empty").when(requested.isNotNull() & ~able, "unsupported").when(requested.isNotNull() & ~known, "unknown")
    return F.when(error.isNull() & able, F.coalesce(token, F.lit("none"))), error
