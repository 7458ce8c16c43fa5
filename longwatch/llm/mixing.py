"""Mixing sources to target weights: capped water-filling and seeded repetitions.

Sources share a total by weight; a source that would pass its cap (so many
epochs of its size) is clamped there and the excess is shared among the others
by weight, until none is above. A source then takes whole epochs of all its
documents and, for the rest, documents in the order of a keyed hash as long as
they fit; two further rounds fill what is left with documents small enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longwatch.llm.common import cut, read

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
SEED = 11
_ROUNDS = 3
#: A running sum over a source's documents is taken in this many parts.
_PARTS = 4096
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Adds target to (source, source_size, weight): a total of share times all sizes, capped at epochs times each size.

    Each round is one global sum; only its one row comes to the driver.
    """
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    state = sources.withColumn("clamped", F.lit(False))
    free = None
    while True:
        now = state.agg(
            F.sum(F.when(F.col("clamped"), F.col("source_size"))).alias("held"), F.sum(F.when(~F.col("clamped"), F.col("weight"))).alias("weights"),
            F.sum(F.col("clamped").cast("int")).alias("n"),
        ).first()
        if free is not None and now.n == free[2]:
            break
        free = (share * total - epochs * (now.held or 0), now.weights or 0, now.n)
        even = F.lit(free[0]) * F.col("weight") / F.lit(float(free[1] or 1))
        state = state.withColumn("clamped", F.col("clamped") | (even >= F.col("source_size") * epochs))
    even = F.lit(free[0]) * F.col("weight") / F.lit(float(free[1] or 1))
    return state.withColumn("target", F.when(F.col("clamped"), (F.col("source_size") * epochs).cast("double")).otherwise(even)).drop("clamped")


def mix(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """From (id, source, size): one row for each distinct row, with n_rows, source_size, target and repeats.

    repeats is how often each of these rows is taken. Equal rows are taken
    together. Sources go by code point with null last. A null or zero size
    takes no words. A source's taken words come as near below its target as
    its documents allow.
    """
    rows = cut(
        sizes.groupBy("id", "source", F.coalesce("size", F.lit(0)).alias("size")).agg(F.count("*").alias("n_rows"))
        .withColumn("words", F.col("size") * F.col("n_rows"))
        .withColumn("draw", _draw(seed))
    )
    sources = rows.groupBy("source").agg(F.sum("words").alias("source_size"))
    sources = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))  # one row a source
    cycle = F.array(*[F.lit(w) for w in weights])
    sources = cut(sources.withColumn("weight", F.get(cycle, (F.col("rank") - 1) % len(weights))).drop("rank"))
    goals = cut(water_fill(sources, share, epochs).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)))
    goals = goals.withColumn("left", F.floor(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    state = rows.withColumn("part", F.shiftright("draw", 48).cast("int")).withColumn("taken_at", F.lit(None).cast("int"))
    left = goals.select("source", "left")
    for k in range(_ROUNDS):
        state = _take(state, left, k)
        if k < _ROUNDS - 1:
            state = cut(state)
            used = state.where(F.col("taken_at") == k).groupBy(F.col("source").alias("s")).agg(F.sum("words").alias("used"))
            left = cut(left.join(used, F.col("source").eqNullSafe(F.col("s")), "left").select("source", (F.col("left") - F.coalesce("used", F.lit(0))).alias("left")))
    goal = goals.select(F.col("source").alias("s"), "source_size", "target", "whole")
    done = state.join(goal, F.col("source").eqNullSafe(F.col("s")))
    repeats = (F.col("whole") + F.col("taken_at").isNotNull().cast("int")).cast("long")
    return done.select("id", "source", "size", "n_rows", "source_size", "target", repeats.alias("repeats"))


def _draw(seed: int) -> Column:
    """60 bits of a keyed hash of the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _take(state: DataFrame, left: DataFrame, k: int) -> DataFrame:
    """Takes rows that fit, in the order of draw, as long as their sum does; in parts, so that no task gets a whole source."""
    left = left.select(F.col("source").alias("s"), "left")
    fits = F.col("taken_at").isNull() & (F.col("left") > 0) & (F.col("words") <= F.col("left"))
    state = state.join(left, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("add", F.when(fits, F.col("words")).otherwise(0))
    parts = state.groupBy(F.col("source").alias("s"), F.col("part").alias("p")).agg(F.sum("add").alias("sum"))
    upto = Window.partitionBy("s").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("s", "p", F.coalesce(F.sum("sum").over(upto), F.lit(0)).alias("before"))
    within = Window.partitionBy("source", "part").orderBy("draw", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    state = state.withColumn("sum", F.sum("add").over(within))
    state = state.join(parts, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    took = fits & (F.col("before") + F.col("sum") <= F.col("left"))
    return state.withColumn("taken_at", F.coalesce("taken_at", F.when(took, F.lit(k)))).drop("s", "p", "left", "add", "sum", "before")


def op2_water_filling(spark, sf_dir) -> DataFrame:
    """Words that a mix of 150 % of all words takes of each document."""
    docs = read(spark, sf_dir, "documents")
    mixed = mix(docs.select(F.col("doc_id").alias("id"), "source", word_count(F.col("text")).alias("size")))
    rows = mixed.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('11:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS draw
  FROM documents
), s AS (
  SELECT source, source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source COLLATE "binary" ASC NULLS LAST) - 1) % 3] AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)
), fill AS (
  SELECT source, source_size, weight, false AS clamped, 0 AS step, NULL::DOUBLE AS target, false AS done FROM s
  UNION ALL
  SELECT source, source_size, weight, clamped OR even >= 2 * source_size, step + 1,
         CASE WHEN clamped OR even >= 2 * source_size THEN (2 * source_size)::DOUBLE ELSE even END,
         count(*) FILTER (WHERE NOT clamped AND even >= 2 * source_size) OVER () = 0
  FROM (
    SELECT *, (1.5 * sum(source_size) OVER () - 2 * coalesce(sum(source_size) FILTER (WHERE clamped) OVER (), 0))::DOUBLE * weight
              / coalesce(sum(weight) FILTER (WHERE NOT clamped) OVER (), 1)::DOUBLE AS even
    FROM fill WHERE NOT done AND step < 1000
  )
), goals AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole
  FROM fill WHERE step > 0 AND done
), t0 AS (
  SELECT d.*, source_size, target, whole, floor(target - whole * source_size)::BIGINT AS left0
  FROM d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source
), t1 AS (
  SELECT *, size <= left0 AND sum(CASE WHEN size <= left0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY draw, doc_id ROWS UNBOUNDED PRECEDING) <= left0 AS take1
  FROM t0
), t2 AS (
  SELECT *, left0 - coalesce(sum(size) FILTER (WHERE take1) OVER (PARTITION BY source), 0) AS left1 FROM t1
), t3 AS (
  SELECT *, NOT take1 AND size <= left1 AND sum(CASE WHEN NOT take1 AND size <= left1 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY draw, doc_id ROWS UNBOUNDED PRECEDING) <= left1 AS take2
  FROM t2
), t4 AS (
  SELECT *, left1 - coalesce(sum(size) FILTER (WHERE take2) OVER (PARTITION BY source), 0) AS left2 FROM t3
), t5 AS (
  SELECT *, NOT take1 AND NOT take2 AND size <= left2 AND sum(CASE WHEN NOT take1 AND NOT take2 AND size <= left2 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY draw, doc_id ROWS UNBOUNDED PRECEDING) <= left2 AS take3
  FROM t4
)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN take1 OR take2 OR take3 THEN 1 ELSE 0 END))::BIGINT AS taken FROM t5
"""
