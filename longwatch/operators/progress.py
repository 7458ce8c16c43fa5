"""Counters of a run that are taken while its rows pass, without a second job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from longwatch.functions.text import estimate_tokens, public_line


def counters(text: str = "text", key: str = "doc_id") -> dict[str, Column]:
    """Sections, characters, tokens, the longest section and those that are empty."""
    size = F.length(text)
    return {
        "sections": F.count(F.lit(1)), "chars": F.coalesce(F.sum(size), F.lit(0)).cast("long"), "tokens": F.coalesce(F.sum(estimate_tokens(size)), F.lit(0)).cast("long"),
        "longest": F.max(size), "empty": F.count_if(size == 0), "without_document": F.count_if(F.col(key).isNull()),
    }


def watched(rows: DataFrame, name: str, **more: Column) -> tuple[DataFrame, Observation]:
    """The rows, and counters that an action on them fills.

    The counters are those of the first action that reads all rows; a limit
    above them would end the counting early.
    """
    seen = Observation(name)
    return rows.observe(seen, *[v.alias(k) for k, v in (counters() | more).items()]), seen


#: Lines of progress that a reader sees, by the least level that shows them: 0 quiet, 1 normal, 2 verbose, 3 debug.
LEVELS = {"quiet": 0, "normal": 1, "verbose": 2, "debug": 3}


def shown_lines(lines: DataFrame, level: str = "normal", heartbeat_seconds: float = 10.0) -> DataFrame:
    """Progress lines (unit, at, level, text) that are shown: public, of the level, and of one unit's equal lines only one in so many seconds.

    A line that says something else than the line before it in its unit is always shown.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("unit").orderBy("at", "text")
    text = public_line(F.col("text"))
    rows = lines.where(F.col("level") <= LEVELS[level]).withColumn("text", text).where(F.length("text") > 0)
    rows = rows.withColumn("_new", ~F.lag("text").over(order).eqNullSafe(F.col("text"))).withColumn("_stretch", F.sum(F.col("_new").cast("int")).over(order))
    stretch = Window.partitionBy("unit", "_stretch")
    slot = F.floor((F.unix_micros("at") - F.min(F.unix_micros("at")).over(stretch)) / F.lit(int(heartbeat_seconds * 1_000_000)))
    rows = rows.withColumn("_slot", slot)
    first = F.row_number().over(Window.partitionBy("unit", "_stretch", "_slot").orderBy("at"))
    return rows.withColumn("_n", first).where("_n = 1").drop("_new", "_stretch", "_slot", "_n")
