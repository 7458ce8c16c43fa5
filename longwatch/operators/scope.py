"""What of a document is analysed: filters, caps and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longwatch.functions.text import estimate_tokens, is_front_matter, is_index_or_acknowledgments, is_toc_blob


def apply_scope(
    sections: DataFrame, include_front_matter: bool = False, include_index_and_acknowledgments: bool = False,
    max_sections: int | None = None, max_chars: int | None = None, max_input_tokens: int | None = None,
) -> DataFrame:
    """Sections to analyse, the first trimmed to the caps, with eligible_* and whether the scope is truncated.

    Later sections stop at the first that overflows a cap. As lengths are not
    negative, that is a running sum within the cap, once the first is trimmed.
    """
    c = F.col
    keep = F.lit(True)
    if not include_front_matter:
        keep &= ~(is_front_matter(c("id"), c("title")) | is_toc_blob(c("text")))
    if not include_index_and_acknowledgments:
        keep &= ~is_index_or_acknowledgments(c("id"), c("title"))
    order = Window.partitionBy("doc_id").orderBy("ord")
    upto, whole = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("doc_id")
    rows = sections.where(keep).withColumn("_n", F.row_number().over(order))
    rows = rows.withColumn("eligible_sections", F.count("*").over(whole)).withColumn("eligible_chars", F.sum(F.length("text")).over(whole)).withColumn("eligible_tokens", F.sum(estimate_tokens(F.length("text"))).over(whole))
    cut = c("text")
    if max_chars is not None:
        cut = F.substring(cut, 1, max_chars)
    if max_input_tokens is not None:
        cut = F.when(estimate_tokens(F.length(cut)) > max_input_tokens, F.substring(cut, 1, max(1, max_input_tokens * 4))).otherwise(cut)
    rows = rows.withColumn("_full", F.length("text")).withColumn("text", F.when(c("_n") == 1, cut).otherwise(c("text")))
    fits = F.lit(True) if max_sections is None else c("_n") <= max_sections
    within = c("_n") == 1
    sums = F.lit(True)
    if max_chars is not None:
        sums &= F.sum(F.length("text")).over(upto) <= max_chars
    if max_input_tokens is not None:
        sums &= F.sum(estimate_tokens(F.length("text"))).over(upto) <= max_input_tokens
    rows = rows.withColumn("_in", fits & (within | sums))
    rows = rows.withColumn("truncated", F.bool_or(~c("_in") | (F.length("text") < c("_full"))).over(whole)).where("_in")
    return rows.withColumn("end_char", F.least(c("end_char"), c("start_char") + F.length("text")).cast("int")).drop("_n", "_in", "_full")


def scope_counters(sections: DataFrame, scoped: DataFrame) -> DataFrame:
    """By document: total, eligible and analysed sections, characters and tokens, and coverage."""
    size, tokens = F.length("text"), estimate_tokens(F.length("text"))
    total = sections.groupBy("doc_id").agg(F.count("*").alias("total_sections"), F.sum(size).alias("total_chars"))
    done = scoped.groupBy("doc_id").agg(
        *[F.first(c).alias(c) for c in ("eligible_sections", "eligible_chars", "eligible_tokens", "truncated")],
        F.count("*").alias("analyzed_sections"), F.sum(size).alias("analyzed_chars"), F.sum(tokens).alias("analyzed_tokens"),
    )
    out = total.join(done, "doc_id", "left")
    zero = {c: 0 for c in ("eligible_sections", "eligible_chars", "eligible_tokens", "analyzed_sections", "analyzed_chars", "analyzed_tokens")}
    out = out.fillna(zero).withColumn("truncated", F.coalesce("truncated", F.lit(False)))
    return out.withColumn("coverage_percent", coverage(F.col("analyzed_chars"), F.col("eligible_chars"))).withColumn("coverage_complete", ~F.col("truncated") & (F.col("eligible_sections") == F.col("analyzed_sections")))


def coverage(analyzed: Column, eligible: Column) -> Column:
    """Percent of what is eligible, 100 at most; nothing eligible is all of it."""
    share = F.least(F.lit(100.0), F.lit(100.0) * analyzed / F.when(eligible > 0, eligible))
    return F.when(analyzed.isNull() | eligible.isNull(), F.lit(None).cast("double")).when(eligible <= 0, F.when(analyzed <= 0, 100.0).otherwise(0.0)).otherwise(share)


def coverage_shares(counters: DataFrame) -> DataFrame:
    """The counters with five shares in percent: of eligible sections, characters and tokens, and of the document's.

    counters: analyzed_ and eligible_ of sections, chars and tokens, and document_chars and document_tokens.
    """
    c = F.col
    shares = {f"{k}_pct": coverage(c(f"analyzed_{k}"), c(f"eligible_{k}")) for k in ("sections", "chars", "tokens")}
    shares |= {f"{k}_pct_of_document": coverage(c(f"analyzed_{k}"), c(f"document_{k}")) for k in ("chars", "tokens")}
    return counters.withColumns(shares)


def scoped_summary(sections: DataFrame, titles: DataFrame, most: int = 40) -> DataFrame:
    """(doc_id, summary): a document's title and those of its first sections in scope.

    sections (doc_id, ord, title), titles (doc_id, title); a document without a
    title goes by its id, one without sections has no summary.
    """
    c = F.col
    lists = sections.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", F.coalesce("title", F.lit("")).alias("title"))))["title"].alias("_t"))
    named = lists.join(titles.select("doc_id", c("title").alias("_name")), "doc_id", "left")
    more = F.size("_t") - most
    tail = F.when(more > 0, F.concat(F.lit("\n... ("), more.cast("string"), F.lit(" more sections)"))).otherwise("")
    shown = F.array_join(F.slice("_t", 1, most), "\n- ")
    name = F.coalesce(F.nullif("_name", F.lit("")), c("doc_id").cast("string"))
    return named.select("doc_id", F.concat(F.lit("Title: "), name, F.lit("\nAnalyzed sections:\n- "), shown, tail).alias("summary"))
