"""Whether quoted evidence is in its source."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longwatch.functions.text import MIN_QUOTE_CHARS, SPACE, quote_form, strip

_CLOSERS = ",;:?!.)]}"
_APOSTROPHES = "'\u2018\u2019"


def contains_quote(source: Column, quote: Column) -> Column:
    """Whether the normalised quote, of 16 characters at least, is in the normalised source. (V5)"""
    form = quote_form(quote)
    return (F.length(form) >= MIN_QUOTE_CHARS) & (F.instr(quote_form(source), form) > 0)


#: Characters of a word's end or start, and of a part of a long word, by which quotes without a whole word are found.
_EDGE = 8


def _source_keys(form: Column) -> Column:
    """What a source can be found by: its words, their ends and starts, and all parts of long words."""
    words = F.array_distinct(F.split(form, " "))
    tagged = lambda tag, x: F.struct(F.lit(tag).alias("tag"), x.alias("key"))
    some = F.filter(words, lambda w: F.length(w) >= _EDGE)
    long = F.filter(words, lambda w: F.length(w) >= MIN_QUOTE_CHARS)
    parts = F.flatten(F.transform(long, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - (MIN_QUOTE_CHARS - 1)), lambda i: F.substring(w, i, F.lit(MIN_QUOTE_CHARS)))))
    return F.concat(
        F.transform(words, lambda w: tagged("word", w)), F.transform(F.array_distinct(F.transform(some, lambda w: F.right(w, F.lit(_EDGE)))), lambda w: tagged("end", w)),
        F.transform(F.array_distinct(F.transform(some, lambda w: F.left(w, F.lit(_EDGE)))), lambda w: tagged("start", w)), F.transform(F.array_distinct(parts), lambda w: tagged("part", w)),
    )


def _quote_key(form: Column) -> Column:
    """The one thing that a quote is looked up by.

    Its longest inner word, as inner words are whole words of the source and the
    outer two can be cut; of two words the end of the first or the start of the
    second, whichever is longer; of one word its first 16 characters.
    """
    words = F.split(form, " ")
    inner = F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))
    best = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    first, last = F.get(words, 0), F.get(words, 1)
    tagged = lambda tag, x: F.struct(F.lit(tag).alias("tag"), x.alias("key"))
    edge = F.when(F.length(first) >= F.length(last), tagged("end", F.right(first, F.lit(_EDGE)))).otherwise(tagged("start", F.left(last, F.lit(_EDGE))))
    return F.when(F.size(words) > 2, tagged("word", best)).when(F.size(words) == 2, edge).otherwise(tagged("part", F.left(form, F.lit(MIN_QUOTE_CHARS))))


def quote_pairs(sources: DataFrame, quotes: DataFrame) -> DataFrame:
    """(doc_id, item_id) of quotes that a source holds.

    Containment has no equal key of its own: each quote is indexed by one whole
    word, or by a piece of one where it has none. Distinct keys of a source meet
    quotes without the source, and only for the pairs left do quote and source
    come together. So every join is on equal keys.
    """
    q = quotes.select("item_id", quote_form(F.col("text")).alias("form")).where(F.length("form") >= MIN_QUOTE_CHARS)
    q = q.withColumn("k", _quote_key(F.col("form"))).select("item_id", "form", "k.tag", "k.key")
    s = sources.select("doc_id", quote_form(F.col("text")).alias("source"))
    keys = s.select("doc_id", F.explode(_source_keys(F.col("source"))).alias("k")).select("doc_id", "k.tag", "k.key")
    met = keys.join(q, ["tag", "key"]).groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "form")).alias("found"))
    held = lambda found: F.filter(found, lambda x: F.instr(F.col("source"), x["form"]) > 0)
    return s.join(met, "doc_id").select("doc_id", F.explode(held(F.col("found"))["item_id"]).alias("item_id")).distinct()


def loose_pattern(quote: Column) -> Column:
    """flexible_pattern() as a column: a pattern of the JVM for each quote, null for an empty one."""
    text = F.regexp_replace(strip(quote), rf"{SPACE}+", " ")
    word = r"[\p{L}\p{N}]"
    text = F.regexp_replace(text, r" (?=[,;:?!.)\]}])", "")
    text = F.regexp_replace(text, rf"(?<={word}) (?=['\u2018\u2019]{word})", "")
    text = F.regexp_replace(text, r"([\\^$|*+(\[{])", r"\\$1")
    text = F.regexp_replace(text, r"([,;:?!.)\]}])", rf"\\s*\\$1")
    text = F.regexp_replace(text, rf"(?<={word})(['\u2018\u2019])(?={word})", r"\\s*$1")
    # spaces of any kind stand for \s, which in the JVM knows few of them
    any_space = SPACE.replace("\\", "\\\\")
    text = F.regexp_replace(F.regexp_replace(text, " ", r"\\s+"), r"\\s([*+])", rf"{any_space}$1")
    return F.when(text != "", F.concat(F.lit("(?iu)"), text))


def quote_in(source: Column, quote: Column) -> Column:
    """Whether a source has the quote as it is or by its loose pattern."""
    needle = strip(quote)
    return F.coalesce((needle != "") & ((F.instr(source, needle) > 0) | F.rlike(source, loose_pattern(quote))), F.lit(False))


def flexible_pattern(quote: str) -> str | None:
    """A pattern for a quote whose white space may be any, also before closing marks and an apostrophe inside a word."""
    def token(i: int) -> str:
        ch = quote[i]
        inner = ch in _APOSTROPHES and 0 < i < len(quote) - 1 and quote[i + 1].isalnum() and quote[:i].rstrip()[-1:].isalnum()
        loose = ch in _CLOSERS or inner
        return (r"\s*" if loose else "") + re.escape(ch)

    quote = quote.strip()
    pieces, gap = [], False
    for i, ch in enumerate(quote):
        if ch.isspace():
            gap = True
            continue
        t = token(i)
        if gap and pieces and not t.startswith(r"\s*"):
            pieces.append(r"\s+")
        pieces.append(t)
        gap = False
    return "".join(pieces) or None


def spans(source: str, quote: str, flexible: bool = True) -> list[tuple[int, int]]:
    """Places of a quote, overlapping ones too; where none is exact, those of its flexible pattern."""
    needle = quote.strip()
    if not needle or not source:
        return []
    found = [(m.start(), m.start() + len(needle)) for m in re.finditer(f"(?={re.escape(needle)})", source)]
    if found or not flexible:
        return found
    pattern = flexible_pattern(needle)
    return [m.span() for m in re.finditer(pattern, source, re.IGNORECASE)] if pattern else []


def quote_spans(pairs: DataFrame, source: str = "source", quote: str = "quote", flexible: bool = True) -> DataFrame:
    """Adds n_spans and, where there is just one, span_start and span_end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [spans(s or "", q or "", flexible) for s, q in zip(pdf[source], pdf[quote], strict=True)]
            one = [f[0] if len(f) == 1 else (None, None) for f in found]
            yield pdf.assign(n_spans=list(map(len, found)), span_start=pd.array([o[0] for o in one], "Int32"), span_end=pd.array([o[1] for o in one], "Int32"))

    schema = pairs.select("*").schema.add("n_spans", "integer").add("span_start", "integer").add("span_end", "integer")
    return pairs.mapInPandas(run, schema)


def verify_sources(evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """By finding: source_verified and a detail.

    evidence (doc_id, finding_id, section_id, quote), sources (doc_id,
    section_id, text); a missing section is an empty source.
    """
    c = F.col
    form = F.coalesce(quote_form(c("quote")), F.lit(""))
    asked = evidence.select("doc_id", "section_id", F.struct("finding_id", form.alias("form")).alias("q")).groupBy("doc_id", "section_id").agg(F.collect_list("q").alias("_asked"))
    # a section's text is joined and searched once for all that is asked of it
    joined = asked.join(sources.select("doc_id", "section_id", quote_form(c("text")).alias("_source")), ["doc_id", "section_id"], "left").withColumn("_source", F.coalesce("_source", F.lit("")))
    told = F.transform("_asked", lambda q: F.struct(
        q["finding_id"].alias("finding_id"), (q["form"] != "").alias("_some"), (F.length(q["form"]) >= MIN_QUOTE_CHARS).alias("_long"),
        ((F.length(q["form"]) >= MIN_QUOTE_CHARS) & (F.instr(c("_source"), q["form"]) > 0)).alias("_hit"),
    ))
    rows = joined.select("doc_id", F.length("_source").alias("_chars"), F.explode(told).alias("t")).select("doc_id", "_chars", "t.*")
    sums = rows.groupBy("doc_id", "finding_id").agg(F.count_if("_some").alias("quotes"), F.max("_chars").alias("chars"), F.count_if(c("_some") & c("_long")).alias("considered"), F.count_if("_hit").alias("matched"))
    detail = (
        F.when(c("quotes") == 0, "No evidence quotes to verify against source.")
        .when(c("chars") == 0, "Analyzed document text is empty; cannot verify evidence quotes.")
        .when(c("considered") == 0, f"Evidence quotes shorter than {MIN_QUOTE_CHARS} characters after normalization; skipped source check.")
        .otherwise(F.format_string("Matched %d of %d evidence quote(s) in analyzed document text.", "matched", "considered"))
    )
    return sums.select("doc_id", "finding_id", (c("matched") > 0).alias("source_verified"), detail.alias("detail"))


def to_document_offset(document: Column, section: Column, section_start: Column, at: Column) -> Column:
    """An offset in the document, if the document has the section's text at its start."""
    same = F.substring(document, section_start + 1, F.length(section)) == section
    return F.when(same, section_start + at)
