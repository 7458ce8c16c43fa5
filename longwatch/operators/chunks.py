"""Packing adjacent sections into bounded requests, and the requests' text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longwatch.functions.folds import gathered
from longwatch.functions.text import REQUEST_OVERHEAD_TOKENS, estimate_tokens, section_ref

SECTIONS_PER_REQUEST = 8
MAX_OUTPUT_TOKENS = 16384


def _digits(n: Column) -> Column:
    return F.length(n.cast("string"))


def body_chars(title_chars: Column, text_chars: Column) -> Column:
    """Characters of one section's record in a request's body."""
    return F.lit(len("--- SECTION ref=S0001 ---\nsection_title: \ntext:\n\n--- END SECTION ref=S0001 ---")) + title_chars + text_chars


def envelope_tokens(body: Column, sections: Column, head_chars: Column) -> Column:
    """Input tokens of a request: its envelope around so many characters of records, and the shared overhead.

    head_chars: characters of document id, title and summary.
    """
    frame = len("UNTRUSTED_DATA kind=section_chunk chars=\ndocument_id: \ntitle: \nsection_summary: \nsection_count: \ntext:\n\nUNTRUSTED_DATA_END chars=")
    return estimate_tokens(F.lit(frame) + head_chars + body + 2 * _digits(body) + _digits(sections)) + REQUEST_OVERHEAD_TOKENS


def pack(sections: DataFrame, window: int, max_output: int = MAX_OUTPUT_TOKENS, cap: int = SECTIONS_PER_REQUEST, head_chars: Column | None = None, chunking: bool = True) -> DataFrame:
    """Sections of (doc_id, ord, id, title, text) with ref, chunk_index and the error of one that fits no request.

    Greedy and in order: a section that would pass the cap or the context window
    starts a new request; a request that fills the window exactly fits. The
    state starts anew with each request, which no window function can do, so it
    is folded over the sections' sizes by document.
    """
    if cap < 1:
        raise ValueError("cap must be 1 at least")
    c = F.col
    head = F.lit(0) if head_chars is None else head_chars
    # references have four digits up to 9999 and more beyond: counted twice in a record
    longer = 2 * F.greatest(_digits(c("n")) - 4, F.lit(0))
    rows = sections.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))).withColumn("ref", section_ref(c("n")))
    rows = rows.withColumn("size", (body_chars(F.length("title"), F.length("text")) + longer).cast("long"))
    sizes = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("n", "size"))).alias("s"), F.max(head).alias("head"))
    start = {"chunk": F.lit(-1).cast("long"), "count": F.lit(0).cast("long"), "body": F.lit(0).cast("long")}

    def step(a: Column, x: Column) -> tuple[dict[str, Column], Column, Column]:
        joined = a["body"] + 1 + x["size"]
        full = (a["count"] >= (cap if chunking else 1)) | (envelope_tokens(joined, a["count"] + 1, c("head")) + max_output > window)
        new = (a["count"] == 0) | full
        chunk = F.when(new, a["chunk"] + 1).otherwise(a["chunk"])
        return {"chunk": chunk, "count": F.when(new, F.lit(1)).otherwise(a["count"] + 1).cast("long"), "body": F.when(new, x["size"]).otherwise(joined)}, F.lit(True), chunk

    folded = sizes.select("doc_id", F.posexplode(gathered(c("s"), start, step, "bigint")).alias("k", "chunk_index")).withColumn("n", c("k") + 1)
    alone = envelope_tokens(c("size"), F.lit(1), head) + max_output > window
    out = rows.join(folded.select("doc_id", "n", "chunk_index"), ["doc_id", "n"])
    return out.withColumn("error", F.when(alone, "oversized_section")).drop("n", "size")


def requests(packed: DataFrame, max_output: int = MAX_OUTPUT_TOKENS, head_chars: Column | None = None) -> DataFrame:
    """One row for each request: its references, section ids, and input and output tokens."""
    c = F.col
    head = F.lit(0) if head_chars is None else head_chars
    size = body_chars(F.length("title"), F.length("text")) + 2 * F.greatest(F.length("ref") - 5, F.lit(0))
    rows = packed.groupBy("doc_id", "chunk_index").agg(
        F.sort_array(F.collect_list(F.struct("ord", "ref", "id"))).alias("s"), F.count("*").alias("sections"), (F.sum(size) + F.count("*") - 1).alias("body"), F.max(head).alias("head"),
    )
    tokens = envelope_tokens(c("body"), c("sections"), c("head"))
    return rows.select("doc_id", "chunk_index", c("s.ref").alias("opaque_refs"), c("s.id").alias("section_ids"), "sections", tokens.alias("est_in"), F.least(F.lit(max_output), 1500 * c("sections")).cast("long").alias("est_out"))


def request_text(packed: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, text): the envelope that a request sends."""
    c = F.col
    record = F.concat_ws("\n", F.concat(F.lit("--- SECTION ref="), c("ref"), F.lit(" ---")), F.concat(F.lit("section_title: "), c("title")), F.lit("text:"), c("text"), F.concat(F.lit("--- END SECTION ref="), c("ref"), F.lit(" ---")))
    rows = packed.withColumn("record", record).groupBy("doc_id", "chunk_index").agg(F.sort_array(F.collect_list(F.struct("ord", "record"))).alias("r"))
    body = F.array_join("r.record", "\n")
    count = F.length(body).cast("string")
    head = [F.concat(F.lit("UNTRUSTED_DATA kind=section_chunk chars="), count), F.concat(F.lit("document_id: "), c("doc_id").cast("string")), F.lit("title: "), F.lit("section_summary: ")]
    return rows.select("doc_id", "chunk_index", F.concat_ws("\n", *head, F.concat(F.lit("section_count: "), F.size("r").cast("string")), F.lit("text:"), body, F.concat(F.lit("UNTRUSTED_DATA_END chars="), count)).alias("text"))


def request_views(packed: DataFrame, max_output: int = MAX_OUTPUT_TOKENS) -> DataFrame:
    """Requests with their number from 1 and the span of the text that they hold.

    packed: sections of pack() with start_char and end_char.
    """
    spans = packed.groupBy("doc_id", "chunk_index").agg(F.min_by("start_char", "ord").alias("start_char"), F.max_by("end_char", "ord").alias("end_char"))
    each = requests(packed, max_output).join(spans, ["doc_id", "chunk_index"])
    return each.withColumn("index", F.col("chunk_index") + 1)


def input_range(views: DataFrame) -> DataFrame:
    """(doc_id, requests, lowest, highest, line): input tokens of a plan's requests, and the line that tells them."""
    rows = views.groupBy("doc_id").agg(F.count("*").alias("requests"), F.min("est_in").alias("lowest"), F.max("est_in").alias("highest"))
    low, high = (F.format_number(k, 0) for k in ("lowest", "highest"))
    between = F.when(F.col("lowest") == F.col("highest"), low).otherwise(F.concat_ws(" to ", low, high))
    return rows.withColumn("line", F.concat(F.lit("estimated input/request: "), between, F.lit(" tokens")))


def halves(items: Column) -> tuple[Column, Column]:
    """A list cut in two, the first half the shorter."""
    k = F.floor(F.size(items) / 2).cast("int")
    return F.slice(items, F.lit(1), k), F.slice(items, k + 1, F.size(items) - k)
