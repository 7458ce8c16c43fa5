"""Canonical exact fingerprints of documents.

A text is put into a canonical form (compatibility composition, case folding,
composition again, runs of white space as one space, none at the ends) and
hashed with two independent 64-bit xxhashes. Inside equal buckets the canonical
bytes are compared, those of every form that gets a fingerprint: in a bucket
that holds different texts, fingerprints have a SHA-256 of the text appended.
Only forms whose hash may occur twice are sent and compared. All of it is SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longwatch.llm.common import buckets_by_range, cut, read, shuffle_width

_SALT = "longwatch"
#: Bits of the map of hashes that occur twice: 1 MB.
_BITS = 1 << 23
#: Buckets of neighbouring documents for each shuffle partition.
_BUCKETS = 4


def canonical(text: Column) -> Column:
    """The canonical form of a text; a null is an empty text."""
    compose = lambda x: F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))
    fold = lambda x: F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), x, F.lit(True))
    form = compose(fold(compose(F.coalesce(text, F.lit("")))))
    return F.trim(F.regexp_replace(form, r"[\s\p{Z}]+", " "))


def wide_hash(form: Column, bits: int = 64) -> Column:
    """Two hashes of a canonical text; fewer bits only serve tests of what happens when they meet."""
    keep = lambda h: h if bits == 64 else F.shiftrightunsigned(h, 64 - bits)
    return F.struct(keep(F.xxhash64(form)).alias("a"), keep(F.xxhash64(F.lit(_SALT), form)).alias("b"))


def twice(hashes: DataFrame) -> Column:
    """Whether a column hash may occur twice among (hash) rows: by a bitmap of bounded size, so that most forms need not be sent.

    Where the bitmap is too small for the rows, more forms are sent than need be.
    """
    place = F.pmod(F.col("hash.a"), F.lit(_BITS)) + 1
    again = hashes.groupBy("hash").count().where("count > 1").select(F.bitmap_bucket_number(place).alias("k"), F.bitmap_bit_position(place).alias("bit"))
    maps = {r.k: bytes(r.map) for r in again.groupBy("k").agg(F.bitmap_construct_agg("bit").alias("map")).collect()}  # _BITS bits at most
    if not maps:
        return F.lit(False)
    each = 8 * len(next(iter(maps.values())))
    all_maps = F.array(*[F.lit(maps.get(k, b"")) for k in range(1, _BITS // each + 1)])
    at = F.pmod(F.col("hash.a"), F.lit(_BITS))
    byte = F.substring(F.get(all_maps, F.floor(at / each).cast("int")), F.floor(at % each / 8).cast("int") + 1, F.lit(1))
    value = F.coalesce(F.conv(F.hex(byte), 16, 10).cast("int"), F.lit(0))
    return F.floor(value / F.pow(F.lit(2), at % 8)).cast("int") % 2 == 1


def clashes(forms: DataFrame, hashes: DataFrame | None = None) -> DataFrame:
    """(hash): buckets of (hash, form) rows whose forms differ. With 128 bits there are none. hashes: those of the forms, if they are at hand."""
    buckets = forms.where(twice(forms.select("hash") if hashes is None else hashes)).groupBy("hash").agg(F.min("form").alias("low"), F.max("form").alias("high"))
    return buckets.where("low != high").select("hash")


def fingerprint(hash_: Column, digest: Column, met: Column) -> Column:
    """32 hex digits; in a clashing bucket followed by the SHA-256 of the form."""
    short = F.concat(*[F.lpad(F.lower(F.hex(hash_[k])), 16, "0") for k in ("a", "b")])
    return F.when(met, F.concat(short, F.lit("-"), digest)).otherwise(short)


def _marked(rows: DataFrame, column: str, clashing: DataFrame, met: str) -> DataFrame:
    """The rows with whether the hash in a column is of a clashing bucket."""
    return rows.join(clashing.select(F.col("hash").alias("_hash"), F.lit(True).alias(met)), F.col(column) == F.col("_hash"), "left").drop("_hash").fillna(False, [met])


def fingerprint_documents(docs: DataFrame, text_col: str = "text", bits: int = 64) -> DataFrame:
    """The given rows with fingerprint: equal just for equal canonical texts. Null texts count as empty; a column named fingerprint is replaced."""
    other = [c for c in docs.columns if c != "fingerprint"]
    form = canonical(F.col(text_col))
    clashing = clashes(docs.select(wide_hash(form, bits).alias("hash"), form.alias("form")))
    rows = docs.select(F.struct(*[docs[c] for c in other]).alias("_row"), wide_hash(form, bits).alias("_own"), F.sha2(form, 256).alias("_digest"))
    rows = _marked(rows, "_own", clashing, "_met")
    return rows.select(*[F.col("_row")[c].alias(c) for c in other], fingerprint(F.col("_own"), F.col("_digest"), F.col("_met")).alias("fingerprint"))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text): the text of the next document by doc_id, after the last that of the first.

    Ids are dealt into ranges at quantiles; the first document of each range is
    also sent to the range before, so no task gets more than its range. A null
    id comes first; rows of equal id go by a hash of their text. Null texts are
    empty.
    """
    spark = docs.sparkSession
    cuts = buckets_by_range(docs, "doc_id", shuffle_width(spark) * _BUCKETS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    cut_list = F.array(*[F.lit(c) for c in cuts]).cast("array<long>")
    bucket = F.coalesce(F.size(F.filter(cut_list, lambda c: c <= F.col("doc_id"))), F.lit(0))
    rows = rows.withColumn("bucket", bucket)
    firsts = {r.bucket: r.first for r in rows.groupBy("bucket").agg(F.min(F.struct("doc_id", "h")).alias("first")).collect()}  # one row a range
    if not firsts:
        return rows.select("doc_id", "text", F.col("text").alias("next_text"))
    there = sorted(firsts)
    before = {b: there[i - 1] for i, b in enumerate(there)}
    n = len(cuts) + 1
    at = lambda values: F.get(F.array(*values), F.col("bucket"))
    first_id = at([F.lit(firsts[b].doc_id if b in firsts else None).cast("long") for b in range(n)])
    first_h = at([F.lit(firsts[b].h if b in firsts else None).cast("long") for b in range(n)])
    home = F.struct(F.col("bucket").alias("to"), F.lit(0).alias("late"))
    also = F.struct(at([F.lit(before.get(b)).cast("int") for b in range(n)]).alias("to"), F.lit(1).alias("late"))
    leads = F.col("doc_id").eqNullSafe(first_id) & (F.col("h") == first_h)
    dealt = rows.select("doc_id", "text", "h", F.explode(F.when(leads, F.array(home, also)).otherwise(F.array(home))).alias("at"))
    dealt = dealt.select("doc_id", "text", "h", "at.*")
    order = Window.partitionBy("to").orderBy("late", F.col("doc_id").asc_nulls_first(), "h")
    return dealt.withColumn("next_text", F.lead("text").over(order)).where("late = 0").select("doc_id", "text", "next_text")


def edited_text(text: Column, following: Column) -> Column:
    """The text with its last quarter of code points replaced by the first as many of another."""
    n = F.length(text)
    tail = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - tail), F.substring(following, F.lit(1), tail))


def op9_canonical_digest(spark, sf_dir) -> DataFrame:
    """Fingerprints of every text of documents and of its edited form, each compared with all others of its bucket."""
    rows = with_next(read(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("edited", edited_text(F.col("text"), F.col("next_text")))
    kinds = ("text", "edited", "next_text")
    forms = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), *[canonical(F.col(c)).alias(c) for c in kinds])
    made = cut(forms.select("doc_id", "n_chars", "edited_sha256", *[x for c in kinds for x in (wide_hash(F.col(c)).alias(f"h_{c}"), F.sha2(c, 256).alias(f"d_{c}"))]))
    both = F.explode(F.array(F.struct(wide_hash(F.col("text")).alias("hash"), F.col("text").alias("form")), F.struct(wide_hash(F.col("edited")).alias("hash"), F.col("edited").alias("form"))))
    clashing = cut(clashes(forms.select(both.alias("_")).select("_.*"), made.select(F.explode(F.array("h_text", "h_edited")).alias("hash"))))
    for c in kinds:
        made = _marked(made, f"h_{c}", clashing, f"m_{c}")
    printed = lambda c: fingerprint(F.col(f"h_{c}"), F.col(f"d_{c}"), F.col(f"m_{c}"))
    like = lambda c: (printed("text") == printed(c)).cast("double")
    return made.select("doc_id", "n_chars", "edited_sha256", printed("text").alias("fingerprint"), printed("edited").alias("edited_fingerprint"), like("edited").alias("near_edited"), like("next_text").alias("near_next"))
