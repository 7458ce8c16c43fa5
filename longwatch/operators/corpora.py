"""Identity of documents: which corpus an id belongs to, and its one spelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from longwatch.functions.folds import bound
from longwatch.functions.text import strip

# Corpora with the tier, whether text can be fetched, and the kind of sections.
CORPORA = (
    ("3gpp", "3GPP", 1, False, "clauses"), ("ecma", "Ecma International", 2, True, "clauses"), ("etsi", "ETSI", 1, False, "clauses"), ("generic", "Generic", 1, False, "numbered"),
    ("ieee", "IEEE", 2, False, "clauses"), ("ietf", "IETF RFC / Internet-Draft", 1, True, "numbered"), ("iso", "ISO/IEC", 2, False, "clauses"), ("itu-t", "ITU-T", 2, False, "clauses"),
    ("nist", "NIST", 2, True, "clauses"), ("oasis", "OASIS", 2, True, "clauses"), ("w3c", "W3C", 2, True, "clauses"),
)
# Other names of corpora.
ALIASES = {
    "rfc": "ietf", "internet-draft": "ietf", "i-d": "ietf", "gpp": "3gpp", "threegpp": "3gpp", "itu": "itu-t", "iso/iec": "iso", "isoiec": "iso",
    "ecma-international": "ecma", "ecmainternational": "ecma", "oasis-open": "oasis",
}
# Documents that have one pinned address, and other spellings of their ids.
PINNED = {
    "ECMA-404": "https://ecma-international.org/wp-content/uploads/ECMA-404.pdf",
    "ECMA-262": "https://ecma-international.org/wp-content/uploads/ECMA-262_17th_edition_june_2026.pdf",
    "OpenFormula": "https://docs.oasis-open.org/office/OpenDocument/v1.4/os/part4-formula/OpenDocument-v1.4-os-part4-formula.pdf",
    "OpenFormula-1.4": "https://docs.oasis-open.org/office/OpenDocument/v1.4/os/part4-formula/OpenDocument-v1.4-os-part4-formula.pdf",
    "OpenFormula-1.3": "https://docs.oasis-open.org/office/OpenDocument/v1.3/os/part4-formula/OpenDocument-v1.3-os-part4-formula.pdf",
    "SP-800-57pt1r5": "https://nvlpubs.nist.gov/nistpubs/SpecialPublications/NIST.SP.800-57pt1r5.pdf",
    "SP-800-90Ar1": "https://nvlpubs.nist.gov/nistpubs/SpecialPublications/NIST.SP.800-90Ar1.pdf",
    "FIPS-140-3": "https://nvlpubs.nist.gov/nistpubs/FIPS/NIST.FIPS.140-3.pdf",
}
SPELLINGS = {
    "ecma": {"ECMA-404": ("ecma-404", "ecma404", "404", "json"), "ECMA-262": ("ecma-262", "ecma262", "262", "ecmascript", "es2026")},
    "oasis": {
        "OpenFormula": ("openformula", "open-formula", "open formula", "odf-openformula", "odf-formula", "opendocument-part4-formula"),
        "OpenFormula-1.4": ("opendocument-v1.4-part4-formula", "openformula-1.4", "openformula 1.4"), "OpenFormula-1.3": ("openformula-1.3", "openformula 1.3"),
    },
    "nist": {
        "SP-800-57pt1r5": (
            "sp-800-57pt1r5", "sp800-57pt1r5", "nist.sp.800-57pt1r5", "nist sp 800-57 part 1 rev. 5", "nist sp 800-57 part 1 rev 5", "sp 800-57 part 1 rev. 5", "sp 800-57 part 1 rev 5",
            "sp 800-57 pt 1 r5", "sp 800-57 pt1 r5", "800-57pt1r5",
        ),
        "SP-800-90Ar1": ("sp-800-90ar1", "sp800-90ar1", "nist.sp.800-90ar1", "sp 800-90a rev. 1", "sp 800-90a rev 1", "sp 800-90a r1"),
        "FIPS-140-3": ("fips-140-3", "fips 140-3", "fips140-3", "nist.fips.140-3"),
    },
    "w3c": {"hr-time-3": ("hr-time", "hr-time-3", "high-resolution-time", "high resolution time", "hrt")},
}


def corpora(spark: SparkSession) -> DataFrame:
    """Name, tier, whether texts can be fetched and what their sections are. (C2, the common part of C10)"""
    return spark.createDataFrame(list(CORPORA), "corpus string, display_name string, tier int, fetchable boolean, sections string")


def corpus_name(name: Column) -> Column:
    """The one name of a corpus, or null."""
    key = F.lower(F.trim(name))
    key = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair]), key), key)
    return F.when(key.isin(*[c[0] for c in CORPORA]), key)


def detect_corpus(doc_id: Column) -> Column:
    """The corpus that an id looks like, or null; the order of the tests decides."""
    raw = F.trim(doc_id)
    x = F.lower(raw)
    deliverable = x.startswith("etsi") | x.rlike(r"^(ts|tr|en|es|eg|gs|gr|sr)\s+\d")
    spaced = raw.rlike(r"\b\d{3}\s+\d{3}\b") | x.startswith("etsi") | x.rlike(r"^(en|es|eg|gs|gr|sr)\b")
    return (
        F.when(x.rlike(r"^(?:rfc)?\s*\d+$") | x.startswith("draft-"), "ietf").when(deliverable & spaced, "etsi")
        .when(x.startswith("3gpp") | x.rlike(r"^(ts|tr)\s*\d{1,2}\.\d{2,4}"), "3gpp").when(x.startswith("ieee"), "ieee").when(x.startswith("itu"), "itu-t")
        .when(x.startswith("nist") | x.startswith("fips") | x.rlike(r"^sp[-\s]*800"), "nist").when(x.startswith("iso"), "iso").when(x.startswith("ecma"), "ecma")
        .when(x.startswith("w3c") | F.contains(x, F.lit("/tr/")) | x.rlike(r"^(hr-time|html|dom|fetch|url|encoding|webidl)(-\d+)?$"), "w3c")
        .when(x.startswith("oasis") | F.contains(x, F.lit("openformula")), "oasis")
    )


def _spelled(corpus: str, key: Column) -> Column:
    pairs = [(s, name) for name, own in SPELLINGS[corpus].items() for s in own]
    return F.element_at(F.create_map(*[F.lit(x) for p in pairs for x in p]), key)


def normal_id(corpus: Column, doc_id: Column) -> Column:
    """The one spelling of an id in its corpus, or null where the corpus does not know it."""
    raw = F.regexp_replace(F.trim(doc_id), r"\s+", " ")
    x = F.lower(raw)
    number = F.regexp_extract(raw, r"(?i)^(?:rfc)?[\s-]*0*(\d+)$", 1)
    ietf = (
        F.when(number != "", F.concat(F.lit("RFC"), number)).when(x.startswith("draft-"), x)
        .when(F.contains(x, F.lit(".")) | x.startswith("draft"), F.concat(F.lit("draft-"), x)).otherwise(raw)
    )
    kind = r"(?i)^(?:etsi\s+)?(ts|tr|en|es|eg|gs|gr|sr)\s+(.+)$"
    etsi = F.when(raw.rlike(kind), F.concat_ws(" ", F.lit("ETSI"), F.upper(F.regexp_extract(raw, kind, 1)), F.trim(F.regexp_extract(raw, kind, 2)))).when(x.startswith("etsi "), raw).otherwise(F.concat(F.lit("ETSI "), raw))
    spec = r"(?i)^(?:3gpp\s+)?(ts|tr|tsg|sp)\s*(\d{1,2}\.\d{2,4}(?:-\d+)?)(?:\s+v?(\d+(?:\.\d+)*))?$"
    of, version = F.upper(F.regexp_extract(raw, spec, 1)), F.regexp_extract(raw, spec, 3)
    gpp = (
        F.when(raw.rlike(spec), F.concat(F.lit("3GPP "), F.when(of.isin("TSG", "SP"), "TS").otherwise(of), F.lit(" "), F.regexp_extract(raw, spec, 2), F.when(version != "", F.concat(F.lit(" V"), version)).otherwise("")))
        .when(F.replace(raw, F.lit("."), F.lit("")).rlike(r"^\d{5}$"), F.regexp_replace(F.replace(raw, F.lit("."), F.lit("")), r"^(\d{2})(\d{3})$", "3GPP TS $1.$2"))
        .when(raw.rlike(r"^\d{1,2}\.\d{2,4}$"), F.concat(F.lit("3GPP TS "), raw)).when(x.startswith("3gpp"), raw).otherwise(F.concat(F.lit("3GPP "), raw))
    )
    short = F.lower(F.regexp_extract(raw, r"(?i)^https?://(?:www\.)?w3\.org/TR/([^/?#]+)", 1))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"^w3c ", ""), r"^tr/", ""), r"^/+|/+$", "")
    short = F.when(short != "", short).otherwise(plain)
    w3c = F.coalesce(_spelled("w3c", short), _spelled("w3c", F.replace(short, F.lit(" "), F.lit("-"))), F.when(short.rlike(r"^[a-z][a-z0-9.-]*$"), short))
    url = x.rlike(r"^https?://")
    has = lambda *marks: F.greatest(F.lit(False), *[F.contains(x, F.lit(m)) for m in marks])
    ecma = F.when(url, F.when(has("ecma-404"), "ECMA-404").when(has("262.ecma-international.org", "ecma-262", "ecma262"), "ECMA-262").otherwise("ECMA-URL")).otherwise(_spelled("ecma", F.replace(F.regexp_replace(x, r"^ecma (?=\S)", ""), F.lit(" "), F.lit(""))))
    oasis = F.when(url, F.when(has("v1.3") & has("part4-formula"), "OpenFormula-1.3").when(has("part4-formula", "openformula"), F.when(has("v1.4"), "OpenFormula-1.4").otherwise("OpenFormula")).otherwise("OASIS-URL")).otherwise(_spelled("oasis", F.regexp_replace(x, r"^oasis ", "")))
    bare = F.regexp_replace(x, r"^nist ", "")
    nist = F.when(url, F.when(has("800-57pt1r5"), "SP-800-57pt1r5").when(has("800-90ar1"), "SP-800-90Ar1").when(has("fips.140-3", "fips-140-3", "fips140-3"), "FIPS-140-3").otherwise("NIST-URL")).otherwise(F.coalesce(_spelled("nist", bare), _spelled("nist", F.replace(bare, F.lit("."), F.lit("-")))))
    own = {"ietf": ietf, "etsi": etsi, "3gpp": gpp, "w3c": w3c, "ecma": ecma, "oasis": oasis, "nist": nist}
    out = None
    for name, value in own.items():
        out = F.when(corpus == name, value) if out is None else out.when(corpus == name, value)
    return out.when(corpus == "generic", F.trim(doc_id)).otherwise(raw)


def source_url(corpus: Column, normal: Column) -> Column:
    """Where the text of a normal id is, or null."""
    pinned = F.element_at(F.create_map(*[F.lit(v) for pair in PINNED.items() for v in pair]), normal)
    return (
        F.when((corpus == "ietf") & normal.startswith("RFC"), F.concat(F.lit("https://www.rfc-editor.org/rfc/rfc"), F.substring(normal, F.lit(4), F.length(normal)), F.lit(".txt")))
        .when(corpus == "ietf", F.concat(F.lit("https://www.ietf.org/archive/id/"), normal, F.lit(".txt")))
        .when(corpus == "w3c", F.concat(F.lit("https://www.w3.org/TR/"), normal, F.lit("/"))).when(corpus.isin("ecma", "oasis", "nist"), pinned)
    )


def document_identity(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, content_sha256, char_count)."""
    return docs.select(id_col, F.sha2(text_col, 256).alias("content_sha256"), F.length(text_col).cast("long").alias("char_count"))


def first_title(docs: DataFrame, pattern: str, most_lines: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, title): the first line of the first so many that matches; the pattern's first group is the title."""
    lines = F.slice(F.split(text_col, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"), 1, most_lines)
    hits = F.filter(lines, lambda line: line.rlike(pattern))
    return docs.select(id_col, F.trim(F.regexp_extract(F.try_element_at(hits, F.lit(1)), pattern, 1)).alias("title"))


#: Where str.splitlines() ends a line.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
# By corpus, lines searched for a title of its own, the line that a title stands above, lines searched for it, how far above, and lines searched else.
TITLE_RULES = {
    "ietf": (120, r"(?i)^(abstract|status of this memo|status of memo)$", 200, 7, 80),
    "etsi": (80, r"(?i)^(scope|1 scope|1\. scope)$", 120, 9, 0),
    "3gpp": (100, r"(?i)^(1|1\.1)\s+scope\b", 150, 11, 0),
}
# How lines begin that are no title of an RFC.
RFC_HEADER = ("rfc ", "internet-draft", "internet engineering task force", "request for comments", "category:", "issn:", "updates:", "obsoletes:", "network working group")


def title_like(corpus: str, line: Column) -> Column:
    """Whether a stripped line can be a document's title."""
    low, size = F.lower(line), F.length(line)
    if corpus != "ietf":
        return (size > {"etsi": 15, "3gpp": 12}[corpus]) & ~low.startswith(corpus)
    label = F.substring_index(line, ":", 1)
    shouted = F.contains(line, F.lit(":")) & (label == F.upper(label)) & (label != F.lower(label))
    header = F.greatest(F.lit(False), *[low.startswith(p) for p in RFC_HEADER])
    return size.between(12, 200) & ~header & ~shouted & line.rlike(r"\p{L}")


def document_title(corpus: str, text: Column, normal: Column) -> Column:
    """The title of a document of one of three corpora.

    A line that says so comes first, even an empty one; then the nearest line
    above a marker that can be a title, markers in order; for RFCs then the
    first such line. Otherwise its normal id, for RFCs null. Null and empty
    texts have no lines. Only the lines that a rule looks at are split off.
    """
    labelled, _, rows, _, first = TITLE_RULES[corpus]
    return bound(head_lines(text, max(labelled, rows, first)), lambda lines: title_in(corpus, lines, normal))


def title_in(corpus: str, lines: Column, normal: Column) -> Column:
    """The same from a text's stripped lines, which several rules can share."""
    labelled, marker, rows, above, first = TITLE_RULES[corpus]
    missing = F.lit(None).cast("string") if corpus == "ietf" else normal
    said = F.try_element_at(F.filter(F.slice(lines, 1, labelled), lambda x: F.lower(x).startswith("title:")), F.lit(1))

    def over(line: Column, i: Column) -> Column:
        seen = F.slice(lines, F.greatest(i - above, F.lit(0)) + 1, F.least(i, F.lit(above)))
        near = F.filter(F.reverse(seen), lambda x: title_like(corpus, x))
        return F.when(line.rlike(marker), F.try_element_at(near, F.lit(1)))

    marked = F.try_element_at(F.array_compact(F.transform(F.slice(lines, 1, rows), over)), F.lit(1))
    plain = F.try_element_at(F.filter(F.slice(lines, 1, first), lambda x: title_like(corpus, x)), F.lit(1)) if first else missing
    return bound(said, lambda x: F.when(x.isNotNull(), F.coalesce(own_title(x), missing)).otherwise(F.coalesce(marked, plain, missing)))


def own_title(line: Column) -> Column:
    """What stands behind a line's Title:, or null if that is nothing."""
    return F.nullif(strip(F.substring(line, F.lit(len("title:") + 1), F.length(line))), F.lit(""))


# By corpus, lines searched for a title of its own, lines searched else, the least length of such a title, and how lines begin that are none.
FIRST_LINE_RULES = {
    "w3c": (80, 40, 12, ("http://", "https://", "copyright", "w3c")), **dict.fromkeys(("ecma", "oasis", "nist"), (60, 40, 12, ("http://", "https://", "copyright", "©"))),
    **dict.fromkeys(("itu-t", "ieee", "iso"), (60, 40, 20, ("http://", "https://", "copyright"))),
}
MOST_TITLE = 160


#: Lines that any rule looks at, at most.
MOST_LINES = max(*[max(a, b, c) for a, _, b, _, c in TITLE_RULES.values()], *[max(a, b) for a, b, _, _ in FIRST_LINE_RULES.values()], 80)


def head_lines(text: Column, most: int = MOST_LINES) -> Column:
    """So many first lines of a text, stripped."""
    return F.transform(F.slice(F.split(F.coalesce(text, F.lit("")), LINE_END, most + 1), 1, most), strip)


def first_line_title(corpus: str, text: Column, normal: Column) -> Column:
    """The title of a document of a corpus whose titles stand in its first lines, else its normal id.

    A line that says so comes first, even an empty one; then the first line of a
    title's length with a letter; for W3C then the first line that is no tag.
    """
    labelled, rows, _, _ = FIRST_LINE_RULES[corpus]
    return bound(head_lines(text, max(labelled, rows)), lambda lines: first_line_title_in(corpus, lines, normal))


def first_line_title_in(corpus: str, lines: Column, normal: Column) -> Column:
    """The same from a text's stripped lines, which several rules can share."""
    labelled, rows, least, no_title = FIRST_LINE_RULES[corpus]
    said = F.get(F.filter(F.slice(lines, 1, labelled), lambda x: F.lower(x).startswith("title:")), 0)
    starts = lambda x: F.greatest(F.lit(False), *[F.lower(x).startswith(p) for p in no_title])
    plain = F.get(F.filter(F.slice(lines, 1, rows), lambda x: F.length(x).between(least, MOST_TITLE) & x.rlike(r"\p{L}") & ~starts(x)), 0)
    if corpus == "w3c":
        plain = F.coalesce(plain, F.substring(F.get(F.filter(F.slice(lines, 1, 30), lambda x: (x != "") & ~x.startswith("<")), 0), 1, MOST_TITLE))
    return bound(said, lambda x: F.when(x.isNotNull(), F.coalesce(own_title(x), normal)).otherwise(F.coalesce(plain, normal)))


def generic_title(text: Column) -> Column:
    """The title that a field Title: or a Markdown heading of the first level says in the first 80 lines, or null."""
    return generic_title_in(head_lines(text, 80))


def generic_title_in(lines: Column) -> Column:
    """The same from a text's stripped lines."""
    found = F.get(F.filter(F.slice(lines, 1, 80), lambda x: x.rlike(r"(?i)\Atitle:\s*.|\A#\s+\S")), 0)
    return F.nullif(strip(F.regexp_replace(found, r"(?i)\Atitle:|\A#", "")), F.lit(""))


def parsed_documents(docs: DataFrame) -> DataFrame:
    """Documents of (doc_id, corpus, text) with normal_id, title, source_url, content_sha256 and char_count. (C11)

    Corpora without a rule for titles take the normal id; a generic document can
    be without a title.
    """
    c = F.col
    named = docs.withColumn("normal_id", normal_id(c("corpus"), c("doc_id")))
    title = c("normal_id")
    for name in TITLE_RULES:
        title = F.when(c("corpus") == name, document_title(name, c("text"), c("normal_id"))).otherwise(title)
    for name in FIRST_LINE_RULES:
        title = F.when(c("corpus") == name, first_line_title(name, c("text"), c("normal_id"))).otherwise(title)
    title = F.when(c("corpus") == "generic", generic_title(c("text"))).otherwise(title)
    return named.withColumns({"title": title, "source_url": source_url(c("corpus"), c("normal_id")), "content_sha256": F.sha2("text", 256), "char_count": F.length("text").cast("long")})
