"""Text expressions: token estimates, heading and front-matter predicates, quote normalisation, redaction, escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from longwatch.functions.folds import bound

CHARS_PER_TOKEN = 4
REQUEST_OVERHEAD_TOKENS = 6000
MIN_QUOTE_CHARS = 16

#: White space as Python's str methods see it, for regular expressions of the JVM.
SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
SOLID = r"[^\s\x0B\x1C-\x1F\x85\p{Z}]"


def estimate_tokens(chars: Column) -> Column:
    """Tokens of so many characters: four characters are a token, and any text is one at least."""
    return F.when(chars <= 0, F.lit(0)).otherwise(F.ceil(chars / CHARS_PER_TOKEN)).cast("long")


def strip(text: Column) -> Column:
    return F.regexp_extract(text, rf"(?s)\A{SPACE}*+(.*{SOLID})", 1)


def quote_form(text: Column) -> Column:
    """Case-folded text with runs of white space as one space."""
    fold = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    return strip(F.regexp_replace(fold, rf"{SPACE}+", " "))


# What a table-of-contents line and a section to skip look like.
TOC_TAB = r"\t\d{1,4}\s*$"
TOC_DOTS = r"\.{2,}\s*\d{1,4}\s*$"
TOC_SPACED = r"(?i)^(?:(?:Clause|Section)\s+)?\d+(?:\.\d+)*\.?\s+\S.*\s{2,}\d{1,4}\s*$"
FRONT_IDS = ("preamble", "toc", "front_matter", "contents")
FRONT_TITLES = ("preamble", "contents", "table of contents", "front matter")
INDEX_TITLE = r"(?i)^index(?:\s+of\s+.+)?$"
ACK_TITLE = r"(?i)^acknowledg(?:e)?ments?(?:\s+and\s+.+)?$"
ACK_TAILS = ("acknowledgement", "acknowledgements", "acknowledgment", "acknowledgments")


def is_toc_line(line: Column) -> Column:
    """Whether a line is an entry of a table of contents."""
    return bound(strip(line), is_stripped_toc_line)


def is_stripped_toc_line(line: Column) -> Column:
    """Entries end with a digit, which is asked first."""
    spaced = line.rlike(TOC_SPACED) & ~F.lower(line).startswith("annex")
    return line.rlike(r"\d\s*$") & (line.rlike(TOC_TAB) | line.rlike(TOC_DOTS) | spaced)


def is_front_matter(id_: Column, title: Column) -> Column:
    """(F1)"""
    title = F.lower(title)
    return F.lower(id_).isin(*FRONT_IDS) | title.isin(*FRONT_TITLES) | title.startswith("contents")


def is_toc_blob(text: Column, least: int = 8) -> Column:
    """Whether at least half of a section's lines, and so many, are entries of a table of contents. (F2)"""
    lines = F.filter(F.split(text, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"), lambda x: F.length(strip(x)) > 0)
    hits = F.size(F.filter(lines, is_toc_line))
    return (hits >= least) & (hits * 2 >= F.size(lines))


def is_index_or_acknowledgments(id_: Column, title: Column) -> Column:
    """(F3)"""
    tail = F.element_at(F.split(F.replace(F.lower(strip(id_)), F.lit("_"), F.lit("-")), "-"), -1)
    title = F.regexp_replace(strip(title), rf"{SPACE}+", " ")
    return (tail == "index") | tail.isin(*ACK_TAILS) | title.rlike(INDEX_TITLE) | title.rlike(ACK_TITLE)


def section_ref(n: Column) -> Column:
    """(P9)"""
    return F.format_string("S%04d", n)


def redacted(text: Column) -> Column:
    """A stand-in for text that must not be logged. (F8)"""
    return F.concat(F.lit("<redacted len="), F.length(text).cast("string"), F.lit(">"))


# Fixed values: (pattern, replacement) for secrets in messages, applied in order, then controls, and URLs without user, query and fragment.
SECRETS = (
    (r"(?i)(Authorization\s*:\s*Bearer\s+)(\S+)", "$1[REDACTED]"),
    (r"(?i)(Bearer\s+)(\S+)", "$1[REDACTED]"),
    (r"(?i)((?:api[_-]?key|x-api-key|access[_-]?token)\s*[:=]\s*)([^\s,\"'}]+)", "$1[REDACTED]"),
    (r"\b(sk-[A-Za-z0-9_-]{8,})\b", "[REDACTED]"),
    (r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " "),
    (r"(https?://)(?:[^\s/?#]*@)?([^\s/?#]*[^\s?#]*)[?#]?\S*", "$1$2"),
)


def redact_secrets(text: Column) -> Column:
    """Without authorization headers, bearer tokens, keys, control characters and the private parts of URLs."""
    for pattern, put in SECRETS:
        text = F.regexp_replace(text, pattern, put)
    return text


def public_line(text: Column) -> Column:
    """One printable line: no terminal escapes, controls or direction marks."""
    text = F.regexp_replace(text, r"\x1B(?:\[[0-?]*[ -/]*[@-~]|\][^\x07]*(?:\x07|\x1B\\)|.)", "")
    text = F.regexp_replace(text, r"[\u200E\u200F\u202A-\u202E\u2066-\u2069]", "")
    return strip(F.regexp_replace(text, r"[\p{Cc}\s]+", " "))


def escape_markdown(text: Column) -> Column:
    """One line of text that Markdown shows as it is."""
    text = F.regexp_replace(text, r"[\p{Cc}\u2028\u2029]+", " ")
    text = F.regexp_replace(text, r"([\\`*_\[\]{}<>|~#!&])", r"\\$1")
    return F.regexp_replace(text, r"^([ ]*)([-+=]|\d+[.)])", r"$1\\$2")


#: Controls, and marks that turn the direction of text, which are shown by their code points.
_UNSEEN = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\u202A-\u202E\u2066-\u2069]"
_VERTICAL = r"[\n\x0B\x0C\r\x85\u2028\u2029\t]"


def visible(text: Column) -> Column:
    """Unseen characters as \\u and four digits."""
    shown = F.transform(F.split(text, ""), lambda ch: F.when(ch.rlike(_UNSEEN), F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(F.ascii(ch))), 4, "0"))).otherwise(ch))
    return F.when(text.rlike(_UNSEEN), F.array_join(shown, "")).otherwise(text)


def longest_run(text: Column, mark: str) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit(f"({mark}+)"), 1), F.length)), F.lit(0))


def inline_code(text: Column) -> Column:
    """A text in backticks, more than any run of it has, on one line; with over 32 it is escaped instead."""
    line = F.regexp_replace(visible(text), _VERTICAL, " ")
    n = longest_run(line, "`") + 1
    edge = (line == "") | line.rlike(r"\A[` ]|[` ]\z")
    marks = F.repeat(F.lit("`"), n)
    return F.when(n > 32, escape_markdown(text)).otherwise(F.concat(marks, F.when(edge, F.concat(F.lit(" "), line, F.lit(" "))).otherwise(line), marks))


def markdown_fence(text: Column) -> Column:
    """A block between fences longer than any run of their character in the text: of tildes if it has shorter runs of these."""
    text = F.regexp_replace(visible(text), r"\r\n|[\r\x85\u2028\u2029]", "\n")
    text = F.regexp_replace(text, r"\n\z", "")
    ticks, tildes = longest_run(text, "`"), longest_run(text, "~")
    fence = F.repeat(F.when(tildes < ticks, "~").otherwise("`"), F.greatest(F.lit(3), F.least(ticks, tildes) + 1))
    return F.concat_ws("\n", fence, text, fence)


def slug(text: Column, most: int = 80) -> Column:
    """A file-name part of safe characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "-"), r"^[-.]+|[-.]+$", ""), 1, most)


def safe_filename(raw: Column) -> Column:
    """The name if it is safe, else its safe characters and 12 digits of its SHA-256. (K6)"""
    safe = raw.rlike(r"\A[A-Za-z0-9][A-Za-z0-9._-]{0,119}\z") & ~raw.rlike(r"(?i)\A(con|prn|aux|nul|com\d|lpt\d)(\..*)?\z") & ~raw.endswith(".")
    base = F.regexp_replace(F.substring(F.regexp_replace(raw, r"[^A-Za-z0-9._-]+", "_"), 1, 100), r"\A[._-]+|[._-]+\z", "")
    return F.when(safe, raw).otherwise(F.concat_ws("-", F.when(base != "", base).otherwise("unnamed"), F.substring(F.sha2(raw, 256), 1, 12)))


def byte_prefix(text: Column, most: int) -> Column:
    """The longest start of the text that has so many UTF-8 bytes at most."""
    raw = F.substring(F.encode(text, "UTF-8"), F.lit(1), F.lit(most))
    whole = F.try_validate_utf8(raw.cast("string"))
    less = [F.try_validate_utf8(F.substring(raw, F.lit(1), F.lit(most - k)).cast("string")) for k in (1, 2, 3)]
    return F.when(F.octet_length(text) <= most, text).otherwise(F.coalesce(whole, *less))
