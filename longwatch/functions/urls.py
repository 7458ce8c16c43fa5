"""URL and file-name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNPARSEABLE = "<unparseable-url>"


def parts(url: Column) -> dict[str, Column]:
    """Scheme, network location and path of a URL, empty where absent."""
    get = lambda k: F.regexp_extract(url, r"\A(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)", k)
    return {"scheme": F.lower(get(1)), "netloc": get(2), "path": get(3)}


def redact_url(url: Column) -> Column:
    """Scheme, host, explicit port and path; no user, query or fragment."""
    p = parts(url)
    host = F.regexp_replace(p["netloc"], r"\A.*@", "")
    port = F.regexp_extract(host, r":(\d+)\z", 1)
    name = F.lower(F.regexp_replace(host, r":\d*\z", ""))
    # a port that is no number up to 65535 is shown as it stands
    odd = host.rlike(r":[^\]]*[^\d\]][^\]]*\z") | ((port != "") & (F.try_to_number(F.when(F.length(port) < 9, port).otherwise("99999"), F.lit("999999999")) > 65535))
    shown = F.when(odd, host).when(port != "", F.concat(name, F.lit(":"), F.regexp_replace(port, r"\A0+(?=\d)", ""))).otherwise(name)
    safe = F.concat(F.when(p["scheme"] != "", F.concat(p["scheme"], F.lit(":"))).otherwise(""), F.when(p["netloc"] != "", F.concat(F.lit("//"), shown)).otherwise(""), p["path"])
    return F.when(url.isNull() | (url == "") | safe.rlike("[?#]"), F.lit(UNPARSEABLE)).otherwise(safe)


def rfc_number(path: Column) -> Column:
    found = F.regexp_extract(path, r"(?i)rfc[-_]?(\d+)", 1)
    return F.when(found != "", F.regexp_replace(found, r"\A0+(?=\d)", ""))


def rewrite_url(url: Column) -> Column:
    """The public text mirror for pages of the drafts trackers, else the URL."""
    p = parts(url)
    hosts = ("tools.ietf.org", "www.tools.ietf.org", "datatracker.ietf.org", "www.datatracker.ietf.org")
    n = rfc_number(p["path"])
    return F.when(F.lower(p["netloc"]).isin(*hosts) & n.isNotNull(), F.concat(F.lit("https://www.rfc-editor.org/rfc/rfc"), n, F.lit(".txt"))).otherwise(url)


def text_twin(url: Column) -> Column:
    """The text form of a PDF that the mirror may lack, or null."""
    p = parts(url)
    ours = F.lower(p["netloc"]).isin("www.rfc-editor.org", "rfc-editor.org") & F.lower(p["path"]).endswith(".pdf")
    return F.when(ours, F.concat(F.lit("https://www.rfc-editor.org/rfc/rfc"), rfc_number(p["path"]), F.lit(".txt")))


# Paths of portals, and extensions of documents.
PORTAL_PATHS = ("standards-search", "standards.html", "/publications", "specifications-by-series", "publications-and-standards/standards")
DOCUMENT_EXTENSIONS = ("txt", "text", "md", "pdf", "html", "htm", "docx", "zip", "tgz", "gz")


def is_document_url(url: Column) -> Column:
    """Whether a URL plausibly names a document and not a portal."""
    p = parts(F.trim(url))
    path = F.regexp_replace(F.lower(p["path"]), r"/+\z", "")
    name = F.element_at(F.split(path, "/"), -1)
    portal = F.lit(False)
    for marker in PORTAL_PATHS:
        portal |= F.contains(path, F.lit(marker))
    ext = F.when(F.contains(name, F.lit(".")) & ~name.startswith("."), F.element_at(F.split(name, r"\."), -1))
    segments = F.size(F.filter(F.split(path, "/"), lambda s: s != ""))
    named = F.coalesce(ext.isin(*DOCUMENT_EXTENSIONS), F.lit(False)) | F.contains(path, F.lit("/tr/"))
    edition = F.contains(F.lower(p["netloc"]), F.lit("262.ecma-international.org")) & (segments > 0)
    return p["scheme"].isin("http", "https") & (p["netloc"] != "") & (path != "") & ~portal & (named | edition | (segments >= 2))


def is_url(value: Column) -> Column:
    """(S15)"""
    p = parts(value)
    return p["scheme"].isin("http", "https") & (p["netloc"] != "")


def extension(name: Column) -> Column:
    """The lower-cased suffix with its dot; .tar.gz is one suffix."""
    base = F.lower(F.element_at(F.split(F.regexp_replace(name, r"[?#].*\z", ""), "/"), -1))
    return F.when(base.endswith(".tar.gz"), ".tar.gz").otherwise(F.regexp_extract(base, r"[^.](\.[^.]+)\z", 1))


# Media types by extension and by content type.
BY_EXTENSION = {"text": (".txt", ".text", ".md"), "html": (".html", ".htm"), "docx": (".docx",), "pdf": (".pdf",), "zip": (".zip",), "tar": (".tgz", ".tar.gz", ".tar")}
BY_CONTENT = {
    "text": ("text/plain", "text/markdown"),
    "docx": ("application/vnd.openxmlformats-officedocument.wordprocessingml.document",),
    "pdf": ("application/pdf",),
    "zip": ("application/zip", "application/x-zip-compressed"),
    "tar": ("application/gzip", "application/x-gtar", "application/x-tar"),
    "html": ("text/html", "application/xhtml+xml"),
}


def media_type(name: Column, content_type: Column, data: Column) -> Column:
    """Media type by extension, then content type, then the first bytes."""
    ext, kind = extension(name), F.lower(F.trim(F.element_at(F.split(F.coalesce(content_type, F.lit("")), ";"), 1)))
    out = None
    for value, names in (*((v, ext.isin(*e)) for v, e in BY_EXTENSION.items()), *((v, kind.isin(*c)) for v, c in BY_CONTENT.items())):
        out = F.when(names, value) if out is None else out.when(names, value)
    head = F.decode(F.substring(data, F.lit(1), F.lit(8192)), "ISO-8859-1")  # a character for each byte
    sample = F.substring(head, 1, 2048)
    plain = F.length(F.regexp_replace(sample, r"[^\x20-\x7E\x09\x0A\x0D]+", ""))
    return (
        out.when(head.startswith("%PDF"), "pdf")
        .when(head.startswith("PK") & F.contains(head, F.lit("word/")), "docx").when(head.startswith("PK"), "zip")
        .when(head.startswith("\x1f\x8b"), "tar")
        .when((F.length(sample) > 0) & (plain > 0.85 * F.length(sample)), "text")
        .otherwise("unknown")
    )


#: Fixed value: the host of the chat provider that knows structured output.
OFFICIAL_CHAT_HOST = "api.openai.com"


def official_chat_base(base: Column) -> Column:
    """Whether a base address is the provider's own: none, or one of just its host, with a scheme or not."""
    given = F.trim(F.coalesce(base, F.lit("")))
    host = F.lower(F.regexp_extract(F.when(F.contains(given, F.lit("://")), given).otherwise(F.concat(F.lit("https://"), given)), r"\A[^:/?#]*://(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    return (given == "") | (host == OFFICIAL_CHAT_HOST)


def portal_error(url: Column) -> Column:
    """Why an address is not fetched: it looks like a page to search on and not like a document; null for a document's."""
    told = F.concat(F.lit("Resolved URI looks like a portal/search page, not a document: "), redact_url(url), F.lit("."))
    return F.when(~F.coalesce(is_document_url(url), F.lit(False)), told)


def allows_html(kind: Column, url: Column) -> Column:
    """Whether a reference may be a web page: by its media type, or by its address."""
    path = F.lower(F.coalesce(url, F.lit("")))
    return F.contains(F.lower(F.coalesce(kind, F.lit(""))), F.lit("html")) | F.contains(path, F.lit("/tr/")) | F.regexp_replace(path, r"/+\z", "").rlike(r"\.html?\z")
