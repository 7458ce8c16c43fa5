"""Literal vectors for functions and operators."""

import io
import json
import tarfile
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from longwatch.functions import horizon, pricing, text, urls
from longwatch.operators import bench, chunks, corpora, evalmatch, findings, grounding, recovery, report, scope, segment
from longwatch.plans import review, scan
from longwatch.registry import QUERIES
from longwatch.sources import convert, stored
from longwatch.streaming import arrivals

c = F.col


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("chars, tokens", [(0, 0), (1, 1), (4, 1), (5, 2), (400, 100)])
def test_tokens(spark, chars, tokens):
    assert one(spark, text.estimate_tokens(F.lit(chars))) == tokens


def test_quote_form(spark):
    assert one(spark, text.quote_form(F.lit("  Era   0\nIncludes Straße "))) == "era 0 includes strasse"


@pytest.mark.parametrize("source, quote, n", [
    ("an agent , once", "agent, once", 1), ("the context 's end", "context's end", 1), ("line one\ntwo", "line  one two", 1), ("aaa", "aa", 2), ("an agent once", "agent, once", 0), ("x.y", "x,y", 0), ("A  B", "a b", 1),
])
def test_spans(source, quote, n):
    assert len(grounding.spans(source, quote)) == n


def test_exact_spans_only():
    assert grounding.spans("A  B", "a b", flexible=False) == []
    assert grounding.spans("it wraps here", " wraps ") == [(3, 8)]


def test_verify_sources(spark):
    evidence = spark.createDataFrame([("d", 1, "a", "The counter WRAPS  around"), ("d", 2, "a", "short"), ("d", 3, "b", "the counter wraps around"), ("d", 4, "a", None)], "doc_id string, finding_id int, section_id string, quote string")
    sources = spark.createDataFrame([("d", "a", "so the counter\nwraps around.")], "doc_id string, section_id string, text string")
    got = {r.finding_id: (r.source_verified, r.detail) for r in grounding.verify_sources(evidence, sources).collect()}
    assert got[1] == (True, "Matched 1 of 1 evidence quote(s) in analyzed document text.")
    assert not got[2][0] and "shorter than" in got[2][1]
    assert not got[3][0] and "empty" in got[3][1]
    assert not got[4][0] and got[4][1].startswith("No evidence")


CLAUSES = [
    ("5.3.10\nTimestamp\nbody text.\n", ["s-5.3.10"]), ("Annex A (normative)\nEncoding rules\nx\n", ["Annex-A"]),
    ("2038 cannot be reached\n2.3 Unless noted,\n1 presented to the group;\n60 seconds).\n4.1 Epoch\nbody\n", ["preamble", "s-4.1"]),
    ("Timestamp ..... 16\n4.2 Timestamp\nbody\n", ["preamble", "s-4.2"]), ("Clause 38 and Annex B define the rest.\nAnnex B Rules\nx\n", ["preamble", "Annex-B"]),
    ("plain words only\n", ["body"]), ("", ["body"]), ("1 Scope\na\n1 Scope\nb\n", ["s-1", "s-1"]),
]


@pytest.mark.parametrize("source, ids", CLAUSES)
def test_clauses(source, ids):
    found = segment.clause_rows(source)
    assert [f[0] for f in found] == ids
    assert all(a[4] == b[3] for a, b in zip(found, found[1:], strict=False)) and found[-1][4] == len(source)


def test_contents_without_leaders():
    stubs = "".join(f"{k} Part {k}\n" for k in range(1, 10))
    source = f"Title\nTable of Contents\n{stubs}\n1. Introduction\nThis part says what the document is for, in prose.\n2. Terms\nMore prose follows here.\n"
    assert [f[0] for f in segment.clause_rows(source)] == ["preamble", "s-1", "s-2"]


def test_unique_ids():
    assert segment.unique_ids(["s-1", "s-1", "s-1--2", "s-1"]) == ["s-1", "s-1--3", "s-1--2", "s-1--4"]


def test_numbered_sections(spark):
    source = "front\n1. Scope\r\n text\x0c2.1 Deep title\nend"
    rows = segment.numbered_sections(spark.createDataFrame([("d", source), ("e", "none"), ("f", None)], "doc_id string, text string")).orderBy("doc_id", "ord").collect()
    assert [(r.doc_id, r.id, r.level) for r in rows if r.doc_id != "f"] == [("d", "preamble", 1), ("d", "s-1", 1), ("d", "s-2.1", 2), ("e", "body", 1)]
    assert "".join(r.text for r in rows if r.doc_id == "d") == source
    assert [r.title for r in rows][:3] == ["Preamble", "1. Scope", "2.1. Deep title"]


def _sections(spark, sizes, doc="d"):
    return spark.createDataFrame([(doc, k, f"s-{k}", "t", "x" * n, 1, 0, n, None) for k, n in enumerate(sizes)], "doc_id string, ord int, id string, title string, text string, level int, start_char int, end_char int, parent_id string")


@pytest.mark.parametrize("sizes, caps, kept", [
    ([100, 50, 50], {"max_chars": 160}, [100, 50]), ([500, 0, 1], {"max_chars": 100}, [100, 0]), ([40, 40], {"max_sections": 1}, [40]), ([50, 10], {"max_input_tokens": 5}, [20]), ([3, 4], {}, [3, 4]),
])
def test_scope(spark, sizes, caps, kept):
    assert [len(r.text) for r in scope.apply_scope(_sections(spark, sizes), **caps).orderBy("ord").collect()] == kept


def test_scope_skips_front_matter(spark):
    rows = [("d", 0, "preamble", "Preamble", "a"), ("d", 1, "s-1", "Scope", "b"), ("d", 2, "s-2", "Index of terms", "c"), ("d", 3, "x-acknowledgments", "T", "d"), ("d", 4, "s-9", "Toc", "\n".join(f"{k} Part .... {k}" for k in range(9)))]
    frame = spark.createDataFrame([(*r, 1, 0, 1, None) for r in rows], "doc_id string, ord int, id string, title string, text string, level int, start_char int, end_char int, parent_id string")
    assert [r.id for r in scope.apply_scope(frame).collect()] == ["s-1"]


@pytest.mark.parametrize("n, cap, want", [(4, 8, [4]), (9, 8, [8, 1]), (5, 2, [2, 2, 1]), (0, 8, [])])
def test_packing(spark, n, cap, want):
    made = chunks.requests(chunks.pack(_sections(spark, [10] * n), window=200_000, cap=cap)).orderBy("chunk_index").collect()
    assert [r.sections for r in made] == want
    assert sum((r.opaque_refs for r in made), []) == [f"S{k:04d}" for k in range(1, n + 1)]


def test_a_full_window_fits(spark):
    rows = _sections(spark, [1000])
    need = chunks.requests(chunks.pack(rows, window=10**9)).first().est_in + chunks.MAX_OUTPUT_TOKENS
    assert chunks.pack(rows, window=need).first().error is None
    assert chunks.pack(rows, window=need - 1).first().error == "oversized_section"


def test_envelope_has_the_planned_size(spark):
    packed = chunks.pack(_sections(spark, [10, 2000, 30]), window=10**9)
    size = len(chunks.request_text(packed).first().text) - len("d")
    assert chunks.requests(packed).first().est_in == -(-size // 4) + text.REQUEST_OVERHEAD_TOKENS


VECTORS = [
    (32, True, "unix", "seconds", None, "1901-12-13 20:45:52", "2038-01-19 03:14:07", "2038-01-19 03:14:08"), (32, False, "ntp", "seconds", None, "1900-01-01 00:00:00", "2036-02-07 06:28:15", "2036-02-07 06:28:16"),
    (32, False, "unix", "seconds", None, "1970-01-01 00:00:00", "2106-02-07 06:28:15", "2106-02-07 06:28:16"), (16, False, "unix", "days", None, "1970-01-01 00:00:00", "2149-06-06 00:00:00", "2149-06-07 00:00:00"),
    (16, True, "unix", "seconds", None, "1969-12-31 14:53:52", "1970-01-01 09:06:07", "1970-01-01 09:06:08"), (32, False, "unix", "milliseconds", None, "1970-01-01 00:00:00", "1970-02-19 17:02:47.295", "1970-02-19 17:02:47.296"),
    (16, False, "unix", "ticks", 1000.0, "1970-01-01 00:00:00", "1970-01-01 00:01:05.535", "1970-01-01 00:01:05.536"), (64, True, "unix", "nanoseconds", None, "1677-09-21 00:12:43.145225", "2262-04-11 23:47:16.854775", "2262-04-11 23:47:16.854775"),
]


def test_horizons(spark):
    given = spark.createDataFrame([(k, w, s, e, None, u, t, None, None) for k, (w, s, e, u, t, *_) in enumerate(VECTORS)], "k int, width_bits int, signed boolean, epoch_kind string, epoch timestamp, unit string, ticks_per_second double, claim_value string, claim_precision string")
    show = lambda name: c(f"horizon.{name}").cast("string").alias(name)
    for r in horizon.validate(given).select("k", "horizon.status", show("earliest"), show("last"), show("first_out_of_range")).collect():
        assert (r.status, r.earliest, r.last, r.first_out_of_range) == ("verified", *VECTORS[r.k][5:])


def test_bounds_of_128_bits(spark):
    last = horizon.bounds_table(spark).where("width = 128").first()
    assert last.smin == str(-(2**127)) and last.umax == str(2**128 - 1)


@pytest.mark.parametrize("value, precision, ok", [("2038", "year", True), ("0000", "year", False), ("2038-13", "month", False), ("2038-1-5", "day", False), ("2038-02-30", "day", False), ("2038-01-19T03:14:07", "instant", False), ("2038-01-19T03:14:07Z", "instant", True)])
def test_claim_forms(spark, value, precision, ok):
    assert one(spark, horizon.claim_valid(F.lit(value), F.lit(precision))) == ok == findings.claim_form_ok(value, precision)


@pytest.mark.parametrize("seconds, shown", [(0.04, "0.0s"), (0.05, "0.1s"), (59.95, "1m 0.0s"), (4930.45, "1h 22m 10.5s")])
def test_duration(spark, seconds, shown):
    assert one(spark, horizon.duration(F.lit(seconds))) == shown


def test_epoch_aliases(spark):
    assert one(spark, horizon.parse_epoch_kind(F.lit(" Modified Julian-Day "))) == "mjd"


def test_round6(spark):
    assert one(spark, pricing.round6(F.lit(0.0000025))) == round(0.0000025, 6)


@pytest.mark.parametrize("provider, model, asked, effort, error", [("openai", "gpt-6-luna", None, "none", None), ("openai", "gpt-6-luna", " High", "high", None), ("openai", "gpt-4.1", "low", None, "unsupported"), ("openai", "gpt-6-luna", "huge", None, "unknown"), ("gemini", "x", None, None, None)])
def test_efforts(spark, provider, model, asked, effort, error):
    got = pricing.reasoning_effort(F.lit(provider), F.lit(model), F.lit(asked).cast("string"))
    assert (one(spark, got[0]), one(spark, got[1])) == (effort, error)


def test_converters(tmp_path, spark):
    word = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    docx, plain, tar = io.BytesIO(), io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(docx, "w") as z:
        z.writestr("word/document.xml", word)
    with zipfile.ZipFile(plain, "w") as z:
        z.writestr("__MACOSX/a.txt", "no")
        z.writestr("deep/a.txt", "deep")
        z.writestr("b.txt", "top")
    with tarfile.open(fileobj=tar, mode="w:gz") as t:
        info = tarfile.TarInfo("x.text")
        info.size = 4
        t.addfile(info, io.BytesIO(b"tarx"))
    for name, data in (("a.docx", docx.getvalue()), ("b.zip", plain.getvalue()), ("c.tgz", tar.getvalue()), ("d.html", b"<p>one<script>x</script><p>two &amp; three"), ("e.pdf", b"%PDF"), ("f.txt", b" "), ("g.zip", b"broken")):
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[-1]: (r.text, r.error) for r in convert.converted(convert.read_documents(spark, str(tmp_path), "binary")).collect()}
    assert got == {"a.docx": ("Hello\na | b", None), "b.zip": ("top", None), "c.tgz": ("tarx", None), "d.html": ("one\n\ntwo & three", None), "e.pdf": (None, "pdf is not supported here"), "f.txt": (None, "no text"), "g.zip": (None, "unreadable archive")}


def test_chosen_members(spark):
    rows = spark.createDataFrame([("z", 0, "x/a.txt"), ("z", 1, "B.docx"), ("z", 2, ".c.docx"), ("z", 3, "a.docx"), ("y", 0, "n.bin")], "path string, ord int, name string")
    assert [tuple(r) for r in convert.chosen_members(rows).collect()] == [("z", "a.docx")]
    assert [r.name for r in convert.chosen_members(rows, "A.TXT").collect()] == ["x/a.txt"]


@pytest.mark.parametrize("host, refused", [("127.0.0.1", True), ("8.8.8.8", False), ("[::1]", True), ("169.254.1.1", True), ("example.com", None), (None, None)])
def test_addresses(spark, host, refused):
    assert one(spark, convert.refused_address(F.lit(host).cast("string"))) == refused


@pytest.mark.parametrize("url, ok", [("https://a.org/x/y", True), ("https://a.org/", False), ("https://a.org/publications/x", False), ("https://a.org/x.PDF", True), ("ftp://a.org/x.pdf", False), ("https://262.ecma-international.org/14", True)])
def test_document_urls(spark, url, ok):
    assert one(spark, urls.is_document_url(F.lit(url))) == ok


def test_recovery_budget():
    tried = recovery.work_through([(0, 3)], lambda a, b: "truncated_output" if a <= 2 <= b else None, 2)
    assert [(a, b, o, e) for a, b, _, o, e, _ in tried] == [(0, 3, "split", "truncated_output"), (0, 1, "succeeded", None), (2, 3, "failed", "truncated_output")]
    assert recovery.work_through([(0, 1)], lambda a, b: "invalid_model_output", 0)[0][3] == "failed"
    assert [t[3] for t in recovery.work_through([(0, 1), (2, 2)], lambda a, b: "network", 9)] == ["aborted"]
    with pytest.raises(ValueError):
        recovery.checked_limit(True)


def test_bound_sections(spark):
    made = spark.createDataFrame([("d", 0, "S0001"), ("d", 1, "S0009"), ("d", 1, "S0001"), ("d", 2, None)], "doc_id string, request int, section_id string")
    known = spark.createDataFrame([("d", k, "S0001", "s-1") for k in range(3)], "doc_id string, request int, ref string, id string")
    assert sorted((r.request, r.canonical_id or "") for r in findings.bind_sections(made, known).collect()) == [(0, "s-1"), (2, "")]


def test_headings_outside_fences(spark):
    frame = spark.createDataFrame([(1, "# A\n```\n# no\n```\n## B\n~~~~\n# no\n~~~\n# no\n~~~~\ntext # no")], "run_id int, markdown string")
    assert [r.line for r in report.headings(frame).orderBy("n").collect()] == ["# A", "## B"]


def test_markdown_fence_outgrows_the_text(spark):
    fenced = lambda x: one(spark, text.markdown_fence(F.lit(x)))
    assert fenced("a ```` b") == "~~~\na ```` b\n~~~"
    assert fenced("a ```` ~~~~~ b") == "`````\na ```` ~~~~~ b\n`````"
    assert fenced("a ````` ~~~~ b") == "~~~~~\na ````` ~~~~ b\n~~~~~"
    assert fenced("plain\r\nlines\n") == "```\nplain\nlines\n```" and fenced("") == "```\n\n```"


def test_inline_code(spark):
    code = lambda x: one(spark, text.inline_code(F.lit(x)))
    assert [code(x) for x in ("a", "", "`a", "a ``b", " a", "a\nb", "a\u202eb")] == ["`a`", "`  `", "`` `a ``", "```a ``b```", "`  a `", "`a b`", "`a\\u202eb`"]
    assert "`" * 33 not in code("`" * 33).replace("\\`", "")


def test_secrets_and_private_parts_of_urls(spark):
    shown = lambda x: one(spark, text.redact_secrets(F.lit(x)))
    assert shown("Authorization: Bearer abc.def") == "Authorization: Bearer [REDACTED]"
    assert shown("x-api-key=abc, next") == "x-api-key=[REDACTED], next" and shown("a sk-12345678 b\x07") == "a [REDACTED] b "
    assert shown("see https://me:pw@host.example:8443/a/b?key=1#frag now") == "see https://host.example:8443/a/b now"


def test_token_usage(spark):
    from longwatch.functions import usage

    def got(provider, body):
        r = spark.createDataFrame([(provider, body)], "p string, b string").select(usage.token_usage(F.col("p"), F.col("b")).alias("u"), usage.answer_state(F.col("p"), F.col("b")).alias("s")).first()
        return (*r.u, r.s)

    answer = '{"choices":[{"finish_reason":"%s","message":{"content":"x"%s}}],"usage":{"prompt_tokens":5,"completion_tokens":%s}}'
    assert got("openai", answer % ("stop", "", 7)) == (5, 7, None, None, "ok")
    assert got("openai", answer % ("stop", ',"refusal":"no"', 7)) == (5, 7, None, None, "shape")
    assert got("openai", answer % ("length", "", "-7")) == (None, None, None, "shape", "truncated")
    assert got("openai", answer % ("content_filter", "", "true")) == (None, None, None, "shape", "rejected")
    assert got("gemini", '{"candidates":[]}') == (0, 0, None, None, "shape") and got("ollama", "{}") == (0, 0, None, None, "ok") and got("openai", "no json") == (0, 0, None, None, "shape")


@pytest.mark.parametrize("line, title, clause", [
    ("4.1 Epoch", "bare", None), ("2038 cannot be reached", None, "title"), ("41 Things", None, "quantity"), ("3 The rest", None, "quantity"), ("2.3 Unless noted,", None, "title"),
    ("1 presented to the group;", None, "title"), ("Timestamp ..... 16", "contents entry", "no number"), ("1 Scope  12", "contents entry", "contents entry"), ("Scope and terms", None, "no number"),
    ("5.3", "bare number", "no number"), ("", "empty", "no number"), ("Clause 38 and Annex B define the rest.", "sentence end", "title"),
])
def test_flaws_are_named(line, title, clause):
    facts = segment._Facts(line)
    if title != "bare" and title is not None:
        assert segment.flaw(facts, segment.TITLE_FLAWS) == title
    assert segment.flaw(facts, segment.CLAUSE_FLAWS) == clause


def test_a_dotted_heading_with_a_page_ends_the_contents():
    gap = "some words that are a line of their own\n3. Overview\t12\nmore"
    assert segment._contents_gap("x" * 10 + " entry\n" + "y" * 40 + "\tt 9\n") and not segment._contents_gap(gap)


def test_coverage_shares(spark):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in {"analyzed_sections": 0, "eligible_sections": 0, "analyzed_chars": 3, "eligible_chars": 0, "document_chars": 2, "analyzed_tokens": 1, "eligible_tokens": 4, "document_tokens": 8}.items()])
    r = scope.coverage_shares(row).first()
    assert (r.sections_pct, r.chars_pct, r.tokens_pct, r.chars_pct_of_document, r.tokens_pct_of_document) == (100.0, 0.0, 25.0, 100.0, 12.5)



def test_byte_prefix(spark):
    assert [one(spark, text.byte_prefix(F.lit("aé漢"), n)) for n in (1, 2, 3, 5, 6)] == ["a", "a", "aé", "aé", "aé漢"]


def test_secrets(spark):
    shown = one(spark, text.redact_secrets(F.lit("Authorization: Bearer abc.def sk-12345678abc api_key=zzz x=1")))
    assert not any(s in shown for s in ("abc.def", "sk-1234", "zzz")) and "x=1" in shown


def test_windows_of_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(datetime(2024, 1, 1, 0, m), "a", 1.0) for m in (1, 5, 59)] + [(datetime(2024, 1, 1, 2, 0), "b", 2.0)], "ts timestamp, event_type string, value double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = arrivals.arrivals(spark, str(tmp_path / "in"), rows.schema)
    q = arrivals.each_batch(stream, arrivals.windowed_counts, str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out" / "batch=*")).groupBy("event_type").agg(F.sum("n").alias("n")).collect()
    assert {r.event_type: r.n for r in got} == {"a": 3, "b": 1}


def test_corpus_names(spark):
    assert one(spark, corpora.corpus_name(F.lit(" GPP"))) == "3gpp" and one(spark, corpora.corpus_name(F.lit("x"))) is None
    assert one(spark, corpora.source_url(F.lit("ietf"), F.lit("RFC868"))).endswith("/rfc868.txt")


@pytest.mark.parametrize("corpus, lines, title", [
    ("ietf", ["Network Working Group", "Clock Rollover in Practice", "", "Abstract"], "Clock Rollover in Practice"),
    ("ietf", ["  TITLE:  Exact  ", "Abstract"], "Exact"), ("ietf", ["Title:", "A long enough line"], None), ("ietf", ["Category: Standards Track", "short"], None),
    ("ietf", ["The first line", "a fitting title", *["x"] * 7, "Abstract"], "The first line"), ("ietf", ["STATUS: a shouted label", "Plain enough line"], "Plain enough line"), ("ietf", [], None),
    ("etsi", ["ETSI TS 102 221 and more", "Smart cards; interface", "1 Scope"], "Smart cards; interface"), ("etsi", ["no marker in here at all"], "N"), ("etsi", ["Title:"], "N"),
    ("3gpp", ["3GPP TS 23.501 something", "System architecture", "1  Scope of this"], "System architecture"), ("3gpp", [None], "N"),
])
def test_titles(spark, corpus, lines, title):
    text = None if lines == [None] else "\r\n".join(lines)
    assert one(spark, corpora.document_title(corpus, F.lit(text).cast("string"), F.lit("N"))) == title


def test_parsed_documents(spark):
    docs = spark.createDataFrame([("rfc 05905", "ietf", "Network Time Protocol\n\nAbstract\n"), ("x", "generic", None)], "doc_id string, corpus string, text string")
    got = {r.doc_id: r for r in corpora.parsed_documents(docs).collect()}
    assert (got["rfc 05905"].normal_id, got["rfc 05905"].title, got["rfc 05905"].char_count) == ("RFC5905", "Network Time Protocol", 32)
    assert (got["x"].title, got["x"].content_sha256) == ("x", None)


def test_leaves_and_summaries(spark):
    planned = spark.createDataFrame([("d", k, f"s{k}", 10 * k) for k in range(4)], "doc_id string, ord int, section_id string, char_count int")
    leaves = spark.createDataFrame([("d", "s2", "truncated_output"), ("d", "s1", "truncated_output")], "doc_id string, section_id string, category string")
    got = recovery.failure_leaves(planned, planned.where("ord < 2"), leaves).collect()
    assert sorted((r.section_id, r.category, r.char_count) for r in got) == [("s2", "truncated_output", 20), ("s3", "invalid_model_output", 30)]
    turns = spark.createDataFrame([("d", 2, "b"), ("d", 1, None), ("d", 3, "c"), ("e", 1, "only")], "doc_id string, ord int, title string")
    sums = {r.doc_id: r.summary for r in scope.scoped_summary(turns, spark.createDataFrame([("d", "T")], "doc_id string, title string"), most=2).collect()}
    assert sums == {"d": "Title: T\nAnalyzed sections:\n- \n- b\n... (1 more sections)", "e": "Title: e\nAnalyzed sections:\n- only"}


@pytest.mark.parametrize("value, precision, version, shown", [
    ("2038-01-19T03:14Z", "instant", "0.6.0", "2038-01-19T03:14:00Z"), ("2038-01-19T03Z", "instant", "0.6.0", "2038-01-19T03:00:00Z"), ("2038-01-19T05:14:07.5+02:00", "instant", "0.6.0", "2038-01-19T03:14:07.500000Z"),
    ("2038", "year", "0.6.0", "2038 (year precision)"), ("2038-01-19T03:14:07Z", "day", "0.1.0", "2038-01-19T03:14:07Z"), ("no date", "instant", "0.6.0", "no date"), (None, None, "0.6.0", "n/a"),
])
def test_shown_claims(spark, value, precision, version, shown):
    assert one(spark, horizon.format_claim(F.lit(value).cast("string"), F.lit(precision).cast("string"), F.lit(version))) == shown


RUN = {
    "run_id": 1, "schema_version": "0.6.0", "request_batching": "section_chunks", "analysis_mode": "section_aware", "analysis_request_count": 1, "repair_request_count": 0, "total_provider_request_count": 1,
    "chunk_section_counts": [2], "coverage_complete": True, "sections_analyzed": 2, "analysis_status": "complete", "sections_succeeded": 2, "sections_failed": 0, "succeeded_chars": 9, "failed_chars": 0,
    "analyzed_chars": 9, "recovery_split_count": 0, "recovery_request_count": 0, "failed_section_ids": [], "unanalyzed_sections": [],
}
RUN_TYPES = "run_id int, " + ", ".join(
    f"{k} {'string' if isinstance(v, str) else 'boolean' if isinstance(v, bool) else 'int' if isinstance(v, int) else {'chunk_section_counts': 'array<int>', 'failed_section_ids': 'array<string>'}.get(k, 'array<struct<section_id:string>>')}"
    for k, v in RUN.items() if k != "run_id"
)


@pytest.mark.parametrize("change, rules", [
    ({}, set()), ({"total_provider_request_count": 2}, {"total is the sum"}), ({"chunk_section_counts": [1, 1]}, {"chunks of several sections"}), ({"chunk_section_counts": None}, {"missing chunk_section_counts"}),
    ({"analysis_status": "partial", "coverage_complete": False}, {"partial has failures"}), ({"failed_section_ids": ["a"]}, {"failed ids are counted", "failed ids in order", "complete has none"}),
    ({"schema_version": "0.5.0", "total_provider_request_count": 9, "analysis_request_count": 2}, {"a chunk for each request"}), ({"schema_version": "0.4.0", "analysis_request_count": -4}, set()),
    ({"request_batching": None, "analysis_mode": "whole_document", "chunk_section_counts": [1]}, {"missing request_batching"}), ({"recovery_request_count": 2}, {"recovery within total"}),
])
def test_run_rules(spark, change, rules):
    runs = spark.createDataFrame([tuple((RUN | change).values())], RUN_TYPES)
    assert {r.rule for r in report.violations(runs).collect()} == rules


def test_silent_runs_are_complete(spark):
    silent = RUN | dict.fromkeys(("analysis_status", "sections_succeeded", "sections_failed", "failed_section_ids", "total_provider_request_count", "schema_version"))
    run = report.for_version(spark.createDataFrame([tuple(silent.values())], RUN_TYPES)).first()
    assert (run.schema_version, run.analysis_status, run.sections_succeeded, run.sections_failed, run.failed_section_ids, run.total_provider_request_count) == ("0.6.0", "complete", 2, 0, [], 1)


def test_stored_json(spark, tmp_path):
    for name, body in {"a": '{"findings": [{"id": "x", "finding_type": "explicit_defect"}, {"id": "y", "finding_type": "no such"}]}', "b": "[1]", "c": '{"findings": []}', "d": '{"a": 1, "a": 2}'}.items():
        (tmp_path / f"{name}.json").write_text(body)
    got = sorted((r.path[-6], r.id or "", r.error or "") for r in stored.read_labels(spark, str(tmp_path)).collect())
    assert got == [("a", "x", ""), ("a", "y", "invalid_field"), ("b", "", "invalid_json"), ("d", "", "invalid_json")]
    errors = {r.path[-6]: r.error for r in stored.read_reports(spark, str(tmp_path)).collect()}
    assert errors == {"a": "missing document", "b": "invalid_json", "c": "missing document", "d": "invalid_json"}
    assert {r.error for r in stored.read_manifests(spark, str(tmp_path / "c.json"), "jobs array<string>").collect()} == {"missing manifest_format_version"}


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([("a/b", "one\ntwo"), ("c", None)], "doc_id string, text string")
    stored.write_texts(docs, str(tmp_path / "t"))
    assert sorted(r.value.strip() for r in spark.read.text(str(tmp_path / "t"), wholetext=True).collect()) in ([["", "one\ntwo"], ["one\ntwo"]])
    stored.write_table(docs, str(tmp_path / "c"), "csv")
    assert spark.read.csv(str(tmp_path / "c"), header=True, multiLine=True, escape='"').count() == 2
    with pytest.raises(Exception):
        stored.write_table(docs, str(tmp_path / "c"), "csv")
    raw = stored.raw_answers(spark.createDataFrame([("é" * 4, True), ("ok", False)], "content string, failed boolean"), F.col("failed"), most=5).first()
    assert (raw.content, raw.bytes, raw.cut) == ("éé", 8, True)


def test_matrices_are_bounded(spark):
    docs = spark.range(2).withColumnRenamed("id", "doc_id")
    assert bench.jobs(docs, spark.range(3)).count() == 6
    with pytest.raises(ValueError, match="configurations at most"):
        bench.jobs(docs, spark.range(bench.MOST_CONFIGS + 1))
    with pytest.raises(ValueError, match="configurations at most"):
        scan.document_modes(docs.withColumn("text", F.lit("x")), spark.range(bench.MOST_CONFIGS + 1))


def test_review(spark):
    sections = spark.createDataFrame([("d", k, f"s{k}", f"Title {k}", f"The counter {k} wraps around in 2038.") for k in range(3)], "doc_id string, ord int, id string, title string, text string")
    packed = chunks.pack(sections, window=200_000, cap=1)
    item = {
        "finding_type": "implied_assumption", "title": "t", "description": "d", "severity": "low", "confidence": "low", "domains": ["epoch"], "evidence": [{"quote": "counter 0 wraps around"}],
        "machine_interpretation": "m", "scope_relevance": "core", "scope_rationale": "r",
    }
    told = lambda **change: json.dumps({"findings": [item | change]})
    answers = spark.createDataFrame([("d", 0, told()), ("d", 1, told(section_id="S0001")), ("d", 7, told()), ("d", 0, "no JSON")], "doc_id string, request long, content string")
    findings, outcomes = review.reviewed_findings(packed, answers)
    got = findings.collect()
    assert [(r.id, r.request, r.section_id, r.source_verified) for r in got] == [("F-001", 0, None, True)]
    assert sorted((r.request, r.succeeded) for r in outcomes.collect()) == [(0, True), (1, False), (2, False)]
    runs = review.reviewed_runs(packed, outcomes)
    run = runs.first()
    assert (run.analysis_status, run.failed_section_ids, run.sections_succeeded, run.request_batching) == ("partial", ["s1", "s2"], 1, "per_section")
    assert report.violations(runs).count() == 0
    empty, none = review.reviewed_findings(packed.limit(0), answers)
    assert (empty.count(), none.count(), review.reviewed_runs(packed.limit(0), none).count()) == (0, 0, 0)


# ---- folds, sections of rows without a key, quotes without a whole word


def test_gathered_values_keep_their_order(spark):
    from longwatch.functions.folds import gathered

    step = lambda a, x: ({"n": a["n"] + x}, x % 3 > 0, a["n"] * 10 + x)
    for n in (0, 1, 63, 64, 65, 1000):
        items = list(range(1, n + 1))
        got = spark.createDataFrame([(items,)], "a array<long>").select(gathered(F.col("a"), {"n": F.lit(0).cast("long")}, step, "long")).first()[0]
        assert got == [10 * (x * (x - 1) // 2) + x for x in items if x % 3]
    assert spark.createDataFrame([(None,)], "a array<long>").select(gathered(F.col("a"), {"n": F.lit(0).cast("long")}, step, "long")).first()[0] is None


def test_sections_of_rows_that_share_an_id(spark):
    rows = [("d", "1 One\nfirst\n"), ("d", "intro\n2 Two\nsecond"), (None, "3 Three\nthird"), (None, "plain"), ("e", None), ("f", "")]
    got = segment.numbered_sections(spark.createDataFrame(rows, "doc_id string, text string"))
    assert sorted((r.doc_id or "", r.id, r.text or "") for r in got.collect()) == [
        ("", "body", "plain"), ("", "s-3", "3 Three\nthird"), ("d", "preamble", "intro\n"), ("d", "s-1", "1 One\nfirst\n"), ("d", "s-2", "2 Two\nsecond"), ("e", "body", ""), ("f", "body", ""),
    ]
    assert not [x for x in got._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x]
    spans = segment.lines(spark.createDataFrame(rows, "doc_id string, text string")).where("doc_id = 'd'").collect()
    assert sorted((r.n, r.start, r.line) for r in spans) == [(0, 0, "1 One\n"), (0, 0, "intro\n"), (1, 6, "2 Two\n"), (1, 6, "first\n"), (2, 12, "second")]


def test_quotes_meet_sources_on_equal_keys_only(spark):
    sources = [(0, "the internationalisation standard applies"), (1, "internationalisation"), (2, "a b c"), (3, None)]
    quotes = [(0, "nationalisation stand"), (1, "ternationalisatio"), (2, "the internationalisation standard"), (3, "short"), (4, "nationalisation  STAND"), (5, None)]
    df = grounding.quote_pairs(spark.createDataFrame(sources, "doc_id int, text string"), spark.createDataFrame(quotes, "item_id int, text string"))
    assert {(r.doc_id, r.item_id) for r in df.collect()} == {(0, 0), (0, 1), (1, 1), (0, 2), (0, 4)}
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()


def test_matrix_bound_holds_when_the_plan_runs(spark):
    many = spark.range(5000).where("id % 2 = 0").select(F.col("id").cast("string").alias("config_id"))
    with pytest.raises(Exception, match="configurations at most"):
        bench.jobs(spark.range(2).toDF("doc_id"), many).collect()
    assert bench.jobs(spark.range(2).toDF("doc_id"), many.limit(3)).count() == 6


# ---- moments, rounding, errors, nested values, counters


@pytest.mark.parametrize(("text", "want"), [
    ("2038-01-19", ("2038-01-19", "day")), ("2038-01-19Z", ("2038-01-19", "day")), ("20380119", ("2038-01-19T00:00:00Z", "instant")), ("2038-W03-2", ("2038-01-19T00:00:00Z", "instant")),
    ("2038-01-19T03:14:07Z", ("2038-01-19T03:14:07Z", "instant")), ("2038W032T0314+0100", ("2038-01-19T02:14:00Z", "instant")), (" 2038-01-19 03 ", ("2038-01-19T03:00:00Z", "instant")),
    ("2038-01-19T03:14:07.1234567-00:30", ("2038-01-19T03:44:07.123456Z", "instant")), ("2038-02-30", None), ("2038-W53-1", None), ("2038-01-19T25:00", ("2038-01-19", "day")), ("soon", None), ("", None), (None, None), ("0000-01-01", None),
])
def test_legacy_claims(spark, text, want):
    from longwatch.functions import moments

    got = spark.createDataFrame([(text,)], "t string").select(moments.legacy_claim(F.col("t")).alias("c")).first().c
    assert (tuple(got) if got else None) == want


def test_moments_equal_pythons(spark):
    import random
    from datetime import date, datetime, timedelta, timezone

    from longwatch.functions import moments

    def plain(text):
        def day(t):
            try:
                return date.fromisoformat(t).isoformat(), "day"
            except ValueError:
                return None

        if len(text) >= 10 and text[4] == "-" and text[7] == "-" and text[10:].upper() in ("", "Z"):
            return day(text[:10])
        try:
            at = datetime.fromisoformat(text[:-1] + "+00:00" if text.endswith("Z") else text)
        except ValueError:
            return day(text[:10])
        at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
        return at.astimezone(timezone.utc).isoformat()[:-6] + "Z", "instant"

    r = random.Random(9)
    rows = []
    for i in range(3000):
        d = date(r.randrange(2, 9998), 1, 1) + timedelta(days=r.randrange(365))
        y, w, k = d.isocalendar()
        h, m, s = r.randrange(25), r.randrange(61), r.randrange(61)
        when = r.choice([d.isoformat(), d.isoformat().replace("-", ""), f"{y:04d}-W{w:02d}-{k}", f"{y:04d}W{w:02d}{k}", f"{y:04d}-W{w:02d}", f"{y:04d}-W53-1", f"{y:04d}-{r.randrange(14):02d}-31"])
        clock = r.choice(["", f"{h:02d}", f"{h:02d}:{m:02d}", f"{h:02d}{m:02d}{s:02d}", f"{h:02d}:{m:02d}:{s:02d}", f"{h:02d}:{m:02d}:{s:02d}.{r.randrange(10**7)}", f"{h:02d}:{m:02d}{s:02d}"])
        rows.append((i, when + r.choice(["", "T", " ", "t", "-"]) + clock + r.choice(["", "Z", "z", "+05:30", "-0800", "+05", "+24:00", "+01:02:03", "+", "Z1"])))
    got = {x.i: (tuple(x.c) if x.c else None) for x in spark.createDataFrame(rows, "i int, t string").select("i", moments.legacy_claim(F.col("t")).alias("c")).collect()}
    assert {t: got[i] for i, t in rows} == {t: plain(t.strip()) for _, t in rows}


def test_six_places_as_python_rounds(spark):
    import random

    from longwatch.functions.pricing import round6

    r = random.Random(4)
    values = [r.random() for _ in range(4000)] + [(r.randrange(10**9) + 0.5) / 1e6 for _ in range(8000)] + [r.randrange(2**40) / 2.0 ** r.randrange(12, 45) for _ in range(4000)] + [0.0, -2.5e-6, 0.5e-6, 1.5e-6, 7.0e12]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double").select("v", round6(F.col("v")).alias("r"))
    got = [x.r for x in df.collect()]
    assert got[:-2] == [round(v, 6) for v in values] and got[-2:] == [None, None]
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("family", "body", "want"), [
    ("openai", '{"error": {"message": "Unknown parameter: \'response_format\'."}}', True), ("openai", '{"error": {"message": "Unknown parameter: \'user\'."}}', False),
    ("openai", '{"error": {"message": "x not supported", "param": "response_format.json_schema"}}', True), ("openai", '{"error": {"message": "not supported: structured outputs", "param": "user"}}', False),
    ("openai", '{"error": {"message": "structured outputs are not supported", "code": "invalid_json_schema"}}', False), ("openai", '{"error": {"message": "json_schema not supported: maxItems"}}', False),
    ("openai", '{"error": {"message": "This model does not support json_schema"}}', True), ("openai", '{"error": "not supported json_schema"}', False), ("openai", "not JSON", False), ("openai", None, False),
    ("gemini", '{"error": [{"message": "Unknown name \\"responseSchema\\" at \'generation_config\': gone"}]}', True), ("gemini", '{"error": {"message": "Unknown name \\"responseSchema\\" at \'generation_config\'.x"}}', False),
    ("gemini", '{"error": {"message": "response_mime_type is not supported"}}', True), ("gemini", '{"error": {"message": "generation_config.response_schema is not supported"}}', False), ("other", '{"error": {"message": "json_schema not supported"}}', False),
])
def test_unsupported_features(spark, family, body, want):
    from longwatch.functions import errors

    got = spark.createDataFrame([(family, body)], "f string, b string").select(errors.unsupported_feature(F.col("f"), errors.error_fields(F.col("b")))).first()[0]
    assert bool(got) is want


def test_failure_texts(spark):
    from longwatch.functions import errors

    c = F.lit
    url = "HTTPS://user:pw@Api.Example.org:8443/v1/chat?key=1#f"
    got = spark.range(1).select(
        errors.http_failure(c("openai"), c(503), c(url), c(True), c(3)), errors.http_failure(c(None).cast("string"), c(401), c("nonsense"), c(False), c(None).cast("int")),
        errors.request_failure(c("x"), c("read timeout"), c(url), c(True), c(2)), errors.shown_failure(c("ingest"), c("bad key sk-abcdefgh12")), errors.shown_failure(c("weird"), c("secret")),
    ).first()
    assert list(got) == [
        "openai HTTP 503 for https://api.example.org:8443/v1/chat (retryable) after 3 attempt(s)", "LLM HTTP 401 for <unparseable-url> (non-retryable)",
        "x request failed after 2 attempt(s) to https://api.example.org:8443/v1/chat: read timeout (retryable)", "bad key [REDACTED]", "internal error",
    ]


def test_nested_values_are_rewritten_at_any_depth(spark):
    from longwatch.functions.nested import DROP, rewritten

    schema = "s struct<url:string,gone:int,list:array<struct<url:string,k:int>>,map:map<string,struct<url:string>>>"
    df = spark.createDataFrame([((("a", 1, [("b", 2), None], {"x": ("c",)})),), (None,)], schema)
    rule = lambda path, value, kind, of: DROP if path[-1] == "gone" else F.upper(value) if path[-1] == "url" else None
    got = [r.s for r in df.select(rewritten(F.col("s"), df.schema["s"].dataType, rule).alias("s")).collect()]
    assert got[0].asDict(True) == {"url": "A", "list": [{"url": "B", "k": 2}, None], "map": {"x": {"url": "C"}}} and got[1] is None


def test_counters_and_shown_lines(spark):
    from datetime import datetime

    from longwatch.operators import progress

    rows = spark.createDataFrame([("d", "abcde"), (None, ""), ("e", "x" * 9)], "doc_id string, text string")
    kept, seen = progress.watched(rows, "t", big=F.count_if(F.length("text") > 8))
    assert kept.count() == 3 and seen.get == {"sections": 3, "chars": 14, "tokens": 5, "longest": 9, "empty": 1, "without_document": 1, "big": 1}
    at = lambda s: datetime(2026, 1, 1, 0, 0, s)
    lines = [("u", at(0), 1, "working"), ("u", at(3), 1, "working"), ("u", at(12), 1, "working"), ("u", at(13), 1, "\x1b[31mdone"), ("u", at(14), 3, "detail"), ("u", at(15), 1, "working"), ("v", at(3), 1, "working"), ("u", at(16), 1, "\x00")]
    got = progress.shown_lines(spark.createDataFrame(lines, "unit string, at timestamp, level int, text string"))
    assert sorted((r.unit, r.at.second, r.text) for r in got.collect()) == [("u", 0, "working"), ("u", 12, "working"), ("u", 13, "done"), ("u", 15, "working"), ("v", 3, "working")]


def test_horizon_blocks(spark):
    names = "k int, width_bits int, signed boolean, epoch_kind string, epoch timestamp, unit string, ticks_per_second double, claim_value string, claim_precision string"
    rows = [
        (0, 32, None, "unix", None, "seconds", None, "2038-01-19", "day"), (1, 32, True, "unix", None, "seconds", None, "2038-01-20", "day"), (2, 32, True, "unix", None, "seconds", None, "2038", "year"),
        (3, None, None, None, None, None, None, None, None), (4, 16, False, "unix", None, "ticks", 1000.0, None, None),
    ]
    made = horizon.validate(spark.createDataFrame(rows, names))
    got = {r.k: r.x for r in made.select("k", report.horizon_lines(F.lit("0.6.0"), F.lit(""), F.when(F.col("k") == 3, F.array(F.lit("no *width*"), *[F.lit(str(i)) for i in range(4)]))).alias("x")).collect()}
    assert got[0][6:] == [
        "- **Width:** 32 bits", "- **Signedness:** unresolved (both interpretations below)", "- **Epoch kind:** `unix`", "- **Unit:** `seconds`", "- **Signed interpretation:**", "  - Range: -2,147,483,648 … 2,147,483,647",
        "  - Last representable: 2038-01-19T03:14:07Z", "  - First out-of-range: 2038-01-19T03:14:08Z", "- **Unsigned interpretation:**", "  - Range: 0 … 4,294,967,295", "  - Last representable: 2106-02-07T06:28:15Z",
        "  - First out-of-range: 2106-02-07T06:28:16Z", "- **Source-stated horizon:** 2038-01-19 (day precision)", "- Result: **Consistent** with deterministic calculation",
    ]
    assert got[1][2] == "Status: **Contradicted** (`contradicted`)" and got[1][-1] == "- Result: **Inconsistent** with deterministic calculation"
    assert got[2][-2:] == ["- **Source-stated horizon:** 2038 (year precision)", "- Result: not compared as an exact instant (partial source precision)"]
    assert got[3][-4:] == ["- **Result:** validation not completed (no \\*width\\*)", "- **Note:** no \\*width\\*", "- **Note:** 0", "- **Note:** 1"]
    assert "- **Unit:** `ticks` (1000 ticks/second)" in got[4]
    old = made.where("k = 2").select(report.horizon_lines(F.lit("0.2.0"), F.lit(None).cast("string"), F.lit(None).cast("array<string>")).alias("x")).first().x
    assert old[-1].startswith("- **Model-stated horizon:** 2038")


def test_first_line_titles(spark):
    cases = [
        ("w3c", "W3C\n<a>\nhttp://x.org/aaaaaaaa\nshort\n", "W3C"), ("w3c", "<html>\n\nA long enough title\n", "A long enough title"), ("ecma", "Copyright of all\n12345678901234\nAn ECMA Standard", "An ECMA Standard"),
        ("iso", "Only short one\nTITLE: \nA title that is long enough", "ID"), ("iso", "Only short one", "ID"), ("nist", "title: Given\n", "Given"), ("oasis", None, "ID"),
    ]
    for corpus, source, want in cases:
        got = spark.createDataFrame([(source,)], "t string").select(corpora.first_line_title(corpus, F.col("t"), F.lit("ID"))).first()[0]
        assert got == want, (corpus, source, got)
    for source, want in (("x\n# Head one #\n", "Head one #"), ("Title:  T\n# H", "T"), ("## no\nTitle:\n", None), ("#no", None), (None, None), ("\n" * 90 + "# late", None)):
        assert spark.createDataFrame([(source,)], "t string").select(corpora.generic_title(F.col("t"))).first()[0] == want


def test_names_that_no_corpus_claims_stay(spark, tmp_path):
    spark.createDataFrame([(9, "1 2 3"), (21, "two"), (0, "x")], "doc_id long, text string").withColumn("lang", F.lit("en")).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.id for r in QUERIES["normalize_ids"](spark, str(tmp_path)).collect()}
    assert got == {9: "Zz ", 21: "Zz two", 0: "RFC1"}


@pytest.mark.parametrize("x, want", [(31.25, "31.2"), (31.75, "31.8"), (24.25, "24.2"), (0.05, "0.1"), (0.15, "0.1"), (0.25, "0.2"), (0.35, "0.3"), (100.0, "100.0"), (0.0, "0.0"), (99.95, "100.0")])
def test_tenths_round_as_the_binary_value(spark, x, want):
    assert f"{x:.1f}" == want
    assert one(spark, F.format_string("%.1f", pricing.round_places(F.lit(x), 1))) == want


def test_coverage_of_a_half(spark):
    run = spark.createDataFrame([(275, 880)], "analyzed_chars long, eligible_chars long").select(
        "*", F.lit(True).alias("scope_truncated"), F.lit(1).alias("sections_analyzed"), F.lit(3).alias("eligible_sections"), F.lit(None).cast("int").alias("sections_total"), F.array().cast("array<string>").alias("scope_notes"), F.lit(31.25).alias("p"))
    assert "31.2%" in run.select(F.array_join(report.coverage_lines(F.col("p")), "\n").alias("x")).first().x


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_recovery_without_a_call_for_each_document(spark):
    ranges = spark.createDataFrame([("a", 4, 5), ("a", 0, 3), (None, 0, 0), ("b", 0, 1)], "doc_id string, lo int, hi int")
    bad = spark.createDataFrame([("a", 5, "network"), ("a", 2, "truncated_output"), (None, 0, "invalid_model_output"), ("c", 0, "network")], "doc_id string, section int, error string")
    got = recovery.recover(ranges, bad)
    assert "FlatMapCoGroups" not in plan_of(got)
    rows = {(r.doc_id, r.step): (r.lo, r.hi, r.outcome) for r in got.collect()}
    assert rows == {
        ("a", 0): (0, 3, "split"), ("a", 1): (0, 1, "succeeded"), ("a", 2): (2, 3, "split"), ("a", 3): (2, 2, "failed"), ("a", 4): (3, 3, "succeeded"), ("a", 5): (4, 5, "aborted"), (None, 0): (0, 0, "failed"), ("b", 0): (0, 1, "succeeded"),
    }


def test_labels_without_a_call_for_each_document(spark):
    labels = spark.createDataFrame([("a", 2, "E2", "t", "s", None), ("a", 1, "E1", "t", "s", "q"), (None, 1, "E", "t", None, None)], "doc_id string, ord int, id string, finding_type string, section_id_contains string, quote_contains string")
    found = spark.createDataFrame([("a", 2, "F2", "t", "s-1", ["a q"]), ("a", 1, "F1", "u", "s-1", ["q"]), ("z", 1, "F", "t", "s", None)], "doc_id string, idx int, id string, finding_type string, section_id string, quotes array<string>")
    got = evalmatch.match_findings(labels, found)
    assert "FlatMapCoGroups" not in plan_of(got)
    assert {r.expected_id: (r.matched_finding_id, r.reason) for r in got.collect()} == {"E1": ("F2", "matched"), "E2": ("F1", "matched; finding_type disagreement"), "E": (None, "no candidate")}


@pytest.mark.parametrize("make", [lambda t: corpora.document_title("ietf", t, F.lit("N")), lambda t: corpora.first_line_title("w3c", t, F.lit("N"))])
def test_a_title_splits_its_text_once(spark, make):
    rows = spark.createDataFrame([("Title: T\nx",)], "t string").select(make(c("t")).alias("title"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 1 and rows.first().title == "T"


def test_media_type_of_bytes(spark):
    kinds = {b"": "unknown", b"a" * 86 + b"\x00" * 14: "text", b"a" * 85 + b"\x00" * 15: "unknown", b"\xe9" * 9: "unknown", b"PK" + bytes.fromhex("0776f72642f0"): "zip", b"PK word/": "docx", b"\x1f\x8b": "tar", b"%PDF": "pdf", b"a" * 2048 + b"\x00" * 9000: "text"}
    rows = spark.createDataFrame([(bytearray(k), v) for k, v in kinds.items()], "data binary, want string").select("want", urls.media_type(F.lit("x"), F.lit(None).cast("string"), c("data")).alias("kind"))
    assert all(r.kind == r.want for r in rows.collect())


def test_numbered_lines_by_all_line_ends(spark):
    source = "1 A\r\n2 B\r\r3 C\x0b\u2028 4 D\x85x\n\n5 E"
    rows = segment.lines(spark.createDataFrame([("d", source)], "doc_id string, text string")).orderBy("n").collect()
    assert [r.line for r in rows] == source.splitlines(keepends=True) and rows[-1].start + len(rows[-1].line) == len(source)
    found = segment.numbered_sections(spark.createDataFrame([("d", source)], "doc_id string, text string"))
    assert "(?<=" not in plan_of(found)
    assert [r.id for r in found.orderBy("ord").collect()] == ["s-1", "s-2", "s-3", "s-4", "s-5"]
    assert all(one(spark, text.strip(F.lit(x))) == x.strip() for x in ("", " ", "\u3000 a b\x1f\n", "a", "\u00a0\n\U0001f600 \x85"))
