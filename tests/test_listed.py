"""Listed cases, each with the answer that it must have or SQL for it."""

import pytest
from pyspark.sql import functions as F

from longwatch.catalog import values
from longwatch.functions import horizon, pricing, text, urls
from longwatch.operators import bench, corpora, evalmatch, findings, recovery, segment
from tests.oracle import rows as in_order
from tests.oracle import views

QUERIES, ORACLE = {}, {}
c = F.col


def query(sql):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


MODELS = [("openai", "gpt-4.1-mini"), ("OpenAI", "GPT-4.1-mini-2025"), ("openai", "gpt-4.1"), ("openai", "gpt-6-luna"), ("gemini", "gemini-3.5-flash-lite-x"), ("gemini", "gemini-3.5-flash-lite"), ("gemini", "gemini-2.5-pro-exp"), ("anthropic", "claude-9"), ("ollama", "gpt-oss:120b")]


@query(f"""WITH m AS ({values(MODELS, 'provider, model')}), p AS ({values([(i, *r) for i, r in enumerate(pricing.PRICES)], 'ord, p, pm, input_rate, output_rate')})
SELECT provider, model, input_rate::DOUBLE AS input_rate, output_rate::DOUBLE AS output_rate FROM (
  SELECT m.*, p.input_rate, p.output_rate, row_number() OVER (PARTITION BY m.provider, m.model ORDER BY coalesce(lower(m.model) <> p.pm, true), p.ord) AS n
  FROM m LEFT JOIN p ON lower(m.provider) = p.p AND starts_with(lower(m.model), p.pm)) WHERE n = 1""")
def pricing_prefix_lookup(spark, sf):
    return pricing.with_prices(spark.createDataFrame(MODELS, "provider string, model string"))


@query("""SELECT tokens, CASE WHEN tokens > 272000 THEN 'luna_long' ELSE 'luna_short' END AS tier,
CASE WHEN tokens > 272000 THEN tokens * 20 + 1000 * 75 ELSE tokens * 10 + 1000 * 50 END AS units FROM (VALUES (0::BIGINT), (271999), (272000), (272001), (1000000)) t(tokens)""")
def long_context_tier(spark, sf):
    rows = spark.createDataFrame([(0,), (271999,), (272000,), (272001,), (1000000,)], "tokens long")
    model = F.lit("openai"), F.lit("gpt-6-luna")
    i, o = pricing.rates(*model, c("tokens"), F.lit(None).cast("double"), F.lit(None).cast("double"))
    tier = pricing.pricing_tier(*model, c("tokens"), F.lit(None).cast("double"))
    return rows.select("tokens", tier.alias("tier"), (c("tokens") * F.round(i * 100).cast("long") + 1000 * F.round(o * 100).cast("long")).alias("units"))


IDS = [
    ("RFC5905", "ietf", "RFC5905"), ("rfc 868", "ietf", "RFC868"), ("5905", "ietf", "RFC5905"), ("draft-ietf-ntp-something-01", "ietf", "draft-ietf-ntp-something-01"),
    ("TS 23.501", "3gpp", "3GPP TS 23.501"), ("3GPP TS 33.501 V18.1.0", "3gpp", "3GPP TS 33.501 V18.1.0"), ("ETSI TS 103 246-1", "etsi", "ETSI TS 103 246-1"), ("EN 302 637-2", "etsi", "ETSI EN 302 637-2"),
    ("ECMA-404", "ecma", "ECMA-404"), ("ecma 262", "ecma", "ECMA-262"), ("hr-time", "w3c", "hr-time-3"), ("https://www.w3.org/TR/hr-time-3/", "w3c", "hr-time-3"), ("OpenFormula", "oasis", "OpenFormula"),
    ("SP-800-57pt1r5", "nist", "SP-800-57pt1r5"), ("SP 800-57", "nist", None), ("FIPS 140-3", "nist", "FIPS-140-3"), ("IEEE 1588", "ieee", "IEEE 1588"), ("ITU-T  X.680", "itu-t", "ITU-T X.680"), ("ISO 8601", "iso", "ISO 8601"),
    ("TESTDOC", None, "TESTDOC"),
]


@query(f"""SELECT raw, CASE
  WHEN regexp_matches(x, '^(rfc)?\\s*[0-9]+$') OR starts_with(x, 'draft-') THEN 'ietf'
  WHEN (starts_with(x, 'etsi') OR regexp_matches(x, '^(ts|tr|en|es|eg|gs|gr|sr)\\s+[0-9]')) AND (regexp_matches(x, '\\b[0-9]{{3}}\\s+[0-9]{{3}}\\b') OR starts_with(x, 'etsi') OR regexp_matches(x, '^(en|es|eg|gs|gr|sr)\\b')) THEN 'etsi'
  WHEN starts_with(x, '3gpp') OR regexp_matches(x, '^(ts|tr)\\s*[0-9]{{1,2}}\\.[0-9]{{2,4}}') THEN '3gpp' WHEN starts_with(x, 'ieee') THEN 'ieee' WHEN starts_with(x, 'itu') THEN 'itu-t'
  WHEN starts_with(x, 'nist') OR starts_with(x, 'fips') OR regexp_matches(x, '^sp[-\\s]*800') THEN 'nist' WHEN starts_with(x, 'iso') THEN 'iso' WHEN starts_with(x, 'ecma') THEN 'ecma'
  WHEN starts_with(x, 'w3c') OR contains(x, '/tr/') OR regexp_matches(x, '^(hr-time|html|dom|fetch|url|encoding|webidl)(-[0-9]+)?$') THEN 'w3c'
  WHEN starts_with(x, 'oasis') OR contains(x, 'openformula') THEN 'oasis' END AS corpus
FROM (SELECT raw, lower(trim(raw)) AS x FROM ({values(IDS, 'raw, corpus, id')}))""")
def detect_corpus(spark, sf):
    return spark.createDataFrame([(i[0],) for i in IDS], "raw string").select("raw", corpora.detect_corpus(c("raw")).alias("corpus"))


@query(values([(raw, corpus or "generic", own) for raw, corpus, own in IDS], "raw, corpus, id"))
def normalize_ids(spark, sf):
    rows = spark.createDataFrame([(i[0],) for i in IDS], "raw string").withColumn("corpus", F.coalesce(corpora.detect_corpus(c("raw")), F.lit("generic")))
    return rows.select("raw", "corpus", corpora.normal_id(c("corpus"), c("raw")).alias("id"))


URLS = [
    ("https://tools.ietf.org/html/rfc5905#section-1", "https://www.rfc-editor.org/rfc/rfc5905.txt", None, "https://tools.ietf.org/html/rfc5905"),
    ("https://datatracker.ietf.org/doc/rfc0868/", "https://www.rfc-editor.org/rfc/rfc868.txt", None, "https://datatracker.ietf.org/doc/rfc0868/"),
    ("https://www.rfc-editor.org/rfc/pdfrfc/rfc8610.txt.pdf", "https://www.rfc-editor.org/rfc/pdfrfc/rfc8610.txt.pdf", "https://www.rfc-editor.org/rfc/rfc8610.txt", "https://www.rfc-editor.org/rfc/pdfrfc/rfc8610.txt.pdf"),
    ("https://user:pw@Example.com:8443/a?token=x", "https://user:pw@Example.com:8443/a?token=x", None, "https://example.com:8443/a"), ("", "", None, "<unparseable-url>"),
]


@query(values(URLS, "url, rewritten, twin, redacted"))
def url_rewrite(spark, sf):
    rows = spark.createDataFrame([(u[0],) for u in URLS], "url string")
    return rows.select("url", urls.rewrite_url(c("url")).alias("rewritten"), urls.text_twin(c("url")).alias("twin"), urls.redact_url(c("url")).alias("redacted"))


FILES = [("a/b.TXT", None, "", "text"), ("spec.tar.gz", None, "", "tar"), ("x.docx", None, "", "docx"), ("noext", "text/html; charset=utf-8", "", "html"), ("noext", None, "%PDF-1.7", "pdf"), ("noext", None, "PK..word/document.xml", "docx"), ("noext", None, "PK....", "zip"), ("noext", None, "plain words", "text"), ("noext", None, "", "unknown")]


@query(values(FILES, "name, content_type, data, kind"))
def media_type_detect(spark, sf):
    rows = spark.createDataFrame([f[:3] for f in FILES], "name string, content_type string, data string")
    return rows.withColumn("kind", urls.media_type(c("name"), c("content_type"), c("data").cast("binary")))


NAMES = [("report.json",), ("a/b c.txt",), ("..",), ("CON",), ("ok-1_2.md",), ("über.txt",)]


@query(f"""SELECT raw, CASE WHEN regexp_full_match(raw, '[A-Za-z0-9][A-Za-z0-9._-]{{0,119}}') AND NOT regexp_matches(lower(raw), '^(con|prn|aux|nul|com[0-9]|lpt[0-9])([.].*)?$') AND raw NOT LIKE '%.' THEN raw
ELSE coalesce(nullif(regexp_replace(regexp_replace(raw, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g'), ''), 'unnamed') || '-' || substr(sha256(raw), 1, 12) END AS safe FROM ({values(NAMES, 'raw')})""")
def safe_filenames(spark, sf):
    return spark.createDataFrame(NAMES, "raw string").select("raw", text.safe_filename(c("raw")).alias("safe"))


IDS_IN_ORDER = [("s-1", "s-1"), ("s-1", "s-1--3"), ("s-1--2", "s-1--2"), ("s-1", "s-1--4"), ("", "section"), ("s-2", "s-2"), (" ", "section--2")]


@query(values([(k, u) for k, (_, u) in enumerate(IDS_IN_ORDER)], "ord, id"))
def unique_section_ids(spark, sf):
    rows = spark.createDataFrame([("d", k, i[0]) for k, i in enumerate(IDS_IN_ORDER)], "doc_id string, ord int, id string")
    return segment.with_unique_ids(rows).select("ord", "id")


LINES = [("1\tScope\t25", True), ("4.2.1 General ........ 45", True), ("1 Scope", False), ("4.2.1 General", False), ("Clause 3 Terms   12", True), ("Annex A   12", False), ("", False)]


@query(values(LINES, "line, toc"))
def toc_line_flags(spark, sf):
    return spark.createDataFrame([(x[0],) for x in LINES], "line string").select("line", text.is_toc_line(c("line")).alias("toc"))


@query("""WITH x AS (SELECT w::INTEGER AS width, 340282366920938463463374607431768211455::UHUGEINT >> (128 - w)::UHUGEINT AS u FROM range(1, 129) t(w))
SELECT width, '-' || (u // 2 + 1)::VARCHAR AS smin, (u // 2)::VARCHAR AS smax, u::VARCHAR AS umax FROM x""")
def integer_bounds(spark, sf):
    return horizon.bounds_table(spark).select("width", "smin", "smax", "umax")


WIDTHS, SCALES = (8, 16, 24, 31, 32, 40, 48, 64), {"seconds": 1_000_000, "milliseconds": 1_000, "days": 86_400_000_000}


@query(f"""WITH x AS (SELECT w, s, k, u, m, epoch_us(e::TIMESTAMP) AS base, CASE WHEN s THEN (1::HUGEINT << (w - 1)) ELSE (1::HUGEINT << w) END AS past
FROM (VALUES {', '.join(f'({w})' for w in WIDTHS)}) a(w), (VALUES (true), (false)) b(s), (VALUES {', '.join(f"('{k}', '{e}')" for k, e in horizon.EPOCHS.items())}) c(k, e), (VALUES {', '.join(f"('{u}', {m}::HUGEINT)" for u, m in SCALES.items())}) d(u, m))
SELECT w AS width_bits, s AS signed, k AS epoch_kind, u AS unit, CASE WHEN base + (past - 1) * m BETWEEN -62135596800000000 AND 253402300799999999 THEN (base + (past - 1) * m)::VARCHAR END AS last_micros,
CASE WHEN base + past * m BETWEEN -62135596800000000 AND 253402300799999999 THEN (base + past * m)::VARCHAR END AS end_micros FROM x""")
def horizon_instants(spark, sf):
    rows = [(w, s, k, None, u, None, None, None) for w in WIDTHS for s in (True, False) for k in horizon.EPOCHS for u in SCALES]
    made = horizon.validate(spark.createDataFrame(rows, "width_bits int, signed boolean, epoch_kind string, epoch timestamp, unit string, ticks_per_second double, claim_value string, claim_precision string"))
    return made.select("width_bits", "signed", "epoch_kind", "unit", F.unix_micros("horizon.last").cast("string").alias("last_micros"), F.unix_micros("horizon.first_out_of_range").cast("string").alias("end_micros"))


CLAIMS = [
    # width, signed, epoch_kind, unit, ticks, claim, precision -> status, consistent
    (32, True, "unix", "seconds", None, "2038-01-19", "day", "verified", True), (32, True, "unix", "seconds", None, "2038-01-20", "day", "contradicted", False),
    (32, True, "unix", "seconds", None, "2038-01-19T03:14:07Z", "instant", "verified", True), (32, True, "unix", "seconds", None, "2038-01-19T03:14:08+00:00", "instant", "verified", True),
    (32, True, "unix", "seconds", None, "2038", "year", "verified", None), (32, False, "ntp", "seconds", None, "2036-02-07", "day", "verified", True), (32, None, "unix", "seconds", None, "2106-02-07", "day", "ambiguous_signedness", True),
    (32, None, "unix", "seconds", None, "2001-01-01", "day", "ambiguous_signedness", False), (None, True, "unix", "seconds", None, None, None, "insufficient_parameters", None), (129, True, "unix", "seconds", None, None, None, "error", None),
    (32, True, "other", "seconds", None, None, None, "insufficient_parameters", None), (32, True, None, None, None, None, None, "verified", None), (32, True, None, None, None, "2038-01-19", "day", "insufficient_parameters", None),
    (32, True, "unix", "fortnights", None, None, None, "unsupported", None), (32, True, "unix", "ticks", None, None, None, "insufficient_parameters", None), (16, False, "unix", "ticks", 1000.0, None, None, "verified", None),
    (128, False, "unix", "seconds", None, "2038-01-19", "day", "insufficient_parameters", None),
]


@query(values([(k, *x[7:]) for k, x in enumerate(CLAIMS)], "k, status, claim_consistent"))
def horizon_claims(spark, sf):
    rows = [(k, x[0], x[1], x[2], None, x[3], x[4], x[5], x[6]) for k, x in enumerate(CLAIMS)]
    made = horizon.validate(spark.createDataFrame(rows, "k int, width_bits int, signed boolean, epoch_kind string, epoch timestamp, unit string, ticks_per_second double, claim_value string, claim_precision string"))
    return made.select("k", "horizon.status", "horizon.claim_consistent")


@query("""SELECT label, day::VARCHAR AS day, day = CASE label WHEN 'y2036' THEN DATE '2036-02-07' WHEN 'y2038' THEN DATE '2038-01-19' ELSE DATE '2106-02-07' END AS matches
FROM (VALUES ('y2036'), ('y2038'), ('y2106')) a(label), (VALUES (DATE '2036-02-07'), (DATE '2038-01-19'), (DATE '2038-01-18'), (DATE '2106-02-07')) b(day)""")
def rollover_check(spark, sf):
    rows = [(label, d) for label in horizon.ROLLOVERS for d in ("2036-02-07", "2038-01-19", "2038-01-18", "2106-02-07")]
    return spark.createDataFrame(rows, "label string, day string").withColumn("matches", horizon.rollover_matches(c("label"), c("day").cast("date")))


DATED = [("wraps on 2038-01-19", ["y2038"], "verified"), ("y2038 is 2038-02-01", [], "failed"), ("in 2036-02-07 only", [], "verified"), ("2038-01-19 and 2038-01-19", [], None), ("2038-13-01", ["y2038"], None), ("1999-01-01", ["y2036"], None), ("2037-12-31 or 2038-01-19", ["y2038"], "verified")]


@query(values([(t, s) for t, _, s in DATED], "text, status"))
def iso_date_status(spark, sf):
    return spark.createDataFrame([x[:2] for x in DATED], "text string, domains array<string>").select("text", horizon.dated_status(c("text"), c("domains")).alias("status"))


GOLD = [("d", 0, "E1", "explicit_defect", "s-1", "wraps"), ("d", 1, "E2", "implied_assumption", "s-1", "wraps"), ("d", 2, "E3", "explicit_defect", "s-9", None), ("d", 3, "E4", "time_assurance_gap", None, None)]


FOUND = [("d", 0, "F-001", "implied_assumption", "s-1", ["the counter wraps"]), ("d", 1, "F-002", "explicit_defect", "s-1.2", ["it wraps too"]), ("d", 2, "F-003", "explicit_defect", "s-3", [])]


MATCHED = [("E1", "F-002", True, "matched", True), ("E2", "F-001", True, "matched", True), ("E3", None, False, "evidence constraints; section failed", None), ("E4", None, False, "type mismatch (no evidence constraints)", None)]


@query(values(MATCHED, "expected_id, matched_finding_id, matched, reason, type_agreement"))
def eval_match(spark, sf):
    labels = spark.createDataFrame(GOLD, "doc_id string, ord int, id string, finding_type string, section_id_contains string, quote_contains string")
    return evalmatch.match_findings(labels, spark.createDataFrame(FOUND, "doc_id string, idx int, id string, finding_type string, section_id string, quotes array<string>")).drop("doc_id")


ITEM = '{"finding_type": "Explicit_Defect ", "title": "t", "description": "d", "severity": "high", "confidence": "low", "domains": ["y2038", "Y2038", "epoch"], "evidence": [{"quote": "q"}], "machine_interpretation": "m", "scope_relevance": "core", "scope_rationale": "r"%s}'


RESPONSES = [
    ("ok", '{"findings": [' + ITEM % "" + "]}", 1, None, None), ("fenced", "<think>x</think>```json\n" + '{"findings": []}' + "\n```", 0, None, None), ("comma", '{"findings": [],}', 0, None, None),
    ("twice", '{"findings": [], "findings": []}', 0, "duplicate_key", False), ("nan", '{"findings": [NaN]}', 0, "number", False), ("prose", 'Here: {"findings": []}', 0, "json", True), ("list", "[]", 0, "root", True),
    ("extra", '{"findings": [' + ITEM % ', "x": 1' + "]}", 0, "unexpected_field", True), ("width", '{"findings": [' + ITEM % ', "time_representation": {"width_bits": 3200}' + "]}", 0, "invalid_field", False),
    ("boolean", '{"findings": [' + ITEM % ', "time_representation": {"width_bits": true}' + "]}", 0, "invalid_field", True), ("one_bad", '{"findings": [' + ITEM % "" + ", 1]}", 0, "not_an_object", True),
]


@query(values([(r[0], *r[2:]) for r in RESPONSES], "doc_id, n, error, repairable"))
def strict_responses(spark, sf):
    rows = spark.createDataFrame([(r[0], 0, r[1]) for r in RESPONSES], "doc_id string, request int, content string")
    return findings.parse_responses(rows).select("doc_id", F.size("findings").alias("n"), "error", "repairable")


PLANNED = [("b1", "c1", None), ("b1", "c2", "forced"), ("b2", "c1", None)]


PRIOR = [("b1", "c1", "done", 2), ("b1", "c2", "done", 1), ("b9", "c9", "done", 1)]


@query(f"SELECT p.bench_id, p.config_id, coalesce(p.status, q.status) AS status, q.attempts FROM ({values(PLANNED, 'bench_id, config_id, status')}) p LEFT JOIN ({values(PRIOR, 'bench_id, config_id, status, attempts')}) q USING (bench_id, config_id)")
def manifest_merge(spark, sf):
    planned, prior = spark.createDataFrame(PLANNED, "bench_id string, config_id string, status string"), spark.createDataFrame(PRIOR, "bench_id string, config_id string, status string, attempts int")
    return bench.merge_manifest(planned, prior)


JOBS = [("b1", "c1", "m1"), ("b1", "c2", "m2"), ("b2", "c1", "m1"), ("b2", "c2", "m2"), ("b3", "c1", "m1")]


ARTEFACTS = [("b1", "c1", True, True, "m1"), ("b1", "c2", True, False, "m2"), ("b2", "c1", True, True, "other"), ("b2", "c2", False, True, None)]


@query(f"""SELECT j.bench_id, j.config_id, CASE WHEN coalesce(a.has_json, false) AND j.model <> a.model THEN 'model' END AS mismatch,
CASE WHEN NOT coalesce(a.has_json, false) THEN CASE WHEN coalesce(a.has_markdown, false) THEN 'conflict' ELSE 'run' END WHEN j.model <> a.model THEN 'conflict' WHEN a.has_markdown THEN 'skip' ELSE 'render' END AS decision
FROM ({values(JOBS, 'bench_id, config_id, model')}) j LEFT JOIN ({values(ARTEFACTS, 'bench_id, config_id, has_json, has_markdown, model')}) a USING (bench_id, config_id)""")
def resume_classify(spark, sf):
    jobs, found = spark.createDataFrame(JOBS, "bench_id string, config_id string, model string"), spark.createDataFrame(ARTEFACTS, "bench_id string, config_id string, has_json boolean, has_markdown boolean, model string")
    return bench.classify(jobs, found, ("model",)).select("bench_id", "config_id", "mismatch", "decision")


TRIED = [(0, 0, 7, "split"), (1, 0, 3, "succeeded"), (2, 4, 7, "split"), (3, 4, 5, "split"), (4, 4, 4, "succeeded"), (5, 5, 5, "failed"), (6, 6, 7, "succeeded"), (7, 8, 8, "succeeded")]


@query(values(TRIED, "step, lo, hi, outcome"))
def recovery_attempts(spark, sf):
    ranges = spark.createDataFrame([("d", 0, 7), ("d", 8, 8)], "doc_id string, lo int, hi int")
    bad = spark.createDataFrame([("d", 5, "invalid_model_output")], "doc_id string, section int, error string")
    return recovery.recover(ranges, bad).select("step", "lo", "hi", "outcome")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_listed_cases(spark, name):
    got, want = QUERIES[name](spark, None).toPandas(), views().sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert in_order(got) == in_order(want)
