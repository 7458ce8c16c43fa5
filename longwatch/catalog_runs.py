"""Queries of runs: attempts, providers, jobs and what they leave behind, with DuckDB SQL for the same rows."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from longwatch.catalog import FORM_SQL, PACK_SQL, REVIEW_SQL, SCOPED_SQL, TOKENS_SQL, _packed, _scoped, _turns, c, query, table
from longwatch.functions import errors, moments, prompts, text
from longwatch.operators import compare, progress, report, scope
from longwatch.plans import attempts, jobs, providers, review, scan, transport
from longwatch.sources import archives
from longwatch.storage import shared_folder

# ---- two rounds of answers


def _item(ref, quote):
    token = {"finding_type": "implied_assumption", "severity": "low", "confidence": "medium", "scope_relevance": "core"}
    texts = [F.lit("x").alias(k) for k in ("title", "description", "machine_interpretation", "scope_rationale")]
    return F.struct(*[F.lit(v).alias(k) for k, v in token.items()], *texts, F.array(F.lit("epoch")).alias("domains"), F.array(F.struct(quote.alias("quote"))).alias("evidence"), ref.alias("section_id"))


def _said(*items):
    return F.to_json(F.struct(F.array(*items).alias("findings")))


def _two_rounds(spark, sf):
    """Packed turns and recorded answers: how a request's first section is long decides how its answers fail."""
    packed = _packed(spark, sf)
    first = packed.groupBy("doc_id", "chunk_index").agg(F.min_by(F.struct("ref", "text"), "ord").alias("f")).select("doc_id", c("chunk_index").alias("request"), "f.*")
    n, start = F.length("text"), F.substring("text", 1, 40)
    right, loose = _item(c("ref"), start), _item(c("ref"), F.replace(start, F.lit(" "), F.lit(" \n ")))
    by = n % 7
    said = (
        F.when(by == 0, "no JSON").when(by == 1, _said(right, _item(c("ref"), F.concat(F.lit("zq9 "), start)))).when(by == 2, _said(_item(F.lit("S9999"), start)))
        .when(by == 3, _said(loose)).when(by == 4, '{"findings": [], "findings": []}').when(by == 5, '{"findings": [{"finding').otherwise(_said(right))
    )
    one = first.select("doc_id", "request", F.lit(1).alias("attempt"), F.when(by == 5, "truncated").alias("state"), said.alias("content"))
    two = first.where((n % 2 == 0) | (n % 3 == 0)).select("doc_id", "request", F.lit(2).alias("attempt"), F.lit("ok").alias("state"), F.when(n % 2 == 0, _said(right, right)).otherwise("again no JSON").alias("content"))
    return packed, one.union(two)


ROUNDS_SQL = REVIEW_SQL + """, u AS (SELECT doc_id, chunk, n, id, text, length(text) AS size, length(text) % 7 AS m FROM a),
one AS (SELECT *, CASE m WHEN 0 THEN 'unreadable' WHEN 1 THEN 'ungrounded' WHEN 3 THEN 'ok' WHEN 6 THEN 'ok' WHEN 5 THEN 'truncated' ELSE 'invalid' END AS outcome,
  CASE m WHEN 0 THEN 'json' WHEN 1 THEN 'quote' WHEN 2 THEN 'section_id' WHEN 4 THEN 'duplicate_key' WHEN 5 THEN 'truncated' END AS failure FROM u),
two AS (SELECT doc_id, chunk, n, id, text, size, CASE WHEN m = 0 THEN 'json_repair' ELSE 'evidence_correction' END AS kind,
  CASE WHEN size = 0 THEN 'invalid' WHEN size % 2 = 0 THEN 'ok' WHEN size % 3 = 0 THEN 'unreadable' ELSE 'lost' END AS outcome,
  CASE WHEN size = 0 THEN 'invalid_field' WHEN size % 2 = 0 THEN NULL WHEN size % 3 = 0 THEN 'json' ELSE 'no_answer' END AS failure FROM one WHERE m <= 1)
"""


@query(ROUNDS_SQL + """SELECT doc_id, chunk::BIGINT AS request, 1 AS attempt, 'primary' AS kind, outcome, failure FROM one
UNION ALL SELECT doc_id, chunk, 2, kind, outcome, failure FROM two""")
def review_attempts(spark, sf):
    """Attempts of requests with first and second answers, two for each at most."""
    packed, answers = _two_rounds(spark, sf)
    return attempts.attempts(packed, attempts.recorded(answers)).drop("findings")


@query(ROUNDS_SQL + f""", k AS (SELECT doc_id, n, id, text, unnest([1]) AS part FROM one WHERE outcome = 'ok' UNION ALL SELECT doc_id, n, id, text, unnest([1, 2]) FROM two WHERE outcome = 'ok')
SELECT doc_id, format('F-{{:03d}}', row_number() OVER (PARTITION BY doc_id ORDER BY n, part)) AS id, id AS section_id, length({FORM_SQL.format('substr(text, 1, 40)')}) >= 16 AS source_verified FROM k""")
def attempt_findings(spark, sf):
    """Findings of what succeeded in either round."""
    packed, answers = _two_rounds(spark, sf)
    return attempts.attempt_findings(packed, attempts.attempts(packed, attempts.recorded(answers))).select("doc_id", "id", "section_id", "source_verified")


@query(ROUNDS_SQL + """, done AS (SELECT one.doc_id, one.chunk, one.outcome = 'ok' OR coalesce(two.outcome = 'ok', false) AS ok, (two.doc_id IS NOT NULL)::INTEGER AS repairs FROM one LEFT JOIN two ON one.doc_id = two.doc_id AND one.chunk = two.chunk),
r AS (SELECT doc_id, count(*) AS requests, sum(repairs) AS repairs FROM done GROUP BY doc_id)
SELECT t.doc_id AS run_id, any_value(r.requests)::INTEGER AS analysis_request_count, any_value(r.repairs)::INTEGER AS repair_request_count, any_value(r.requests + r.repairs)::INTEGER AS total_provider_request_count,
  CASE WHEN bool_and(ok) THEN 'complete' ELSE 'partial' END AS analysis_status, coalesce(sum(length(t.text)) FILTER (WHERE NOT ok), 0)::BIGINT AS failed_chars, 0 AS broken
FROM t JOIN done d ON t.doc_id = d.doc_id AND t.chunk = d.chunk JOIN r ON r.doc_id = t.doc_id GROUP BY t.doc_id""")
def attempt_runs(spark, sf):
    """Runs with their second requests, and how many rules they break."""
    packed, answers = _two_rounds(spark, sf)
    runs = review.reviewed_runs(packed, attempts.outcomes(attempts.attempts(packed, attempts.recorded(answers))))
    broken = report.violations(runs).groupBy("run_id").agg(F.count("*").cast("int").alias("broken"))
    out = runs.join(broken, "run_id", "left").withColumn("broken", F.coalesce("broken", F.lit(0)))
    return out.select("run_id", "analysis_request_count", "repair_request_count", "total_provider_request_count", "analysis_status", "failed_chars", "broken")


# ---- providers

MOCKED = {"findings": [{**providers.MOCK_FINDING, "section_id": "S0001"}]}
FRAME = len("UNTRUSTED_DATA kind=section_chunk chars=\ndocument_id: \ntitle: \nsection_summary: \nsection_count: \ntext:\n\nUNTRUSTED_DATA_END chars=")
HEAD = len(prompts._TASK) + len(prompts.ALLOWLIST) + 3


@query(PACK_SQL + f""", q AS (SELECT doc_id, chunk, min(n) AS lo, count(*) AS k, (sum(size) + count(*) - 1)::BIGINT AS body FROM f GROUP BY doc_id, chunk)
SELECT doc_id, chunk::BIGINT AS request, CASE WHEN lo = 1 THEN {len(json.dumps(MOCKED))} ELSE {len('{"findings": []}')} END AS content_chars,
  (({HEAD} + 7 * k - 2 + {FRAME} + length(doc_id::VARCHAR) + body + 2 * length(body::VARCHAR) + length(k::VARCHAR) + 3) // 4)::BIGINT AS input_tokens,
  CASE WHEN lo = 1 THEN {providers.tokens(json.dumps(MOCKED))} ELSE {providers.tokens('{"findings": []}')} END::BIGINT AS output_tokens, 'mock-model' AS model, 'ok' AS state FROM q""")
def mock_answers(spark, sf):
    """The mock provider's answers to all requests of packed conversations, in lanes."""
    answers = providers.ask(attempts.first_requests(_packed(spark, sf)), "mock", payload=MOCKED)
    return answers.select("doc_id", "request", F.length("content").alias("content_chars"), "input_tokens", "output_tokens", "model", "state")


SCRIPTS = [["503"], ["read_timeout", "429"], ["500", "502", "504"], ["connect"], ["401 no"], ["probe"], ["200 [1]"], ["network", "connect_timeout"]]


@query("""WITH e AS (SELECT event_id AS id, user_id % 16 AS lane, event_id % 13 AS k FROM events), p AS (SELECT lane, min(id) AS id FROM e WHERE k = 5 GROUP BY lane),
x AS (SELECT e.*, p.id IS NOT NULL AS probes, p0.id IS NULL OR e.id <= p0.id AS on_ FROM e LEFT JOIN p ON p.id = e.id AND p.lane = e.lane LEFT JOIN p p0 ON p0.lane = e.lane),
s AS (SELECT *, CASE k WHEN 0 THEN ['HTTP 503', 'ok'] WHEN 1 THEN ['read timeout', 'HTTP 429', 'ok'] WHEN 2 THEN ['HTTP 500', 'HTTP 502', 'HTTP 504'] WHEN 3 THEN ['connection failure'] WHEN 4 THEN ['HTTP 401']
  WHEN 5 THEN CASE WHEN probes THEN ['HTTP 400', 'ok'] ELSE ['ok'] END WHEN 6 THEN ['unexpected response'] WHEN 7 THEN ['network error', 'connect timeout'] ELSE ['ok'] END AS said FROM x)
SELECT lane, id, nth::INTEGER AS nth, CASE WHEN probes THEN 1 ELSE nth END::INTEGER AS attempt, said[nth] AS category,
  CASE WHEN nth < len(said) AND NOT probes THEN nth ELSE 0 END::INTEGER AS waited, on_ AND NOT (probes AND nth = 2) AS probed FROM (SELECT *, unnest(range(1, len(said) + 1)) AS nth FROM s)""")
def provider_retries(spark, sf):
    """Tries of one scripted request for each event, in lanes by user; a lane's first refusal of the feature turns it off."""
    scripts = F.array(*[F.array(*map(F.lit, s)) for s in SCRIPTS])
    script = F.coalesce(F.get(scripts, (c("event_id") % 13).cast("int")), F.array().cast("array<string>"))
    payload = F.to_json(F.struct(script.alias("script"), F.lit("json_schema").alias("response_format")))
    rows = table(spark, sf, "events").select((c("user_id") % 16).alias("lane"), c("event_id").alias("id"), payload.alias("payload"))
    return providers.send_all(rows, transport.scripted, unsupported=transport.names_response_format)


# ---- jobs


@query("""SELECT doc_id AS bench_id, config_id, 'executed' AS status, CASE WHEN doc_id % 10 = 3 THEN 2 ELSE 1 END::INTEGER AS attempts, ((length(text) + 3) // 4)::BIGINT AS tokens
FROM documents CROSS JOIN (VALUES ('openai-mini'), ('openai-luna'), ('anthropic-sonnet'), ('gemini-flash')) t(config_id)""")
def job_runs(spark, sf):
    """Jobs of all documents under all configurations, cut off after a round, resumed, and the failed ones run again."""
    docs = table(spark, sf, "documents").select(c("doc_id").alias("bench_id"), F.length("text").alias("n"))
    planned = docs.crossJoin(F.broadcast(scan.configs(spark).select("config_id")))  # four rows
    folder = f"{shared_folder(spark)}/jobs-{uuid.uuid4().hex}"
    what = jobs.Definition("bench", jobs.documents_digest(docs, ["bench_id", "n"]), tuple(x[0] for x in scan.CONFIGS))

    def work(failing: bool):
        status = F.when((c("bench_id") % 10 == 3) & F.lit(failing), "failed").otherwise("executed")
        return lambda rows: rows.select("bench_id", "config_id", status.alias("status"), text.estimate_tokens(c("n")).alias("tokens"))

    run = lambda failing, **more: jobs.run_jobs(planned, work(failing), folder, what, buckets=8, at_a_time=4, **more)
    run(True, most_rounds=1)
    run(True)
    run(False, again=("failed",))
    return jobs.job_states(planned.drop("n"), folder).select("bench_id", "config_id", "status", "attempts", "tokens")


@query(ROUNDS_SQL + """, done AS (SELECT one.doc_id, one.outcome = 'ok' AS before, one.outcome = 'ok' OR coalesce(two.outcome = 'ok', false) AS after, (two.doc_id IS NOT NULL)::INTEGER AS repairs
  FROM one LEFT JOIN two ON one.doc_id = two.doc_id AND one.chunk = two.chunk),
r AS (SELECT doc_id, sum(repairs)::VARCHAR AS repairs, CASE WHEN bool_and(before) THEN 'complete' ELSE 'partial' END AS b, CASE WHEN bool_and(after) THEN 'complete' ELSE 'partial' END AS a,
  bool_and(before)::VARCHAR AS cb, bool_and(after)::VARCHAR AS ca FROM done GROUP BY doc_id)
SELECT doc_id AS run_id, 'repair_request_count' AS field, '0' AS "left", repairs AS "right" FROM r WHERE repairs <> '0'
UNION ALL SELECT doc_id, 'analysis_status', b, a FROM r WHERE a <> b UNION ALL SELECT doc_id, 'coverage_complete', cb, ca FROM r WHERE ca <> cb""")
def report_differences(spark, sf):
    """Fields in which runs of one round of answers differ from runs of two."""
    packed, answers = _two_rounds(spark, sf)
    tried = attempts.attempts(packed, attempts.recorded(answers))
    one, two = (review.reviewed_runs(packed, attempts.outcomes(t)) for t in (tried.where("attempt = 1"), tried))
    return compare.differences(one, two, ["run_id"], (*compare.FIELDS, "analysis_status", "total_input_tokens"))


# ---- archives


@query("""SELECT doc_id, strlen(text)::BIGINT AS size, CASE WHEN strlen(text) <= 20000 THEN sha256(text) END AS content_sha256, CASE WHEN strlen(text) > 20000 THEN 'member too large' END AS error
FROM documents WHERE doc_id % 5 <> 0""")
def archive_members(spark, sf):
    """Documents packed into archives by Spark, and read again as their members, of which a filter on names keeps four of five."""
    folder = f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"

    def write(key, pdf):
        number = int(key[0])
        kind = "zip" if number % 2 else "tar"
        members = [(f"{'drop' if i % 5 == 0 else 'keep'}/doc-{i}.txt", (t or "").encode()) for i, t in sorted(zip(pdf.doc_id, pdf.text, strict=True))]
        archives.put(f"{folder}/{number}.{kind}", archives.packed(kind, members))
        return pdf[[]].assign(n=[]) if not len(pdf) else pdf[["doc_id"]].head(1).assign(n=len(members))[["n"]]

    docs = table(spark, sf, "documents").select("doc_id", "text", F.floor(c("doc_id") / 40).alias("archive"))
    docs.groupBy("archive").applyInPandas(write, "n long").agg(F.sum("n")).collect()
    archives.register(spark)
    read = spark.read.format("archives").option("maxMemberBytes", 20000).option("maxRatio", 1e9).load(folder).where(c("name").startswith("keep/"))
    doc_id = F.regexp_extract("name", r"doc-(-?\d+)\.txt", 1).cast("long")
    return read.select(doc_id.alias("doc_id"), "size", F.when(c("content").isNotNull(), F.sha2("content", 256)).alias("content_sha256"), "error")


# ---- moments, errors and counters

MOMENTS_SQL = """WITH e AS (SELECT event_id, ts, event_id % 12 AS k, date_trunc('day', ts) AS d FROM events),
m AS (SELECT event_id, k, CASE k WHEN 2 THEN d WHEN 3 THEN d WHEN 4 THEN date_trunc('second', ts) WHEN 5 THEN date_trunc('minute', ts) WHEN 6 THEN date_trunc('second', ts) WHEN 7 THEN ts - INTERVAL 330 MINUTE
  WHEN 8 THEN date_trunc('hour', ts) + INTERVAL 8 HOUR END AS moment, d FROM e)
"""


@query(MOMENTS_SQL + """SELECT event_id, CASE WHEN k IN (0, 1, 9) THEN strftime(d, '%Y-%m-%d') WHEN k < 9 THEN strftime(moment, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(moment) % 1000000 <> 0 THEN strftime(moment, '.%f') ELSE '' END || 'Z' END AS value,
CASE WHEN k IN (0, 1, 9) THEN 'day' WHEN k < 9 THEN 'instant' END AS precision FROM m""")
def legacy_claims(spark, sf):
    """Horizons that old reports claim as texts, in all forms of a moment."""
    at = lambda form: F.date_format("ts", form)
    day = at("yyyy-MM-dd")
    week = F.format_string("%04d-W%02d-%d", F.expr("extract(YEAROFWEEK FROM ts)").cast("int"), F.weekofyear("ts"), F.weekday("ts") + 1)
    forms = [
        day, F.concat(day, F.lit("Z")), at("yyyyMMdd"), week, at("yyyy-MM-dd'T'HH:mm:ss'Z'"), at("yyyy-MM-dd HH:mm"), at("yyyyMMdd'T'HHmmss"), F.concat(at("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+05:30")),
        at("yyyy-MM-dd'T'HH'-0800'"), F.concat(day, F.lit("T at noon")), F.concat(F.lit("around "), at("yyyy")), F.lit(""),
    ]
    rows = table(spark, sf, "events").select("event_id", F.get(F.array(*forms), (c("event_id") % 12).cast("int")).alias("text"))
    return rows.select("event_id", moments.legacy_claim(c("text")).alias("m")).select("event_id", "m.value", "m.precision")


@query("""WITH t AS (SELECT conv_id, turn, length(text) % 9 AS k, replace(replace(substr(text, 1, 40), chr(10), ' '), '"', '') AS x FROM conversations)
SELECT conv_id, turn, family, CASE WHEN family = 'openai' THEN k IN (0, 2) ELSE k = 1 END AS unsupported, CASE k WHEN 0 THEN 37 WHEN 1 THEN 54 WHEN 2 THEN length(x) + 38 WHEN 3 THEN length(x) + 9 WHEN 4 THEN 22 WHEN 5 THEN 28 ELSE 0 END::INTEGER AS message_chars
FROM t, (VALUES ('openai'), ('gemini')) f(family)""")
def provider_errors(spark, sf):
    """Classes of error bodies made around turns, broken JSON and other shapes included."""
    start = F.replace(F.replace(F.substring("text", 1, 40), F.lit("\n"), F.lit(" ")), F.lit('"'), F.lit(""))
    body = lambda message, **more: F.to_json(F.struct(F.struct(F.lit(message).alias("message") if isinstance(message, str) else message.alias("message"), *[F.lit(v).alias(k) for k, v in more.items()]).alias("error")))
    name = F.lit("Unknown name \"responseSchema\" at 'generation_config': ")
    bodies = [
        body("Unknown parameter: 'response_format'.", param="response_format", code="unknown_parameter"), F.to_json(F.struct(F.array(F.struct(name.alias("message"), F.lit(400).alias("code"))).alias("error"))),
        body(F.concat(start, F.lit(": it does not support json_schema yet."))), body(F.concat(F.lit("see here "), start), code="invalid_json_schema"), body("Unknown field: 'user'."), body("json_schema is not supported", param="messages"),
        F.substring(body(start), 1, 20), F.to_json(F.struct(F.struct(F.lit(True).alias("message"), F.lit(400).alias("code")).alias("error"))), F.concat(F.lit("no JSON: response_format is not supported "), start),
    ]
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.get(F.array(*bodies), (F.length("text") % 9).cast("int")).alias("body"), F.explode(F.array(F.lit("openai"), F.lit("gemini"))).alias("family"))
    rows = rows.withColumn("fields", errors.error_fields(c("body")))
    return rows.select("conv_id", "turn", "family", errors.unsupported_feature(c("family"), c("fields")).alias("unsupported"), F.length("fields.message").alias("message_chars"))


@query(f"""SELECT unnest(['sections', 'chars', 'tokens', 'longest', 'empty', 'without_document']) AS counter, unnest([count(*), sum(length(text)), sum({TOKENS_SQL}), max(length(text)), count(*) FILTER (WHERE length(text) = 0), count(*) FILTER (WHERE conv_id IS NULL)])::BIGINT AS value
FROM conversations""")
def observed_counters(spark, sf):
    """Counters of all turns, taken while another action reads them."""
    rows, seen = progress.watched(_turns(spark, sf), "turns")
    rows.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame(list(seen.get.items()), "counter string, value long")


# ---- reports


@query(ROUNDS_SQL + """, done AS (SELECT one.doc_id, one.chunk, one.outcome = 'ok' OR coalesce(two.outcome = 'ok', false) AS ok, CASE WHEN coalesce(two.outcome, one.outcome) = 'truncated' THEN 'truncated\\_output' ELSE 'invalid\\_model\\_output' END AS category
  FROM one LEFT JOIN two ON one.doc_id = two.doc_id AND one.chunk = two.chunk),
x AS (SELECT t.doc_id, count(*) FILTER (WHERE ok) AS good, count(*) FILTER (WHERE NOT ok) AS bad, coalesce(sum(length(t.text)) FILTER (WHERE ok), 0) AS good_chars, coalesce(sum(length(t.text)) FILTER (WHERE NOT ok), 0) AS bad_chars,
  string_agg('`' || t.id || '`', ', ' ORDER BY t.n) FILTER (WHERE NOT ok) AS ids, string_agg('`' || t.id || '` (' || category || ')', '; ' ORDER BY t.n) FILTER (WHERE NOT ok) AS lost
  FROM t JOIN done d ON t.doc_id = d.doc_id AND t.chunk = d.chunk GROUP BY t.doc_id)
SELECT doc_id AS run_id, '**Analysis status:** ' || CASE WHEN bad > 0 THEN 'PARTIAL  ' || chr(10) || 'INCOMPLETE' ELSE 'COMPLETE  ' END || chr(10)
  || '**Execution coverage:** successfully analyzed ' || good || ' sections, ' || format('{:,}', good_chars::BIGINT) || ' chars; unanalyzed/failed ' || bad || ' sections, ' || format('{:,}', bad_chars::BIGINT) || ' chars  '
  || CASE WHEN bad > 0 THEN chr(10) || '**Failed section ids:** ' || ids || '  ' || chr(10) || '**Unanalyzed sections:** ' || lost || '  ' || chr(10) || '**Adaptive recovery:** 0 splits, 0 extra model requests  ' ELSE '' END AS lines FROM x""".replace("INCOMPLETE", report.INCOMPLETE))
def report_status_lines(spark, sf):
    """Heads of reports of runs with two rounds of answers."""
    packed, answers = _two_rounds(spark, sf)
    runs = review.reviewed_runs(packed, attempts.outcomes(attempts.attempts(packed, attempts.recorded(answers))))
    return runs.select("run_id", F.array_join(report.status_lines(), "\n").alias("lines"))


@query(SCOPED_SQL + f""", x AS (SELECT doc_id, eligible_sections, eligible_chars, count(*) FILTER (WHERE inside) AS n, (sum(chars) FILTER (WHERE inside)) AS ac, bool_or(NOT inside OR chars < full_chars) AS cut FROM k JOIN e USING (doc_id) GROUP BY ALL)
SELECT doc_id AS run_id, '**Analysis scope:** ' || CASE WHEN cut THEN 'PARTIAL' ELSE 'COMPLETE' END || '  ' || chr(10) || '**Coverage:** ' || printf('%.1f', least(100.0, 100.0 * ac / eligible_chars)) || '% of eligible text analyzed  ' || chr(10)
  || '**Scope detail:** sections ' || n || '/' || eligible_sections || ' eligible; chars ' || format('{{:,}}', ac::BIGINT) || '/' || format('{{:,}}', eligible_chars::BIGINT) || ' eligible  ' || chr(10) || '{report.RELATIVE}'
  || CASE WHEN cut THEN chr(10) || '**Scope note:** Capped after ' || n || ' sections\\_.  ' ELSE '' END AS lines FROM x""")
def report_coverage_lines(spark, sf):
    """Heads of reports about conversations whose scope is capped."""
    sums = scope.scope_counters(_turns(spark, sf), _scoped(spark, sf))
    notes = F.array(F.lit("Front matter was left out."), F.concat(F.lit("Capped after "), c("analyzed_sections").cast("string"), F.lit(" sections_.")))
    runs = sums.select(c("doc_id").alias("run_id"), c("truncated").alias("scope_truncated"), c("analyzed_sections").alias("sections_analyzed"), "eligible_sections", F.lit(None).cast("int").alias("sections_total"), "analyzed_chars", "eligible_chars", notes.alias("scope_notes"), "coverage_percent")
    return runs.select("run_id", F.array_join(report.coverage_lines(c("coverage_percent")), "\n").alias("lines"))


VERSION_LIST = "['" + "', '".join(report.VERSIONS) + "']"


@query(f"""WITH p AS (SELECT page_id, {VERSION_LIST}[page_id % 6 + 1] AS v, page_id % 6 + 1 AS rank, page_id % 3 AS k, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*[^?#]*)', 1) AS plain FROM pages WHERE regexp_matches(url, '^https?://[a-z0-9.-]+(/[^?#]*)?([?#].*)?$'))
SELECT page_id AS run_id, v AS version, plain AS source, CASE WHEN k = 2 THEN plain || '/copy' END AS retrieved, rank >= 5 AS has_batching, rank >= 6 AS has_recovery, rank <= 2 AS plain_claim, k <> 2 AS hidden, 'https://x.org/a' AS deep FROM p""")
def report_json_forms(spark, sf):
    """Reports about pages in the forms of all versions: redacted addresses at any depth, fields by version, claims. (K1, V3)"""
    pages = table(spark, sf, "pages").where(c("url").rlike(r"^https?://[a-z0-9.-]+(/[^?#]*)?([?#].*)?$")).select("page_id", "url")
    k = c("page_id") % 3
    bare = F.regexp_replace("url", r"[?#].*$", "")
    retrieved = F.when(k == 0, F.lit(None).cast("string")).when(k == 1, F.concat(bare, F.lit("?other=1"))).otherwise(F.concat(bare, F.lit("/copy#f")))
    runs = pages.select(
        c("page_id").alias("run_id"), F.get(F.array(*map(F.lit, report.VERSIONS)), (c("page_id") % 6).cast("int")).alias("schema_version"),
        F.struct(F.concat(F.regexp_replace("url", "://", "://user:pw@")).alias("source_uri"), retrieved.alias("retrieved_uri")).alias("document"), F.lit("section_chunks").alias("request_batching"), F.lit("complete").alias("analysis_status"),
    )
    claim = F.struct(F.lit("2038").alias("value"), F.lit("year").alias("precision"))
    own = pages.select(c("page_id").alias("run_id"), F.lit(0).alias("ord"), F.struct(claim.alias("claimed_horizon")).alias("time_representation"), F.array(F.struct(F.lit("https://me@x.org/a?q#f").alias("url"))).alias("links"))
    made = report.report_json(runs, own)
    get = lambda path: F.get_json_object("json", path)
    has = lambda name: F.contains(c("json"), F.lit(f'"{name}":'))
    return made.select(
        "run_id", get("$.schema_version").alias("version"), get("$.document.source_uri").alias("source"), get("$.document.retrieved_uri").alias("retrieved"), has("request_batching").alias("has_batching"), has("analysis_status").alias("has_recovery"),
        (get("$.findings[0].time_representation.claimed_horizon") == "2038").alias("plain_claim"), (~has("retrieved_uri")).alias("hidden"), get("$.findings[0].links[0].url").alias("deep"),
    )
