"""Every query of the engine, with DuckDB SQL for the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from longwatch.functions import horizon, pricing, text, urls, usage
from longwatch.functions.folds import bound
from longwatch.operators import bench, chunks, corpora, findings, grounding, recovery, report, scope, segment
from longwatch.plans import review, scan
from longwatch.sources import convert
from longwatch.streaming import arrivals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
c = F.col


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(rows: list[tuple], names: str) -> str:
    """SQL that gives literal rows."""

    def lit(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).upper()
        if isinstance(x, list):
            return "[" + ", ".join(map(lit, x)) + "]"
        return repr(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS t({names})"


# ---- token estimates, modes and costs

TOKENS_SQL = "CASE WHEN length(text) = 0 THEN 0 ELSE (length(text) + 3) // 4 END"


@query(f"SELECT lang, count(*) AS n_docs, sum(length(text))::BIGINT AS chars, sum({TOKENS_SQL})::BIGINT AS tokens FROM documents GROUP BY lang")
def token_estimate_by_lang(spark, sf):
    size = F.length("text")
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(size).alias("chars"), F.sum(text.estimate_tokens(size)).alias("tokens"))


@query("SELECT doc_id, sha256(text) AS content_sha256, length(text) AS char_count FROM documents")
def document_identity(spark, sf):
    return corpora.document_identity(table(spark, sf, "documents"))


SMALL = ("local-small", "local", "small")


def _models(spark):
    return scan.configs(spark, (*scan.CONFIGS, SMALL)).withColumn("window", F.when(c("provider") == "local", 24000).otherwise(c("window")))


CONFIG_SQL = """configs(config_id, provider, model, context, in_cents, out_cents) AS (VALUES
  ('openai-mini', 'openai', 'gpt-4.1-mini', 1000000, 40, 160), ('openai-luna', 'openai', 'gpt-6-luna', 1050000, 10, 50), ('anthropic-sonnet', 'anthropic', 'claude-sonnet-4-5', 200000, 300, 1500),
  ('gemini-flash', 'gemini', 'gemini-3.6-flash', 1000000, 150, 750), ('local-small', 'local', 'small', 24000, NULL, NULL))"""


@query(f"""WITH {CONFIG_SQL}, d AS (SELECT doc_id, ({TOKENS_SQL})::BIGINT AS tokens FROM documents)
SELECT doc_id, config_id, tokens, CASE WHEN tokens <= context - 16384 - 6000 THEN 'whole_document' ELSE 'section_aware' END AS mode FROM d CROSS JOIN configs""")
def plan_mode_by_config(spark, sf):
    return scan.document_modes(table(spark, sf, "documents"), _models(spark)).select("doc_id", "config_id", "tokens", "mode")


def _costed(spark, sf):
    rows = scan.request_costs(scan.document_modes(table(spark, sf, "documents"), _models(spark)))
    rate_in, rate_out = pricing.rates(c("provider"), c("model"), c("input_tokens"), c("input_rate"), c("output_rate"))
    cents = lambda r: F.round(r * 100).cast("long")
    return rows.withColumn("units", c("input_tokens") * cents(rate_in) + c("output_tokens") * cents(rate_out))


COSTED_SQL = f"""WITH {CONFIG_SQL}, d AS (SELECT doc_id, ({TOKENS_SQL})::BIGINT + 6000 AS input_tokens FROM documents),
costed AS (SELECT doc_id, config_id, input_tokens, 4096 AS output_tokens,
  (input_tokens * CASE WHEN model = 'gpt-6-luna' AND input_tokens > 272000 THEN 20 ELSE in_cents END
   + 4096 * CASE WHEN model = 'gpt-6-luna' AND input_tokens > 272000 THEN 75 ELSE out_cents END)::BIGINT AS units FROM d CROSS JOIN configs)
"""


@query(COSTED_SQL + """SELECT config_id, count(*) AS n_docs, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens,
CASE WHEN count(units) = count(*) THEN sum(units)::BIGINT END AS hundredths_of_micro_usd, count(units) AS priced FROM costed GROUP BY config_id""")
def plan_cost_by_config(spark, sf):
    """Totals by configuration: a whole price only where every document has one."""
    total = F.when(F.count("units") == F.count("*"), F.sum("units"))
    return _costed(spark, sf).groupBy("config_id").agg(F.count("*").alias("n_docs"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), total.alias("hundredths_of_micro_usd"), F.count("units").alias("priced"))


@query(COSTED_SQL + """SELECT doc_id, max(units) FILTER (WHERE config_id = 'anthropic-sonnet') AS "anthropic-sonnet", max(units) FILTER (WHERE config_id = 'gemini-flash') AS "gemini-flash",
max(units) FILTER (WHERE config_id = 'local-small') AS "local-small", max(units) FILTER (WHERE config_id = 'openai-luna') AS "openai-luna", max(units) FILTER (WHERE config_id = 'openai-mini') AS "openai-mini" FROM costed GROUP BY doc_id""")
def plan_pivot(spark, sf):
    return bench.pivot_costs(_costed(spark, sf).withColumn("usd", c("units")), ["anthropic-sonnet", "gemini-flash", "local-small", "openai-luna", "openai-mini"])


@query(f"SELECT doc_id, tokens + 6000 + 4096 AS planned, tokens + 6000 + 4096 <= 12000 AS within_budget FROM (SELECT doc_id, ({TOKENS_SQL})::BIGINT AS tokens FROM documents)")
def budget_guard(spark, sf):
    planned = pricing.request_input_tokens(text.estimate_tokens(F.length("text"))) + pricing.WHOLE_DOCUMENT_OUTPUT
    return table(spark, sf, "documents").select("doc_id", planned.alias("planned"), (planned <= 12000).alias("within_budget"))


# ---- identity, URLs and formats


@query("SELECT page_id, regexp_extract(url, '^[^?#]*') AS redacted, regexp_matches(url, '^https?://[^/?#]*/+[^/?#]+/+[^/?#]') OR regexp_matches(regexp_extract(url, '^[^?#]*'), '[.]html?$') AS is_document FROM pages")
def url_redact(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.redact_url(c("url")).alias("redacted"), urls.is_document_url(c("url")).alias("is_document"))


@query()
def html_to_text(spark, sf):
    return convert.html_pages(table(spark, sf, "pages"))


# ---- grounding

FORM_SQL = r"trim(regexp_replace(replace(lower({0}), 'ß', 'ss'), '[\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]+', ' ', 'g'))"
FORMS_SQL = f"WITH d AS (SELECT doc_id, {FORM_SQL.format('text')} AS s FROM documents), b AS (SELECT item_id, {FORM_SQL.format('text')} AS q FROM benchmark WHERE length({FORM_SQL.format('text')}) >= 16)\n"


@query(FORMS_SQL + "SELECT doc_id, item_id FROM d JOIN b ON contains(s, q)")
def quote_containment(spark, sf):
    return grounding.quote_pairs(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("SELECT doc_id, item_id, ((length(d.text) - length(replace(d.text, b.text, ''))) // length(b.text))::INTEGER AS n_spans, CASE WHEN (length(d.text) - length(replace(d.text, b.text, ''))) // length(b.text) = 1 THEN instr(d.text, b.text) - 1 END AS span_start FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def quote_span_counts(spark, sf):
    """Exact spans of the quotes that the candidate join found."""
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    pairs = grounding.quote_pairs(docs, items).join(docs.select("doc_id", c("text").alias("source")), "doc_id").join(items.select("item_id", c("text").alias("quote")), "item_id")
    return grounding.quote_spans(pairs, flexible=False).where("n_spans > 0").select("doc_id", "item_id", "n_spans", "span_start")


@query(f"""WITH e AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS quote, generate_subscripts(string_split(text, chr(10)), 1) AS finding_id FROM documents
  UNION ALL SELECT doc_id, b.text, 0 FROM documents JOIN benchmark b ON doc_id = item_id),
q AS (SELECT doc_id, finding_id, coalesce({FORM_SQL.format('quote')}, '') AS q FROM e), d AS (SELECT doc_id, coalesce({FORM_SQL.format('text')}, '') AS s FROM documents),
v AS (SELECT doc_id, finding_id, s, q, length(q) >= 16 AND contains(s, q) AS hit FROM q JOIN d USING (doc_id))
SELECT doc_id, finding_id::INTEGER AS finding_id, hit AS source_verified, CASE WHEN q = '' THEN 'No evidence quotes to verify against source.' WHEN s = '' THEN 'Analyzed document text is empty; cannot verify evidence quotes.'
  WHEN length(q) < 16 THEN 'Evidence quotes shorter than 16 characters after normalization; skipped source check.' ELSE 'Matched ' || hit::INTEGER || ' of 1 evidence quote(s) in analyzed document text.' END AS detail FROM v""")
def source_verification(spark, sf):
    """Every line of a document and the benchmark item of its number, as quotes of the document."""
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "quote")).select("doc_id", (c("n") + 1).alias("finding_id"), "quote")
    others = items.select(c("item_id").alias("doc_id"), F.lit(0).alias("finding_id"), c("text").alias("quote")).join(docs.select("doc_id"), "doc_id")
    evidence = lines.unionByName(others).withColumn("section_id", F.lit("all"))
    return grounding.verify_sources(evidence, docs.select("doc_id", F.lit("all").alias("section_id"), "text"))


# ---- sections, scope and chunks


def _turns(spark, sf):
    """Conversations as documents: a turn is a section."""
    t = table(spark, sf, "conversations")
    return t.select(
        c("conv_id").alias("doc_id"), c("turn").cast("int").alias("ord"), F.concat(F.lit("s-"), "turn").alias("id"), c("role").alias("title"), "text", F.lit(1).alias("level"),
        F.lit(0).alias("start_char"), F.length("text").alias("end_char"), F.lit(None).cast("string").alias("parent_id"),
    )


SCOPED_SQL = """WITH r AS (SELECT conv_id AS doc_id, turn AS ord, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
e AS (SELECT doc_id, count(*) AS eligible_sections, sum(length(text)) AS eligible_chars FROM r GROUP BY doc_id),
t AS (SELECT doc_id, ord, n, length(text) AS full_chars, CASE WHEN n = 1 THEN least(length(text), 600, 480) ELSE length(text) END AS chars FROM r),
w AS (SELECT *, sum(chars) OVER p AS sc, sum((chars + 3) // 4) OVER p AS st FROM t WINDOW p AS (PARTITION BY doc_id ORDER BY ord)),
k AS (SELECT *, n <= 5 AND (n = 1 OR (sc <= 600 AND st <= 120)) AS inside FROM w)
"""


def _scoped(spark, sf):
    return scope.apply_scope(_turns(spark, sf), max_sections=5, max_chars=600, max_input_tokens=120)


@query(SCOPED_SQL + "SELECT doc_id, ord, chars FROM k WHERE inside")
def scope_caps(spark, sf):
    return _scoped(spark, sf).select("doc_id", c("ord").cast("long").alias("ord"), F.length("text").cast("long").alias("chars"))


@query(SCOPED_SQL + """SELECT doc_id, eligible_sections, eligible_chars::BIGINT AS eligible_chars, count(*) FILTER (WHERE inside) AS analyzed_sections, (sum(chars) FILTER (WHERE inside))::BIGINT AS analyzed_chars,
bool_or(NOT inside OR chars < full_chars) AS truncated, least(100.0, 100.0 * (sum(chars) FILTER (WHERE inside)) / eligible_chars)::DOUBLE AS coverage_percent FROM k JOIN e USING (doc_id) GROUP BY doc_id, eligible_sections, eligible_chars""")
def scope_counters(spark, sf):
    return scope.scope_counters(_turns(spark, sf), _scoped(spark, sf)).select("doc_id", "eligible_sections", "eligible_chars", "analyzed_sections", "analyzed_chars", "truncated", "coverage_percent")


@query("""WITH t AS (SELECT doc_id, length(text) AS n, CASE WHEN length(text) = 0 THEN 0 ELSE (length(text) + 3) // 4 END AS k FROM documents),
x AS (SELECT doc_id, n, k, least(n, 2000) AS an, CASE WHEN n = 0 THEN 0 ELSE (least(n, 2000) + 3) // 4 END AS ak FROM t)
SELECT doc_id, 100.0::DOUBLE AS sections_pct, CASE WHEN n = 0 THEN 100.0 ELSE 100.0 * an / n END::DOUBLE AS chars_pct, CASE WHEN k = 0 THEN 100.0 ELSE 100.0 * ak / k END::DOUBLE AS tokens_pct,
CASE WHEN n = 0 THEN 100.0 ELSE least(100.0, 100.0 * an / (2 * n)) END::DOUBLE AS chars_pct_of_document, CASE WHEN k = 0 THEN 100.0 ELSE least(100.0, 100.0 * ak / (2 * k)) END::DOUBLE AS tokens_pct_of_document FROM x""")
def plan_coverage(spark, sf):
    """Shares of documents of which the first 2000 characters are analysed and half is eligible."""
    n = F.length("text")
    k, done = text.estimate_tokens(n), F.least(n, F.lit(2000))
    rows = table(spark, sf, "documents").select(
        "doc_id", F.lit(1).alias("analyzed_sections"), F.lit(1).alias("eligible_sections"), done.alias("analyzed_chars"), n.alias("eligible_chars"), (2 * n).alias("document_chars"),
        text.estimate_tokens(done).alias("analyzed_tokens"), k.alias("eligible_tokens"), (2 * k).alias("document_tokens"),
    )
    return scope.coverage_shares(rows).select("doc_id", "sections_pct", "chars_pct", "tokens_pct", "chars_pct_of_document", "tokens_pct_of_document")


PACK_SQL = """WITH RECURSIVE s AS (
  SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, 's-' || turn AS id,
         length(role) + length(text) + length('--- SECTION ref=S0001 ---') + 1 + length('section_title: ') + 1 + length('text:') + 1 + 1 + length('--- END SECTION ref=S0001 ---') AS size FROM conversations
), f AS (
  SELECT doc_id, n, id, size, 0 AS chunk, 1 AS k, size AS body FROM s WHERE n = 1
  UNION ALL
  SELECT s.doc_id, s.n, s.id, s.size, CASE WHEN x.new THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN x.new THEN 1 ELSE f.k + 1 END, CASE WHEN x.new THEN s.size ELSE f.body + 1 + s.size END
  FROM f JOIN s ON s.doc_id = f.doc_id AND s.n = f.n + 1,
  LATERAL (SELECT f.k >= 3 OR 16384 + 6000 + (FRAME + (f.body + 1 + s.size) + 2 * length((f.body + 1 + s.size)::VARCHAR) + length((f.k + 1)::VARCHAR) + 3) // 4 > 22684 AS new) x
)
""".replace("FRAME", str(len("UNTRUSTED_DATA kind=section_chunk chars=\ndocument_id: \ntitle: \nsection_summary: \nsection_count: \ntext:\n\nUNTRUSTED_DATA_END chars=")))


def _packed(spark, sf):
    return chunks.pack(_turns(spark, sf), window=22684, cap=3)


@query(PACK_SQL + "SELECT doc_id, id, format('S{:04d}', n) AS ref, chunk::BIGINT AS chunk_index FROM f")
def section_chunk_packing(spark, sf):
    return _packed(spark, sf).select("doc_id", "id", "ref", "chunk_index")


@query(PACK_SQL + """SELECT doc_id, chunk::BIGINT AS chunk_index, sections, (6000 + (FRAME + body + 2 * length(body::VARCHAR) + length(sections::VARCHAR) + 3) // 4)::BIGINT AS est_in, least(16384, 1500 * sections)::BIGINT AS est_out
FROM (SELECT doc_id, chunk, count(*) AS sections, (sum(size) + count(*) - 1)::BIGINT AS body FROM f GROUP BY doc_id, chunk)""".replace("FRAME", str(len("UNTRUSTED_DATA kind=section_chunk chars=\ndocument_id: \ntitle: \nsection_summary: \nsection_count: \ntext:\n\nUNTRUSTED_DATA_END chars="))))
def chunk_requests(spark, sf):
    return chunks.requests(_packed(spark, sf)).select("doc_id", "chunk_index", "sections", "est_in", "est_out")


VIEWS_SQL = (PACK_SQL + """, q AS (SELECT doc_id, chunk, (6000 + (FRAME + body + 2 * length(body::VARCHAR) + length(sections::VARCHAR) + 3) // 4)::BIGINT AS est_in, lo, hi
FROM (SELECT doc_id, chunk, count(*) AS sections, (sum(size) + count(*) - 1)::BIGINT AS body, min(n) AS lo, max(n) AS hi FROM f GROUP BY doc_id, chunk))""").replace("FRAME", str(len("UNTRUSTED_DATA kind=section_chunk chars=\ndocument_id: \ntitle: \nsection_summary: \nsection_count: \ntext:\n\nUNTRUSTED_DATA_END chars=")))


@query(VIEWS_SQL.replace(", q AS", """, o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS stop, length(text) AS size FROM conversations), q AS""") + """
SELECT q.doc_id, (chunk + 1)::BIGINT AS number, est_in, (a.stop - a.size)::BIGINT AS start_char, b.stop::BIGINT AS end_char FROM q JOIN o a ON a.conv_id = q.doc_id AND a.n = q.lo JOIN o b ON b.conv_id = q.doc_id AND b.n = q.hi""")
def request_views(spark, sf):
    """Numbered requests of conversations with their spans."""
    order = Window.partitionBy("doc_id").orderBy("ord")
    stop = F.sum(F.length("text")).over(order)
    spans = _packed(spark, sf).drop("start_char", "end_char").withColumn("end_char", stop).withColumn("start_char", c("end_char") - F.length("text"))
    return chunks.request_views(spans).select("doc_id", c("index").cast("long").alias("number"), "est_in", "start_char", "end_char")


@query(VIEWS_SQL + """
SELECT doc_id, count(*) AS requests, min(est_in) AS lowest, max(est_in) AS highest,
'estimated input/request: ' || CASE WHEN min(est_in) = max(est_in) THEN format('{:,}', min(est_in)) ELSE format('{:,}', min(est_in)) || ' to ' || format('{:,}', max(est_in)) END || ' tokens' AS line FROM q GROUP BY doc_id""")
def request_range(spark, sf):
    """The line of a plan that tells its requests' input tokens."""
    return chunks.input_range(chunks.requests(_packed(spark, sf)))


@query(f"""WITH t AS (SELECT lang, doc_id, ({TOKENS_SQL}) * 100 + 6000 AS tokens FROM documents),
p(provider, model) AS (VALUES ('openai', 'gpt-6-luna'), ('openai', 'gpt-4.1-mini'), ('nobody', 'none')),
r AS (SELECT *, CASE WHEN model = 'gpt-6-luna' THEN CASE WHEN tokens > 272000 THEN 'GPT-6 Luna long-context rates' ELSE 'GPT-6 Luna short-context rates' END ELSE 'indicative table rates' END AS label FROM t, p),
n AS (SELECT lang, provider, model, label, count(*) AS n, min(doc_id) AS first FROM r GROUP BY ALL)
SELECT lang, provider, model, 'pricing: ' || CASE WHEN provider = 'nobody' THEN 'USD estimate unavailable (no table entry for nobody:none)' ELSE string_agg(n || CASE WHEN n = 1 THEN ' request uses ' ELSE ' requests use ' END || label, '; ' ORDER BY first) END AS line FROM n GROUP BY lang, provider, model""")
def pricing_lines(spark, sf):
    """One plan for each language and model, a request for each document."""
    models = pricing.with_prices(spark.createDataFrame([("openai", "gpt-6-luna"), ("openai", "gpt-4.1-mini"), ("nobody", "none")], "provider string, model string"))
    tokens = pricing.request_input_tokens(text.estimate_tokens(F.length("text")) * 100)
    rows = table(spark, sf, "documents").select("lang", "doc_id", tokens.alias("tokens")).crossJoin(F.broadcast(models))  # three rows
    rows = rows.withColumn("tier", pricing.pricing_tier(c("provider"), c("model"), c("tokens"), c("input_rate")))
    plans = rows.groupBy("lang", "provider", "model").agg(F.sort_array(F.collect_list(F.struct("doc_id", "tier")))["tier"].alias("tiers"))
    return plans.select("lang", "provider", "model", pricing.pricing_line(c("tiers"), c("provider"), c("model")).alias("line"))


ENVELOPE_SQL = r"""WITH b AS (SELECT conv_id AS doc_id, count(*) AS k, string_agg(format('--- SECTION ref=S{:04d} ---', n) || chr(10) || 'section_title: ' || role || chr(10) || 'text:' || chr(10) || text || chr(10) || format('--- END SECTION ref=S{:04d} ---', n), chr(10) ORDER BY n) AS body
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY conv_id)
SELECT doc_id, sha256('UNTRUSTED_DATA kind=section_chunk chars=' || length(body) || chr(10) || 'document_id: ' || doc_id || chr(10) || 'title: ' || chr(10) || 'section_summary: ' || chr(10) || 'section_count: ' || k || chr(10) || 'text:' || chr(10) || body || chr(10) || 'UNTRUSTED_DATA_END chars=' || length(body)) AS envelope_sha256 FROM b"""


@query(ENVELOPE_SQL)
def role_envelope(spark, sf):
    packed = chunks.pack(_turns(spark, sf), window=10**9, cap=10**6)
    return chunks.request_text(packed).select("doc_id", F.sha2("text", 256).alias("envelope_sha256"))


@query("SELECT doc_id, l[1:len(l) // 2] AS left_half, l[len(l) // 2 + 1:] AS right_half FROM (SELECT conv_id AS doc_id, list('s-' || turn ORDER BY turn) AS l FROM conversations GROUP BY conv_id)")
def bisect_ranges(spark, sf):
    rows = _turns(spark, sf).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "id")))["id"].alias("l"))
    left, right = chunks.halves(c("l"))
    return rows.select("doc_id", left.alias("left_half"), right.alias("right_half"))


def _numbered(spark, sf):
    """Documents whose lines head sections: a number and 60 characters, the rest of the line below."""
    made = F.transform(F.split("text", "\n"), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), F.substring(x, 1, 60), F.lit("\n"), F.substring(x, F.lit(61), F.length(x)), F.lit("\n")))
    return table(spark, sf, "documents").select("doc_id", F.array_join(made, "").alias("text"))


ENDS = r"\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}"
BLANK = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]+"
NUMBERED_SQL = rf"""WITH d AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x, i: i || '. ' || substr(x, 1, 60) || chr(10) || substr(x, 61) || chr(10)) AS parts FROM documents),
t AS (SELECT doc_id, array_to_string(parts, '') AS text FROM d), a AS (SELECT doc_id, regexp_extract_all(text, '[^{ENDS}]*(?:\r\n|[{ENDS}]|$)') AS a FROM t),
l AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS n FROM a),
s AS (SELECT doc_id, n, line, (sum(length(line)) OVER (PARTITION BY doc_id ORDER BY n) - length(line))::INTEGER AS start, regexp_replace(line, '^{BLANK}|{BLANK}$', '', 'g') AS x FROM l WHERE line <> ''),
p AS (SELECT *, regexp_extract(x, '^(\d+(?:\.\d+)*)\.?\s+(\S.*)$', 1) AS number, regexp_replace(regexp_extract(x, '^(\d+(?:\.\d+)*)\.?\s+(\S.*)$', 2), '^{BLANK}|{BLANK}$', '', 'g') AS title FROM s),
h AS (SELECT doc_id, start, number, title, lead(start) OVER (PARTITION BY doc_id ORDER BY start) AS next, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS k FROM p
  WHERE number <> '' AND NOT contains(x, '..') AND NOT contains(x, ' . ') AND length(x) <= 120 AND regexp_matches(regexp_replace(title, '^[. ]+', ''), '\p{{L}}')
  AND NOT (regexp_matches(x, '\t\d{{1,4}}\s*$') OR regexp_matches(x, '\.{{2,}}\s*\d{{1,4}}\s*$')
    OR (regexp_matches(x, '(?i)^(?:(?:Clause|Section)\s+)?\d+(?:\.\d+)*\.?\s+\S.*\s{{2,}}\d{{1,4}}\s*$') AND NOT starts_with(lower(x), 'annex')))),
f AS (SELECT t.doc_id, length(text)::INTEGER AS size, text, min(h.start) AS first FROM t LEFT JOIN h ON h.doc_id = t.doc_id GROUP BY ALL),
q AS (SELECT *, first > 0 AND regexp_replace(substr(text, 1, first), '^{BLANK}|{BLANK}$', '', 'g') <> '' AS front FROM f)
SELECT doc_id::VARCHAR AS doc_id, 0 AS ord, 'body' AS id, 'Document body' AS title, 1 AS level, 0 AS start_char, size AS end_char FROM q WHERE first IS NULL
UNION ALL SELECT doc_id::VARCHAR, 0, 'preamble', 'Preamble', 1, 0, first FROM q WHERE front
UNION ALL SELECT h.doc_id::VARCHAR, (k - 1 + front::INTEGER)::INTEGER, 's-' || number, number || '. ' || title, len(string_split(number, '.'))::INTEGER, start, coalesce(next, size) FROM h JOIN q USING (doc_id)"""


@query(NUMBERED_SQL)
def numbered_sections(spark, sf):
    return segment.numbered_sections(_numbered(spark, sf)).select("doc_id", "ord", "id", "title", "level", "start_char", "end_char")


@query()
def clause_sections(spark, sf):
    return segment.clause_sections(_numbered(spark, sf)).select("doc_id", "ord", "id", "title", "level", "start_char", "end_char")


@query(r"""SELECT doc_id, section_count, annex_count, tiny_section_count, sentence_like_title_count, chars,
NOT ((section_count >= 40 AND tiny_section_count >= section_count * 0.25 AND chars / section_count < 300) OR (section_count >= 20 AND sentence_like_title_count >= section_count * 0.15) OR (section_count >= 15 AND annex_count >= section_count * 0.35)
  OR (chars >= 5000 AND section_count >= 80 AND chars / section_count < 180) OR (section_count BETWEEN 5 AND 40 AND sentence_like_title_count >= 3 AND sentence_like_title_count >= section_count * 0.2)) AS ok
FROM (SELECT conv_id AS doc_id, count(*) AS section_count, 0::BIGINT AS annex_count, count(*) FILTER (WHERE length(trim(text)) < 40) AS tiny_section_count,
  count(*) FILTER (WHERE regexp_matches(substr(text, 1, 60), '[.;,]\s*$') OR regexp_matches(substr(text, 1, 60), ',\s+[a-z]')) AS sentence_like_title_count, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id)""")
def section_health(spark, sf):
    return segment.parse_health(_turns(spark, sf).withColumn("title", F.substring("text", 1, 60)))


# ---- horizons


@query("""SELECT event_id, (CASE WHEN h > 0 THEN h || 'h ' ELSE '' END) || (CASE WHEN h > 0 OR m > 0 THEN m || 'm ' ELSE '' END) || (t % 600) // 10 || '.' || t % 10 || 's' AS shown
FROM (SELECT event_id, t, t // 36000 AS h, t % 36000 // 600 AS m FROM (SELECT event_id, floor(greatest(value * 100, 0.0) * 10 + 0.5)::BIGINT AS t FROM events))""")
def duration_format(spark, sf):
    return table(spark, sf, "events").select("event_id", horizon.duration(c("value") * 100).alias("shown"))


# ---- findings


def _findings(spark, sf):
    """Findings made of document ids."""
    pick = lambda name, k: F.element_at(F.array(*map(F.lit, findings.VOCABULARIES[name])), (c("doc_id") % k + 1).cast("int"))
    return table(spark, sf, "documents").select(
        "doc_id", pick("finding_type", 6).alias("finding_type"), pick("severity", 5).alias("severity"), pick("disposition", 5).alias("disposition"), pick("validation_status", 4).alias("validation_status"),
        (c("doc_id") % 3 == 0).alias("source_verified"), pick("scope_relevance", 4).alias("scope_relevance"),
    )


LISTS = {k: "[" + ", ".join(f"'{v}'" for v in findings.VOCABULARIES[k]) + "]" for k in ("severity", "disposition", "validation_status", "scope_relevance", "assurance_status")}
TYPE_LIST = "[" + ", ".join(f"'{v}'" for v in findings.VOCABULARIES["finding_type"]) + "]"
STATUS_SQL = f"""SELECT CASE WHEN d = 'rejected' THEN 'rejected' WHEN d = 'accepted' THEN 'human_confirmed' WHEN d = 'needs_review' THEN 'deferred' WHEN v = 'verified' THEN 'deterministically_validated'
WHEN s THEN 'source_verified' ELSE 'candidate' END AS value FROM (SELECT {LISTS['disposition']}[doc_id % 5 + 1] AS d, {LISTS['validation_status']}[doc_id % 4 + 1] AS v, doc_id % 3 = 0 AS s FROM documents)"""


@query(f"SELECT (list_position({LISTS['assurance_status']}, value) - 1)::INTEGER AS ord, value, count(*) AS n FROM ({STATUS_SQL}) GROUP BY value")
def assurance_status_counts(spark, sf):
    status = findings.assurance_status(c("disposition"), c("validation_status"), c("source_verified"))
    return findings.counts(_findings(spark, sf).withColumn("status", status), "status", "assurance_status")


@query(f"SELECT (list_position({LISTS['scope_relevance']}, value) - 1)::INTEGER AS ord, value, count(*) AS n FROM (SELECT {LISTS['scope_relevance']}[doc_id % 4 + 1] AS value FROM documents) GROUP BY value")
def findings_by_scope(spark, sf):
    return findings.counts(_findings(spark, sf), "scope_relevance", "scope_relevance")


@query(f"SELECT (row_number() OVER (ORDER BY value) - 1)::INTEGER AS ord, value, count(*) AS n FROM (SELECT {LISTS['disposition']}[doc_id % 5 + 1] AS value FROM documents) GROUP BY value")
def findings_by_disposition(spark, sf):
    return findings.counts(_findings(spark, sf), "disposition")


@query("""SELECT conv_id AS doc_id, position, printf('F-%03d', row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN position % 7 = 3 THEN NULL ELSE 100 - position END ASC NULLS LAST, position)) AS id FROM (SELECT conv_id, turn AS position FROM conversations)""")
def renumber_findings(spark, sf):
    """Findings in reverse order of their sections; one in seven names an unknown section."""
    t = table(spark, sf, "conversations")
    own = t.select(c("conv_id").alias("doc_id"), c("turn").alias("position"), F.when(c("turn") % 7 == 3, "nowhere").otherwise(F.concat(F.lit("s-"), "turn")).alias("section_id"), F.lit("").alias("id"))
    sections = t.select(c("conv_id").alias("doc_id"), F.concat(F.lit("s-"), "turn").alias("id"), (100 - c("turn")).alias("ord"))
    return findings.renumber(own, sections).select("doc_id", "position", "id")


@query("SELECT event_id, true AS ok, json_keys(props) AS keys FROM events")
def json_props_strict(spark, sf):
    """Strict decoding of event properties; the keys in order."""
    return table(spark, sf, "events").select("event_id", findings.strictly_json("props").alias("ok"), F.json_object_keys("props").alias("keys"))


# ---- reports, bench and recovery


RUNS = {
    "schema_version": "CASE d % 4 WHEN 0 THEN '0.4.0' WHEN 1 THEN '0.5.0' ELSE '0.6.0' END", "request_batching": "CASE d % 9 WHEN 0 THEN 'whole_document' WHEN 1 THEN 'per_section' WHEN 8 THEN NULL ELSE 'section_chunks' END",
    "analysis_mode": "CASE d % 5 WHEN 0 THEN 'whole_document' WHEN 4 THEN NULL ELSE 'section_aware' END", "analysis_request_count": "d % 4 - CASE WHEN d % 41 = 0 THEN 5 ELSE 0 END", "repair_request_count": "d % 3",
    "total_provider_request_count": "CASE WHEN d % 13 > 0 THEN d % 4 + d % 3 - CASE WHEN d % 41 = 0 THEN 5 ELSE 0 END + CASE WHEN d % 11 = 0 THEN 1 ELSE 0 END END", "coverage_complete": "d % 2 = 0",
    "sections_analyzed": "CASE WHEN d % 19 > 0 THEN d % 3 + 1 + CASE WHEN d % 23 = 0 THEN 1 ELSE 0 END END", "analysis_status": "CASE WHEN d % 6 = 0 THEN 'partial' WHEN d % 47 > 0 THEN 'complete' END",
    "sections_succeeded": "d % 3", "sections_failed": "CASE WHEN d % 6 < 2 THEN 1 ELSE 0 END", "succeeded_chars": "d % 100", "failed_chars": "d % 10", "analyzed_chars": "d % 100 + d % 10 + CASE WHEN d % 37 = 0 THEN 1 ELSE 0 END",
    "recovery_split_count": "CASE WHEN d % 43 = 0 THEN -1 ELSE 0 END", "recovery_request_count": "d % 5",
}
RUNS_SQL = f"""WITH r AS (SELECT d, {', '.join(f'{v} AS {k}' for k, v in RUNS.items())}, CASE WHEN d % 17 > 0 THEN [d % 3, 1] END AS chunk_section_counts,
  CASE WHEN d % 6 < 2 OR d % 29 = 0 THEN ['a'] ELSE [] END AS failed, CASE WHEN d % 6 < 2 THEN [CASE WHEN d % 31 = 0 THEN 'b' ELSE 'a' END] ELSE [] END AS unanalyzed FROM (SELECT doc_id AS d FROM documents))
"""
RULES_SQL = {
    "schema_version >= '0.5.0'": {
        "missing request_batching": "request_batching IS NULL", "missing chunk_section_counts": "chunk_section_counts IS NULL", "missing sections_analyzed": "analysis_mode = 'section_aware' AND sections_analyzed IS NULL",
        "counts are not negative": "analysis_request_count < 0", "repairs within analysis": "repair_request_count > analysis_request_count", "chunks hold sections": "chunk_section_counts[1] = 0",
        "batching fits mode": "(request_batching = 'whole_document') <> (analysis_mode = 'whole_document')", "per section is one section": "request_batching = 'per_section' AND chunk_section_counts[1] <> 1",
        "chunks of several sections": "request_batching = 'section_chunks' AND chunk_section_counts[1] < 2", "chunks add up": "analysis_mode = 'section_aware' AND chunk_section_counts[1] + 1 <> sections_analyzed",
    },
    "schema_version = '0.5.0'": {"a chunk for each request": "analysis_request_count <> len(chunk_section_counts)"},
    "schema_version = '0.6.0'": {
        "missing total_provider_request_count": "total_provider_request_count IS NULL", "missing analysis_status": "analysis_status IS NULL", "total is the sum": "total_provider_request_count <> analysis_request_count + repair_request_count",
        "failed ids are counted": "len(failed) <> sections_failed", "unanalyzed are counted": "len(unanalyzed) <> sections_failed", "failed ids in order": "failed <> unanalyzed",
        "partial has failures": "analysis_status = 'partial' AND sections_failed = 0", "complete has none": "analysis_status = 'complete' AND (sections_failed > 0 OR len(failed) > 0)",
        "covered is complete": "coverage_complete AND (analysis_status = 'partial' OR sections_failed > 0)", "sections add up": "sections_succeeded + sections_failed <> sections_analyzed",
        "chars add up": "succeeded_chars + failed_chars <> analyzed_chars", "recovery is not negative": "recovery_split_count < 0", "recovery within total": "recovery_request_count > total_provider_request_count",
    },
}


def _runs(spark, sf):
    a = F.lit("a")
    none, failed = F.array().cast("array<string>"), c("d") % 6 < 2
    leaf = F.struct(F.when(c("d") % 31 == 0, "b").otherwise("a").alias("section_id"))
    return table(spark, sf, "documents").select(c("doc_id").alias("d")).select(
        c("d").alias("run_id"), *[F.expr(v).alias(k) for k, v in RUNS.items()], F.when(c("d") % 17 > 0, F.array(c("d") % 3, F.lit(1).cast("long"))).alias("chunk_section_counts"),
        F.when(failed | (c("d") % 29 == 0), F.array(a)).otherwise(none).alias("failed_section_ids"), F.when(failed, F.array(leaf)).otherwise(F.array().cast("array<struct<section_id:string>>")).alias("unanalyzed_sections"),
    )


@query(RUNS_SQL + " UNION ALL ".join(f"SELECT d AS run_id, '{name}' AS rule FROM r WHERE {gate} AND ({hit})" for gate, rules in RULES_SQL.items() for name, hit in rules.items()))
def report_invariants(spark, sf):
    return report.violations(_runs(spark, sf))


@query(RUNS_SQL + """SELECT d AS run_id, schema_version, CASE WHEN schema_version >= '0.5.0' THEN analysis_request_count END AS analysis_request_count, CASE WHEN schema_version >= '0.5.0' THEN coverage_complete END AS coverage_complete,
CASE WHEN schema_version = '0.6.0' THEN coalesce(analysis_status, 'complete') END AS analysis_status, CASE WHEN schema_version = '0.6.0' THEN sections_failed END AS sections_failed,
CASE WHEN schema_version = '0.6.0' THEN coalesce(total_provider_request_count, analysis_request_count + repair_request_count) END AS total_provider_request_count, CASE WHEN schema_version = '0.6.0' THEN len(failed) END AS n_failed FROM r""")
def report_versions(spark, sf):
    kept = report.for_version(_runs(spark, sf))
    return kept.select("run_id", "schema_version", "analysis_request_count", "coverage_complete", "analysis_status", "sections_failed", "total_provider_request_count", F.when(c("failed_section_ids").isNotNull(), F.size("failed_section_ids")).alias("n_failed"))


def _reported(spark, sf):
    base = _findings(spark, sf)
    runs = base.select(c("doc_id").alias("run_id"), "doc_id")
    own = base.select(c("doc_id").alias("run_id"), F.lit(0).alias("ord"), F.lit("F-001").alias("id"), F.lit("Counter *wraps*").alias("title"), F.lit("It wraps.").alias("description"), *[x for x in base.columns if x != "doc_id"],
                      F.lit("high").alias("confidence"), F.array(F.struct(F.lit("a `quote`").alias("quote"))).alias("evidence"))
    return runs, own


FINDING_SQL = """'### F-001 Counter \\*wraps\\*' || chr(10) || chr(10) || '- Type: ' || t || chr(10) || '- Severity: ' || s || chr(10) || '- Confidence: high' || chr(10) || '- Status: ' || label || chr(10) || chr(10)
  || 'It wraps.' || chr(10) || chr(10) || '~~~' || chr(10) || 'a `quote`' || chr(10) || '~~~'"""


@query(f"""WITH f AS (SELECT doc_id, {TYPE_LIST}[doc_id % 6 + 1] AS t, {LISTS['severity']}[doc_id % 5 + 1] AS s, {LISTS['scope_relevance']}[doc_id % 4 + 1] AS scope, {LISTS['disposition']}[doc_id % 5 + 1] AS d,
  {LISTS['validation_status']}[doc_id % 4 + 1] AS v, doc_id % 3 = 0 AS sv FROM documents),
g AS (SELECT *, CASE WHEN d = 'rejected' THEN 'rejected' WHEN d = 'accepted' THEN 'validated finding (human-confirmed)' WHEN d = 'needs_review' THEN 'deferred' WHEN v = 'verified' THEN 'deterministically checked candidate'
  WHEN sv THEN 'source-verified candidate' ELSE 'candidate for review' END AS label, CASE WHEN scope IN ('core', 'supporting') THEN 1 WHEN scope = 'incidental' THEN 2 ELSE 0 END AS part FROM f)
SELECT doc_id AS run_id, '# Review of ' || doc_id || chr(10) || chr(10) || 'Findings: ' || (part = 1)::INTEGER || ' primary, ' || (part = 2)::INTEGER || ' incidental.'
  || CASE part WHEN 1 THEN chr(10) || chr(10) || '## Findings' || chr(10) || chr(10) || {FINDING_SQL} WHEN 2 THEN chr(10) || chr(10) || '## Incidental' || chr(10) || chr(10) || {FINDING_SQL} ELSE '' END || chr(10) AS markdown FROM g""")
def report_markdown(spark, sf):
    return report.report_markdown(*_reported(spark, sf))


@query(f"""SELECT doc_id AS run_id, doc_id AS json_doc, {LISTS['severity']}[doc_id % 5 + 1] AS json_severity FROM documents""")
def report_json(spark, sf):
    """Reports as JSON, read back. (K1)"""
    made = report.report_json(*_reported(spark, sf))
    get = lambda path: F.get_json_object("json", path)
    return made.select("run_id", get("$.doc_id").cast("long").alias("json_doc"), get("$.findings[0].severity").alias("json_severity"))


def _replaced(sql: str, rules) -> str:
    """SQL that applies patterns in order."""
    for pattern, put in rules:
        sql = f"regexp_replace({sql}, '{pattern.replace(chr(39), chr(39) * 2)}', '{put.replace('$', chr(92))}', 'g')"
    return sql


@query(f"SELECT doc_id, sha256({_replaced('text', text.SECRETS)}) AS shown_sha256, {_replaced('text', text.SECRETS)} <> text AS had_secret FROM documents")
def secret_redaction(spark, sf):
    """Whole texts under all patterns."""
    shown = text.redact_secrets(c("text"))
    return table(spark, sf, "documents").select("doc_id", F.sha2(shown, 256).alias("shown_sha256"), (shown != c("text")).alias("had_secret"))


RUN_SQL = "coalesce(list_max(list_transform(regexp_extract_all({0}, '{1}+'), lambda x: length(x))), 0)"
CODE_SQL = f"""WITH t AS (SELECT page_id, regexp_replace(html, '[\\n\\x0B\\x0C\\r\\x{{85}}\\x{{2028}}\\x{{2029}}\\t]', ' ', 'g') AS line, html FROM pages),
u AS (SELECT page_id, line, html, repeat('`', ({RUN_SQL.format('line', '`')} + 1)::BIGINT) AS marks, {RUN_SQL.format('html', '`')} AS ticks, {RUN_SQL.format('html', '~')} AS tildes FROM t),
v AS (SELECT *, CASE WHEN tildes < ticks THEN repeat('~', greatest(3, tildes + 1)::BIGINT) ELSE repeat('`', greatest(3, ticks + 1)::BIGINT) END AS fence FROM u)
SELECT page_id, sha256(marks || CASE WHEN line = '' OR line[1] IN ('`', ' ') OR line[-1] IN ('`', ' ') THEN ' ' || line || ' ' ELSE line END || marks) AS code_sha256,
sha256(fence || chr(10) || CASE WHEN html[-1] = chr(10) THEN html[:-2] ELSE html END || chr(10) || fence) AS fence_sha256 FROM v"""


@query(CODE_SQL)
def markdown_code(spark, sf):
    """Whole pages as inline code and as fenced blocks."""
    return table(spark, sf, "pages").select("page_id", F.sha2(text.inline_code(c("html")), 256).alias("code_sha256"), F.sha2(text.markdown_fence(c("html")), 256).alias("fence_sha256"))


BODY_SQL = "CASE conv_id % 4 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' WHEN 2 THEN 'gemini' ELSE 'ollama' END"


@query(f"""SELECT conv_id, turn, {BODY_SQL} AS provider, CASE WHEN turn % 5 = 3 THEN NULL ELSE length(text) END::BIGINT AS input_tokens, CASE WHEN turn % 5 = 3 THEN NULL WHEN turn % 5 = 4 THEN 0 ELSE turn END::BIGINT AS output_tokens,
CASE WHEN turn % 5 = 3 OR conv_id % 4 <> 0 OR conv_id % 8 = 0 THEN NULL ELSE conv_id END::BIGINT AS reasoning_tokens, CASE WHEN turn % 5 = 3 THEN 'shape' END AS error,
CASE WHEN conv_id % 4 <> 0 THEN 'ok' ELSE ['ok', 'truncated', 'rejected', 'unexpected_output', 'shape'][1 + turn % 5] END AS state FROM conversations""")
def provider_usage(spark, sf):
    """Counts of tokens and endings of made-up answers, one for each turn."""
    quoted = F.to_json(F.struct(c("text").alias("x")))
    text_json = F.substring(quoted, F.lit(6), F.length(quoted) - 6)
    i = F.length("text").cast("string")
    o = F.when(c("turn") % 5 == 3, "-1").when(c("turn") % 5 == 4, "null").otherwise(c("turn").cast("string"))
    end = F.element_at(F.array(*map(F.lit, ("stop", "length", "content_filter", "tool_calls", "other"))), (c("turn") % 5 + 1).cast("int"))
    why = F.when(c("conv_id") % 8 == 0, "{}").otherwise(F.concat(F.lit('{"reasoning_tokens":'), c("conv_id").cast("string"), F.lit("}")))
    bodies = {
        "openai": ('{"choices":[{"finish_reason":"', end, '","message":{"content":', text_json, '}}],"usage":{"prompt_tokens":', i, ',"completion_tokens":', o, ',"completion_tokens_details":', why, "}}"),
        "anthropic": ('{"content":[{"type":"text","text":', text_json, '}],"usage":{"input_tokens":', i, ',"output_tokens":', o, "}}"),
        "gemini": ('{"candidates":[{"content":{"parts":[{"text":', text_json, '}]}}],"usageMetadata":{"promptTokenCount":', i, ',"candidatesTokenCount":', o, "}}"),
        "ollama": ('{"message":{"content":', text_json, '},"prompt_eval_count":', i, ',"eval_count":', o, "}"),
    }
    names = list(bodies)
    provider = F.element_at(F.array(*map(F.lit, names)), (c("conv_id") % 4 + 1).cast("int"))
    body = F.lit(None).cast("string")
    for name in names:
        body = F.when(c("provider") == name, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in bodies[name]])).otherwise(body)
    rows = table(spark, sf, "conversations").withColumn("provider", provider).withColumn("body", body)
    rows = rows.withColumn("u", usage.token_usage(c("provider"), c("body"))).withColumn("state", usage.answer_state(c("provider"), c("body")))
    return rows.select("conv_id", "turn", "provider", "u.input_tokens", "u.output_tokens", "u.reasoning_tokens", "u.error", "state")


@query("""SELECT lang, count(*) AS n, count(quality) AS quality_known, sum(quality)::BIGINT AS quality_sum, count(quality) = count(*) AS quality_complete FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def metric_completeness(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), *bench.metric(c("quality"), "quality"))


@query("""SELECT conv_id AS k, sum(turn)::BIGINT AS input_tokens, sum(length(text))::BIGINT AS output_tokens, sum(CASE WHEN conv_id % 3 = 0 THEN NULL ELSE turn END)::BIGINT AS reasoning_tokens,
count(*) FILTER (WHERE turn % 2 = 0) AS primary_requests, count(*) FILTER (WHERE turn % 2 = 1) AS repair_requests FROM conversations GROUP BY conv_id""")
def usage_totals(spark, sf):
    t = table(spark, sf, "conversations")
    rows = t.select(c("conv_id").alias("k"), c("turn").alias("input_tokens"), F.length("text").alias("output_tokens"), F.when(c("conv_id") % 3 != 0, c("turn")).alias("reasoning_tokens"), (c("turn") % 2 + 1).alias("attempt"))
    return bench.usage_totals(rows, "k")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def planned_minus_done(spark, sf):
    return bench.remaining(table(spark, sf, "documents"), table(spark, sf, "labels"), ["doc_id"]).select("doc_id", "lang")


PLAN_SQL = PACK_SQL.replace("f.k >= 3", "f.k >= 8").replace("> 22684", "> 128000") + """, q AS (
  SELECT doc_id, chunk, k, (6000 + (FRAME + body + 2 * length(body::VARCHAR) + length(k::VARCHAR) + 3) // 4)::BIGINT AS est_in, least(16384, 1500 * k)::BIGINT AS est_out
  FROM (SELECT doc_id, chunk, count(*) AS k, (sum(size) + count(*) - 1)::BIGINT AS body FROM f GROUP BY doc_id, chunk)
), m(config_id, i, o, li, lo) AS (VALUES ('openai-mini', 0.4::DOUBLE, 1.6::DOUBLE, 0.4::DOUBLE, 1.6::DOUBLE), ('openai-luna', 0.1, 0.5, 0.2, 0.75), ('anthropic-sonnet', 3, 15, 3, 15), ('gemini-flash', 1.5, 7.5, 1.5, 7.5)),
r AS (SELECT doc_id, config_id, est_in, est_out, printf('%.6f', est_in / 1000000.0::DOUBLE * CASE WHEN est_in > 272000 THEN li ELSE i END + est_out / 1000000.0::DOUBLE * CASE WHEN est_in > 272000 THEN lo ELSE o END)::DECIMAL(18, 6) AS usd FROM q CROSS JOIN m),
h AS (SELECT conv_id AS doc_id, CASE WHEN (count(*) >= 40 AND count(*) FILTER (WHERE length(trim(text)) < 40) >= count(*) * 0.25 AND sum(length(text)) / count(*) < 300)
  OR (sum(length(text)) >= 5000 AND count(*) >= 80 AND sum(length(text)) / count(*) < 180) THEN 'unreliable_sections' END AS error FROM conversations GROUP BY conv_id)
SELECT doc_id, config_id, count(*) AS requests, sum(est_in)::BIGINT AS input_tokens, sum(est_out)::BIGINT AS output_tokens, sum(usd)::DOUBLE AS usd, any_value(error) AS error, sum(usd) <= 0.05 AS within_budget
FROM r JOIN h USING (doc_id) GROUP BY doc_id, config_id""".replace("FRAME", str(len("UNTRUSTED_DATA kind=section_chunk chars=\ndocument_id: \ntitle: \nsection_summary: \nsection_count: \ntext:\n\nUNTRUSTED_DATA_END chars=")))


@query(PLAN_SQL)
def section_plan(spark, sf):
    """Section-aware plans of conversations with prices and a budget."""
    return scan.plan_sections(_turns(spark, sf), scan.configs(spark), window=128_000, max_cost_usd=0.05)


TITLES_SQL = r"""WITH t AS (SELECT doc_id, CASE WHEN lang = 'de' THEN 'TITLE:  ' || text ELSE text END || chr(10) || 'Abstract' || chr(10) || '1 Scope' || chr(10) || text AS x FROM documents),
a AS (SELECT doc_id, string_split_regex(coalesce(x, ''), '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]') AS a FROM t), l AS (SELECT doc_id, unnest(a) AS raw, generate_subscripts(a, 1) AS n FROM a),
s AS (SELECT doc_id, n, regexp_replace(raw, '^[\s\x0B\x1C-\x1F\x{85}\p{Z}]+|[\s\x0B\x1C-\x1F\x{85}\p{Z}]+$', '', 'g') AS line FROM l WHERE n <= 200),
r AS (SELECT * FROM (VALUES ('ietf', 120, 200, 7, 80), ('etsi', 80, 120, 9, 0), ('3gpp', 100, 150, 11, 0)) r(corpus, labelled, rows, above, first)),
p AS (SELECT corpus, doc_id, n, line, labelled, rows, above, first, CASE corpus WHEN 'ietf' THEN lower(line) IN ('abstract', 'status of this memo', 'status of memo') WHEN 'etsi' THEN lower(line) IN ('scope', '1 scope', '1. scope')
    ELSE regexp_matches(lower(line), '^(1|1\.1)\s+scope\b') END AS mark,
  CASE corpus WHEN 'ietf' THEN length(line) BETWEEN 12 AND 200 AND regexp_matches(line, '\p{L}') AND NOT regexp_matches(lower(line), '^(rfc |internet-draft|internet engineering task force|request for comments|category:|issn:|updates:|obsoletes:|network working group)')
    AND NOT (contains(line, ':') AND split_part(line, ':', 1) = upper(split_part(line, ':', 1)) AND split_part(line, ':', 1) <> lower(split_part(line, ':', 1)))
    WHEN 'etsi' THEN length(line) > 15 AND NOT starts_with(lower(line), 'etsi') ELSE length(line) > 12 AND NOT starts_with(lower(line), '3gpp') END AS ok FROM s, r),
said AS (SELECT corpus, doc_id, arg_min(line, n) AS line FROM p WHERE n <= labelled AND starts_with(lower(line), 'title:') GROUP BY ALL),
near AS (SELECT k.corpus, k.doc_id, arg_min(o.line, k.n * 1000 - o.n) AS line FROM p k JOIN p o ON k.corpus = o.corpus AND k.doc_id = o.doc_id AND o.n BETWEEN k.n - k.above AND k.n - 1 WHERE k.mark AND o.ok AND k.n <= k.rows GROUP BY ALL),
plain AS (SELECT corpus, doc_id, arg_min(line, n) AS line FROM p WHERE ok AND n <= first GROUP BY ALL)
SELECT r.corpus, t.doc_id, CASE WHEN said.line IS NOT NULL THEN coalesce(nullif(trim(substr(said.line, 7)), ''), CASE WHEN r.corpus <> 'ietf' THEN 'id ' || t.doc_id END)
  ELSE coalesce(near.line, plain.line, CASE WHEN r.corpus <> 'ietf' THEN 'id ' || t.doc_id END) END AS title
FROM t CROSS JOIN r LEFT JOIN said USING (corpus, doc_id) LEFT JOIN near USING (corpus, doc_id) LEFT JOIN plain USING (corpus, doc_id)"""


@query(TITLES_SQL)
def document_titles(spark, sf):
    """Titles of documents with a marker in their middle, under the rules of three corpora."""
    marked = F.concat(F.when(c("lang") == "de", F.concat(F.lit("TITLE:  "), "text")).otherwise(c("text")), F.lit("\nAbstract\n1 Scope\n"), c("text"))
    docs = table(spark, sf, "documents").select("doc_id", marked.alias("text"), F.concat(F.lit("id "), c("doc_id").cast("string")).alias("normal"))
    each = lambda lines: F.array(*[F.struct(F.lit(k).alias("corpus"), corpora.title_in(k, lines, c("normal")).alias("title")) for k in corpora.TITLE_RULES])
    return docs.select("doc_id", F.explode(bound(corpora.head_lines(c("text")), each)).alias("t")).select("t.corpus", "doc_id", "t.title")


@query("""WITH r AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations)
SELECT conv_id AS doc_id, 'Title: ' || conv_id || chr(10) || 'Analyzed sections:' || chr(10) || '- ' || string_agg(role, chr(10) || '- ' ORDER BY turn) FILTER (WHERE n <= 3)
|| CASE WHEN any_value(total) > 3 THEN chr(10) || '... (' || (any_value(total) - 3) || ' more sections)' ELSE '' END AS summary FROM r GROUP BY conv_id""")
def scoped_summaries(spark, sf):
    turns = _turns(spark, sf)
    return scope.scoped_summary(turns, turns.select("doc_id", F.lit("").alias("title")).distinct(), most=3)


@query("""SELECT conv_id AS doc_id, turn::INTEGER AS ord, 's-' || turn AS section_id, CASE WHEN length(text) > 100 THEN 'truncated_output' ELSE 'invalid_model_output' END AS category, length(text)::INTEGER AS char_count
FROM conversations WHERE role <> 'assistant'""")
def failure_leaves(spark, sf):
    turns = _turns(spark, sf).select("doc_id", "ord", c("id").alias("section_id"), c("title").alias("role"), F.length("text").alias("char_count"))
    leaves = turns.where("char_count > 100").select("doc_id", "section_id", F.lit("truncated_output").alias("category"))
    return recovery.failure_leaves(turns.drop("role"), turns.where("role = 'assistant'"), leaves)


@query("""SELECT doc_id, doc_id + 2147483600 = 2147483647 AS verified, CASE WHEN doc_id = 47 THEN 'Signed 32-bit max seconds 2147483647 is correct.' ELSE 'Claimed max seconds ' || (doc_id + 2147483600) || '; expected 2147483647.' END AS detail FROM documents""")
def unix_claims(spark, sf):
    claim = horizon.unix_seconds_claim(c("doc_id") + 2147483600)
    return table(spark, sf, "documents").select("doc_id", claim["verified"].alias("verified"), claim["detail"].alias("detail"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 <> 0 THEN strftime(ts, '.%f') ELSE '' END || 'Z' AS shown,
strftime(ts, '%Y-%m-%d') || ' (day precision)' AS day, strftime(ts, '%Y-%m-%dT%H:%M') || ':00Z' AS exact FROM events""")
def instant_formats(spark, sf):
    minute = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm"), F.lit("Z"))
    claim = lambda value, precision: horizon.format_claim(value, F.lit(precision), F.lit("0.6.0"))
    return table(spark, sf, "events").select("event_id", horizon.format_instant(c("ts").cast("timestamp")).alias("shown"), claim(F.date_format("ts", "yyyy-MM-dd"), "day").alias("day"), claim(minute, "instant").alias("exact"))


REVIEW_SQL = PACK_SQL + """, t AS (SELECT f.doc_id, f.n, f.id, f.chunk, x.text FROM f JOIN (SELECT conv_id, 's-' || turn AS id, text FROM conversations) x ON x.conv_id = f.doc_id AND x.id = f.id),
a AS (SELECT doc_id, chunk, min(n) AS n, arg_min(id, n) AS id, arg_min(text, n) AS text FROM t GROUP BY doc_id, chunk),
o AS (SELECT *, length(text) <= 100 AND length(text) % 7 > 0 AS ok FROM a)
"""


def _answered(spark, sf):
    """Packed turns and an answer to each request, of which some are no JSON and some name a section that it does not have."""
    packed = _packed(spark, sf)
    first = packed.groupBy("doc_id", "chunk_index").agg(F.min_by(F.struct("ref", "text"), "ord").alias("f")).select("doc_id", c("chunk_index").alias("request"), "f.*")
    size = F.length("text")
    token = {"finding_type": "implied_assumption", "severity": "low", "confidence": "medium", "scope_relevance": "core"}
    item = F.struct(
        *[F.lit(v).alias(k) for k, v in token.items()], *[F.lit("x").alias(k) for k in ("title", "description", "machine_interpretation", "scope_rationale")], F.array(F.lit("epoch")).alias("domains"),
        F.array(F.struct(F.concat(F.lit("q "), F.substring("text", 1, 40)).alias("quote")), F.struct(F.concat(F.lit("q"), "text").alias("quote"))).alias("evidence"),
        F.when(size % 7 == 0, "S9999").otherwise(c("ref")).alias("section_id"),
    )
    plain = F.struct(*[F.array(F.struct(F.substring("text", 1, 40).alias("quote"))).alias(k) if k == "evidence" else item[k].alias(k) for k in (*token, "title", "description", "machine_interpretation", "scope_rationale", "domains", "evidence", "section_id")])
    body = F.to_json(F.struct(F.array(item, plain).alias("findings")))
    return packed, first.select("doc_id", "request", F.when(size > 100, "no JSON").otherwise(body).alias("content"))


@query(REVIEW_SQL + f""", k AS (SELECT doc_id, id AS section_id, n, text, unnest([1, 2]) AS part FROM o WHERE ok)
SELECT doc_id, format('F-{{:03d}}', row_number() OVER (PARTITION BY doc_id ORDER BY n, part)) AS id, section_id, part = 2 AND length({FORM_SQL.format('substr(text, 1, 40)')}) >= 16 AS source_verified FROM k""")
def review_findings(spark, sf):
    return review.reviewed_findings(*_answered(spark, sf))[0].select("doc_id", "id", "section_id", "source_verified")


@query(REVIEW_SQL + """SELECT t.doc_id AS run_id, count(DISTINCT t.chunk)::INTEGER AS analysis_request_count, CASE WHEN bool_and(ok) THEN 'complete' ELSE 'partial' END AS analysis_status, count(*)::INTEGER AS sections_analyzed,
count(*) FILTER (WHERE NOT ok)::INTEGER AS sections_failed, coalesce(sum(length(t.text)) FILTER (WHERE NOT ok), 0)::BIGINT AS failed_chars, coalesce(string_agg(t.id, ' ' ORDER BY t.n) FILTER (WHERE NOT ok), '') AS failed, 0 AS broken
FROM t JOIN o ON t.doc_id = o.doc_id AND t.chunk = o.chunk GROUP BY t.doc_id""")
def review_runs(spark, sf):
    """Runs of answered requests, and how many rules they break."""
    packed, answers = _answered(spark, sf)
    runs = review.reviewed_runs(packed, review.reviewed_findings(packed, answers)[1])
    broken = report.violations(runs).groupBy("run_id").agg(F.count("*").cast("int").alias("broken"))
    out = runs.join(broken, "run_id", "left").withColumn("broken", F.coalesce("broken", F.lit(0)))
    return out.select("run_id", "analysis_request_count", "analysis_status", "sections_analyzed", "sections_failed", "failed_chars", F.array_join("failed_section_ids", " ").alias("failed"), "broken")


# ---- extension


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, sf):
    out = arrivals.windowed_counts(table(spark, sf, "events"))
    return out.select(c("start").cast("timestamp_ntz").alias("start"), "event_type", "n")
