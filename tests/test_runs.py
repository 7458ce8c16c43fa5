"""Attempts, providers, retries, jobs, comparisons and archives."""

import json
import os

import pytest
from pyspark.sql import functions as F

from longwatch.operators import chunks, compare, findings, grounding, report
from longwatch.plans import attempts, jobs, providers, review, transport
from longwatch.sources import archives, convert

# ---- answers


def item(ref="S0001", quote="the counter wraps at noon", **more):
    return {
        "finding_type": "implied_assumption", "title": "t", "description": "d", "severity": "low", "confidence": "low", "domains": ["epoch"], "evidence": [{"quote": quote}],
        "machine_interpretation": "m", "scope_relevance": "core", "scope_rationale": "r", "section_id": ref, **more,
    }


def said(*items):
    return json.dumps({"findings": list(items)})


def test_answers_are_read_to_their_first_bad_item(spark):
    rows = [(1, said(item(), item())), (2, said(item(), item(severity="bad"), item())), (3, "no"), (4, '{"findings": [], "findings": []}'), (5, None), (6, said()), (7, said(item(), 5))]
    got = {r.k: r for r in findings.read_answers(spark.createDataFrame(rows, "k int, content string")).collect()}
    assert [len(got[k]["items"]) for k in range(1, 8)] == [2, 1, 0, 0, 0, 0, 1]
    assert [(got[k].bad_item, got[k].error, got[k].repairable) for k in range(1, 8)] == [(None, None, None), (1, "invalid_field", True), (None, "json", True), (None, "duplicate_key", False), (None, "json", True), (None, None, None), (1, "not_an_object", True)]


@pytest.mark.parametrize(("source", "quote", "there"), [
    ("a Counter\n  wraps.", "counter wraps .", True), ("it's", "it ' s", False), ("it 's", "it's", True), ("x", "", False), ("x", "  ", False), ("a(b", "a (b", False), ("a )", "a)", True),
    ("\\s+", "\\s+", True), ("10.5", "10x5", False), (None, "a", False), ("a", None, False), ("a b", "a b", True),
])
def test_quote_in(spark, source, quote, there):
    got = spark.createDataFrame([(source, quote)], "s string, q string").select(grounding.quote_in(F.col("s"), F.col("q"))).first()[0]
    assert got is there
    if source and quote:
        assert there == bool(grounding.spans(source, quote))


@pytest.fixture(scope="module")
def packed(spark):
    rows = [("d", k, f"s-{k}", f"t{k}", f"Section {k}: the counter wraps at noon, and {k} more.", 1, 0, 9, None) for k in range(12)]
    rows += [("e", 0, "s-0", "t", "the clock is 32 bits", 1, 0, 9, None)]
    return chunks.pack(spark.createDataFrame(rows, "doc_id string, ord int, id string, title string, text string, level int, start_char int, end_char int, parent_id string"), window=128_000, cap=2).cache()


def tried(spark, packed, answers):
    df = spark.createDataFrame([(*a, None) if len(a) == 4 else a for a in answers], "doc_id string, request long, attempt int, content string, state string")
    found = attempts.attempts(packed, attempts.recorded(df))
    return {(r.doc_id, r.request, r.attempt): r for r in found.collect()}, found


def test_rounds(spark, packed):
    good, lost, wrong = said(item("S0001")), "sorry", said(item("S0001", "nowhere to be found"))
    got, found = tried(spark, packed, [
        ("d", 0, 1, good), ("d", 0, 2, good),  # a second answer that nobody asks for
        ("d", 1, 1, lost), ("d", 1, 2, said(item("S0003"))), ("d", 1, 3, good),
        ("d", 2, 1, said(item("S0005", "nowhere"))), ("d", 2, 2, lost),
        ("d", 3, 1, said(item("S0001"))),  # a reference of another request
        ("d", 4, 1, said(item("S0009", "nowhere"), item(severity="bad"))), ("d", 4, 2, said(item("S0010"))),  # the first bad finding decides
        ("d", 5, 1, said(item(severity="bad"), item("S0011", "nowhere"))), ("d", 5, 2, good),
        ("e", 0, 1, wrong, "truncated"), ("e", 0, 2, good), ("z", 0, 1, good),
    ])
    assert {k: (r.kind, r.outcome, r.failure) for k, r in got.items()} == {
        ("d", 0, 1): ("primary", "ok", None),
        ("d", 1, 1): ("primary", "unreadable", "json"), ("d", 1, 2): ("json_repair", "ok", None),
        ("d", 2, 1): ("primary", "ungrounded", "quote"), ("d", 2, 2): ("evidence_correction", "unreadable", "json"),
        ("d", 3, 1): ("primary", "invalid", "section_id"),
        ("d", 4, 1): ("primary", "ungrounded", "quote"), ("d", 4, 2): ("evidence_correction", "ok", None),
        ("d", 5, 1): ("primary", "invalid", "invalid_field"),
        ("e", 0, 1): ("primary", "truncated", "truncated"),
    }
    units = {(r.doc_id, r.request): (r.succeeded, r.category, r.repair_requests) for r in attempts.outcomes(found).collect()}
    assert units["d", 1] == (True, None, 1) and units["d", 2] == (False, "invalid_model_output", 1) and units["e", 0] == (False, "truncated_output", 0)
    rows = attempts.attempt_findings(packed, found).orderBy("doc_id", "id").collect()
    assert [(r.doc_id, r.id, r.section_id, r.source_verified) for r in rows] == [("d", "F-001", "s-0", True), ("d", "F-002", "s-2", True), ("d", "F-003", "s-9", True)]
    runs = review.reviewed_runs(packed, attempts.outcomes(found))
    assert report.violations(runs).count() == 0
    assert {r.run_id: (r.repair_request_count, r.total_provider_request_count) for r in runs.collect()} == {"d": (3, 9), "e": (0, 1)}


def test_no_answers_and_no_sections(spark, packed):
    got, _ = tried(spark, packed, [])
    assert len(got) == 7 and all((r.outcome, r.failure, r.attempt) == ("lost", "no_answer", 1) for r in got.values())
    assert not tried(spark, packed.limit(0), [("d", 0, 1, "x")])[0]


def test_null_section_and_repeated_answers(spark, packed):
    got, _ = tried(spark, packed, [("e", 0, 1, said(item(None, "the clock is 32 bits"))), ("d", 0, 1, said()), ("d", 0, 1, said()), ("d", 1, 1, None)])
    assert got["e", 0, 1].outcome == "invalid" and got["d", 0, 1].outcome == "ok" and got["d", 0, 1].findings == [] and got["d", 1, 1].outcome == "unreadable"


def test_correction_does_not_repeat_the_answer(spark, packed):
    seen = []

    def ask(requests):
        seen.append(requests)
        text = F.when(F.col("attempt") == 1, F.when(F.col("request") == 0, "SECRET no JSON").otherwise(said(item("S0003", "SECRET nowhere"))))
        return requests.select("doc_id", "request", F.lit(None).cast("string").alias("state"), text.alias("content"))

    attempts.attempts(packed.where("doc_id = 'd' AND chunk_index < 2"), ask)
    first, second = ({r.request: r.prompt for r in s.collect()} for s in seen)
    assert "S0001, S0002" in first[0] and "Section 2: the counter" in first[1]
    assert "SECRET no JSON" in second[0] and "Section" not in second[0]
    assert "SECRET" not in second[1] and "Section 2: the counter" in second[1]


# ---- providers


def test_registry():
    assert "mock" in providers.names() and providers.opener(" MOCK ") is providers.Mock
    with pytest.raises(providers.NotConfigured, match="Unknown provider 'nope'. Known: "):
        providers.opener("nope")


def test_mock(spark):
    assert json.loads(providers.Mock().complete("anything", "").content)["findings"][0]["section_id"] == "s-1"
    allowed = lambda *refs: f"x\n{providers.ALLOWLIST}\n{', '.join(refs)}\nmore"
    payload = {"findings": [{"section_id": "S0002"}]}
    assert json.loads(providers.Mock(payload).complete(allowed("S0001", "S0002"), "").content) == payload
    assert json.loads(providers.Mock(payload).complete(allowed("S0001"), "").content) == {"findings": []}
    assert json.loads(providers.Mock({"findings": []}).complete(allowed("S0001"), "").content) == {"findings": []}


class Counting:
    """A session that tells how many requests it has answered."""

    def __init__(self, fail=-1):
        self.n, self.fail = 0, fail

    def complete(self, prompt, key):
        self.n += 1
        return providers.Answer(f"{self.n} {key}", state="ok" if self.n != self.fail else "truncated")

    def close(self):
        self.n = -1000


def test_one_session_a_lane(spark, monkeypatch):
    monkeypatch.setitem(providers._OPENERS, "counting", Counting)
    requests = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("request"), F.lit(1).alias("attempt"), F.lit("p").alias("prompt"))
    got = providers.ask(requests, "counting", lanes=5, fail=2).collect()
    assert len(got) == 300 and {r.content.split()[1] for r in got} == {f"{i}/{i % 3}/1" for i in range(300)}
    lane = {r.doc_id: r.lane for r in requests.select("doc_id", F.pmod(F.xxhash64("doc_id", "request"), F.lit(5)).alias("lane")).collect()}
    for k in range(5):
        mine = sorted((r.doc_id, int(r.content.split()[0]), r.state) for r in got if lane[r.doc_id] == k)
        assert [n for _, n, _ in mine] == list(range(1, len(mine) + 1)) and [s for _, _, s in mine].count("truncated") == 1


def test_whole_review_with_a_provider(spark, packed):
    payload = {"findings": [item("S0001")]}
    found = attempts.attempts(packed, providers.asking("mock", payload=payload))
    assert {(r.doc_id, r.request): r.outcome for r in found.where("attempt = 1").collect()}["d", 0] == "ok"
    got = attempts.attempt_findings(packed, found).collect()  # e's first section has no such quote: corrected once, in vain
    assert [(r.doc_id, r.section_id) for r in got] == [("d", "s-0")]
    assert {(r.attempt, r.kind, r.outcome) for r in found.where("doc_id = 'e'").collect()} == {(1, "primary", "ungrounded"), (2, "evidence_correction", "ungrounded")}


# ---- the line


def line(*script, **more):
    waits = []
    return transport.Line(transport.scripted, wait=waits.append, **more), {"script": list(script)}, waits


def test_backoff_is_capped():
    assert [transport.backoff(k) for k in range(1, 7)] == [1, 2, 4, 8, 8, 8]


def test_retries():
    at, payload, waits = line("503", "read_timeout", 'ok {"a": 1}')
    assert at.post(payload) == {"a": 1} and waits == [1, 2]
    assert at.taken() == [(1, "HTTP 503", 1), (2, "read timeout", 2), (3, "ok", 0)] and at.taken() == []


@pytest.mark.parametrize(("script", "category", "retryable", "tries"), [
    (["500", "502", "504", "ok"], "HTTP 504", True, 3), (["401 key sk-secret"], "HTTP 401", False, 1), (["connect_timeout"], "connect timeout", True, 1), (["200 [1]"], "unexpected response", False, 1),
    (["200 {\"a\": NaN}"], "unexpected response", False, 1), (["network", "connect"], "connection failure", True, 2), (["strange"] * 3, "network error", True, 3),
])
def test_given_up(script, category, retryable, tries):
    at, payload, _ = line(*script)
    with pytest.raises(transport.RequestFailed) as e:
        at.post(payload)
    assert (e.value.category, e.value.retryable, e.value.attempts) == (category, retryable, tries) and "secret" not in str(e.value)


def test_connections_are_tried_as_often_as_asked():
    at, payload, waits = line("connect", "connect", "ok", connect_attempts=3)
    assert at.post(payload) == {} and waits == [1, 2]


def test_latch_stays():
    at = transport.Line(transport.scripted, wait=lambda _: None, unsupported=transport.names_response_format)
    latch = transport.Latch(at, "response_format")
    send = lambda *script: latch.post({"script": list(script), "response_format": {}})
    send("ok")
    assert not latch.off
    send("503", "probe", "ok")
    assert latch.off and at.taken() == [(1, "ok", 0), (1, "HTTP 503", 1), (2, "HTTP 400", 0), (1, "ok", 0)]
    send("probe")  # would be refused with the feature
    assert at.taken() == [(1, "ok", 0)]
    other = transport.Latch(transport.Line(transport.scripted, unsupported=transport.names_response_format), "response_format")
    with pytest.raises(transport.RequestFailed):
        other.post({"script": ["400 {\"error\": \"no\"}"], "response_format": {}})
    assert not other.off


def test_posted_answers():
    def send(payload):
        return transport.Reply(body=json.dumps({"choices": [{"finish_reason": payload["user"], "message": {"content": "c"}}], "usage": {"prompt_tokens": 3, "completion_tokens": 2}})) if payload["user"] != "bad" else transport.Reply(403)

    p = providers.Posted(send, "m")
    assert [p.complete("x", k) for k in ("stop", "length", "tool_calls", "bad")] == [providers.Answer("c", 3, 2, "m", "ok"), providers.Answer("c", 3, 2, "m", "truncated"), providers.Answer("c", 3, 2, "m", "shape"), providers.Answer(None, 0, 0, "m", "HTTP 403")]


# ---- jobs


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / "jobs")


def planned(spark, n=40):
    return spark.createDataFrame([(i, f"c{k}", i * 10 + k) for i in range(n) for k in range(2)], "bench_id long, config_id string, x long")


def work(calls=None, fail=lambda rows: F.lit(False), drop=None):
    def run(rows):
        if calls is not None:
            calls.append({(r.bench_id, r.config_id) for r in rows.collect()})
        out = rows.select("bench_id", "config_id", F.when(fail(rows), "failed").alias("status"), (F.col("x") * 2).alias("y"))
        return out.where(drop) if drop else out

    return run


def states(spark, p, folder):
    return {(r.bench_id, r.config_id): (r.status, r.attempts, r.y) for r in jobs.job_states(p, folder).collect()}


def test_a_run_that_was_cut_off_equals_a_whole_one(spark, folder):
    p, what = planned(spark), jobs.Definition("t", "d")
    whole = folder + "-whole"
    assert jobs.run_jobs(p, work(), whole, what, buckets=8, at_a_time=2) == 4
    for k in range(1, 6):
        calls = []
        jobs.run_jobs(p, work(calls), folder, what, buckets=8, at_a_time=2, most_rounds=1)
        seen = states(spark, p, folder) if k < 5 else None
        if k < 4:
            assert 0 < sum(s[0] == "executed" for s in seen.values()) < 80
    assert calls == [set(), set(), set(), set()]  # nothing is left
    assert states(spark, p, folder) == states(spark, p, whole) == {(i, f"c{k}"): ("executed", 1, 2 * (i * 10 + k)) for i in range(40) for k in range(2)}


def test_a_round_that_breaks_leaves_the_folder_as_it_was(spark, folder):
    p, what = planned(spark), jobs.Definition("t", "d")
    jobs.run_jobs(p, work(), folder, what, buckets=8, at_a_time=2, most_rounds=2)
    before = sorted(map(tuple, jobs.job_table(spark, folder).collect()))
    boom = F.when(F.col("bench_id") >= 0, F.raise_error(F.lit("boom"))).cast("boolean")
    with pytest.raises(Exception, match="boom"):
        jobs.run_jobs(p, work(fail=lambda _: boom), folder, what, buckets=8, at_a_time=2)
    assert sorted(map(tuple, jobs.job_table(spark, folder).collect())) == before
    jobs.run_jobs(p, work(), folder, what, buckets=8, at_a_time=2)
    assert len(states(spark, p, folder)) == 80


def test_failed_and_missing_jobs(spark, folder):
    p, what = planned(spark), jobs.Definition()
    jobs.run_jobs(p, work(fail=lambda r: F.col("bench_id") == 3, drop="bench_id <> 4"), folder, what, buckets=4, at_a_time=4)
    got = states(spark, p, folder)
    assert got[3, "c0"] == ("failed", 1, 60) and got[4, "c1"] == ("failed", 1, None) and got[5, "c0"] == ("executed", 1, 100)
    calls = []
    jobs.run_jobs(p, work(calls), folder, what, buckets=4, at_a_time=4, again=("failed",))
    assert calls == [{(i, f"c{k}") for i in (3, 4) for k in (0, 1)}]
    got = states(spark, p, folder)
    assert got[3, "c0"] == ("executed", 2, 60) and got[4, "c1"] == ("executed", 2, 82) and len(got) == 80
    assert jobs.job_table(spark, folder).count() == 80


def test_another_definition_is_refused(spark, folder):
    p = planned(spark, 2)
    jobs.run_jobs(p, work(), folder, jobs.Definition("t", "d", ("c0",), {"max": 1}), buckets=2)
    jobs.run_jobs(p, work(), folder, jobs.Definition("t", "d", ("c0",), {"max": 1}), buckets=2)
    for other, name in ((jobs.Definition("u", "d", ("c0",), {"max": 1}), "tag"), (jobs.Definition("t", "d", ("c0",), {"max": 2}), "controls"), (jobs.Definition("t", "e", ("c0",), {"max": 1}), "documents")):
        with pytest.raises(jobs.OtherDefinition) as e:
            jobs.run_jobs(p, work(), folder, other, buckets=2)
        assert e.value.field == name


def test_new_jobs_are_added_to_old_ones(spark, folder):
    what = jobs.Definition()
    jobs.run_jobs(planned(spark, 5), work(), folder, what, buckets=4)
    calls = []
    jobs.run_jobs(planned(spark, 7), work(calls), folder, what, buckets=4)
    assert set().union(*calls) == {(i, f"c{k}") for i in (5, 6) for k in (0, 1)}
    assert {s[0] for s in states(spark, planned(spark, 9), folder).values()} == {"executed", "pending"}


def test_documents_digest(spark):
    a = spark.createDataFrame([(1, "a"), (2, None)], "i int, t string")
    d = jobs.documents_digest(a, ["i", "t"])
    assert d == jobs.documents_digest(a.orderBy(F.desc("i")).repartition(3), ["i", "t"]) and d.startswith("2-")
    assert d != jobs.documents_digest(a.fillna(""), ["i", "t"]) and jobs.documents_digest(a.limit(0), ["i"]).startswith("0-")


# ---- comparisons


def test_differences(spark):
    schema = "k int, model string, coverage_complete boolean, actual_usage struct<input_tokens:long,output_tokens:long>, chunk_section_counts array<int>"
    a = spark.createDataFrame([(1, "m", True, (1, None), [1, 2]), (2, None, None, None, None), (3, "x", True, (0, 0), [])], schema)
    b = spark.createDataFrame([(1, "m", False, (1, 5), [1, 3]), (2, None, None, None, None), (4, "x", True, (0, 0), [])], schema)
    got = {(r.k, r.field): (r.left, r.right) for r in compare.differences(a, b, ["k"]).collect()}
    assert got == {
        (1, "coverage_complete"): ("true", "false"), (1, "actual_usage.output_tokens"): (None, "5"), (1, "chunk_section_counts"): ("[1,2]", "[1,3]"), (3, "run"): ("present", None), (4, "run"): (None, "present"),
    }
    assert compare.comparison_fields(a, ["k"]).count() == 3 * len(compare.FIELDS)
    assert compare.differences(a, a, ["k"]).count() == 0


# ---- archives


@pytest.fixture(scope="module")
def folder_of_archives(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("archives")
    archives.register(spark)
    text = [("b/x.txt", b"x" * 50), ("a.docx", b"docx"), (".hidden", b"h"), ("__MACOSX/m.txt", b"m"), ("n/y.TXT", b"yy"), ("big.txt", os.urandom(3000))]
    for kind in ("zip", "tar"):
        (at / f"one.{kind}").write_bytes(archives.packed(kind, text))
    (at / "broken.zip").write_bytes(b"PK\x03\x04 nothing")
    (at / "broken.tar").write_bytes(b"no archive at all" * 40)
    (at / "empty.zip").write_bytes(archives.packed("zip", []))
    (at / "_temporary").write_bytes(b"x")
    return str(at)


def members(spark, path, **options):
    rows = spark.read.format("archives").options(**options).load(path).collect()
    return {(os.path.basename(r.path), r.name): (bytes(r.content) if r.content is not None else None, r.error) for r in rows}


def test_every_member_or_an_error(spark, folder_of_archives):
    got = members(spark, folder_of_archives, maxMemberBytes=1000)
    for kind in ("zip", "tar"):
        assert {k[1]: v for k, v in got.items() if k[0] == f"one.{kind}"} == {"b/x.txt": (b"x" * 50, None), "a.docx": (b"docx", None), "n/y.TXT": (b"yy", None), "big.txt": (None, "member too large")}
    assert got["broken.zip", None] == got["broken.tar", None] == (None, "unreadable archive") and len(got) == 10


def test_the_member_to_convert(spark, folder_of_archives):
    got = members(spark, folder_of_archives, choose="true")
    assert got["one.zip", "a.docx"] == got["one.tar", "a.docx"] == (b"docx", None) and got["empty.zip", None] == (None, "no member to convert") and len(got) == 5
    for wanted, name in (("x.txt", "b/x.txt"), ("other/y.txt", "n/y.TXT")):
        got = members(spark, folder_of_archives, member=wanted)
        assert ("one.zip", name) in got and ("one.tar", name) in got and got["empty.zip", None] == (None, "no such member")


def test_limits_of_archives(spark, folder_of_archives):
    assert members(spark, folder_of_archives + "/one.zip", maxMembers=3) == {("one.zip", None): (None, "too many members")}
    assert ("one.tar", None) in members(spark, folder_of_archives + "/one.tar", maxMembers=3)
    assert members(spark, folder_of_archives + "/one.zip", maxArchiveBytes=10) == {("one.zip", None): (None, "archive too large")}
    assert members(spark, folder_of_archives + "/one.zip", maxRatio=2)["one.zip", "b/x.txt"] == (None, "member too large")
    with pytest.raises(Exception, match="positive"):
        members(spark, folder_of_archives, maxMembers=0)


def test_filters_reach_the_archives(spark, folder_of_archives):
    df = spark.read.format("archives").load(folder_of_archives)
    for f, n in ((F.col("name") == "a.docx", 2), (F.col("name").isin("a.docx", "b/x.txt"), 4), (F.col("name").startswith("b/"), 2), (F.col("name").endswith(".TXT"), 2), (F.col("name").contains("ig"), 2)):
        found = df.where(f)
        assert found.count() == n
        plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
        assert "PushedFilters: [" in plan and "name" in plan.split("PushedFilters: [")[1].split("]")[0]
    assert df.where("error IS NOT NULL").count() == 2


def test_files_that_are_too_large_are_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(convert, "MAX_FILE_BYTES", 10)
    (tmp_path / "a.txt").write_text("small")
    (tmp_path / "b.txt").write_text("much too large")
    files = convert.read_documents(spark, str(tmp_path), "binary")
    got = {os.path.basename(r.path): (r.text, r.error) for r in convert.converted(files).collect()}
    assert got == {"a.txt": ("small", None), "b.txt": (None, "file too large")}


def test_wanted_member_of_a_conversion(spark):
    data = archives.packed("zip", [("a.docx", b"x"), ("n/b.txt", b"wanted text")])
    files = spark.createDataFrame([("z.zip", data)], "path string, content binary")
    assert convert.converted(files, member="b.txt").first().text == "wanted text"
    assert convert.converted(files, member="c.txt").first().error == "no such member"


def test_small_archives_share_a_partition(spark, tmp_path):
    for k in range(70):
        archives.put(f"{tmp_path}/a/{k:03}.zip", archives.packed("zip", [("x.txt", b"%d" % k)]))
    archives.put(f"{tmp_path}/a/large.zip", archives.packed("zip", [("y.txt", os.urandom(5 << 20))]))
    archives.register(spark)
    rows = spark.read.format("archives").load(f"{tmp_path}/a")
    assert rows.rdd.getNumPartitions() == 3  # 64, 6, and the large one by itself
    assert sorted(r.name for r in rows.select("name").collect()) == ["x.txt"] * 70 + ["y.txt"]
