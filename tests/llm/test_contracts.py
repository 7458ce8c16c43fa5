"""The registered queries on whole small tables, against SQL or brute force over the same rows."""

import hashlib
import itertools
import os
import random
import re
import unicodedata
import zlib

import numpy as np
import pytest

from longwatch.llm import pieces, queries, urls
from tests.oracle import DATA, rows, views

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def documents(spark):
    return sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect())


def run(spark, name):
    return queries.QUERIES[name](spark, DATA)


def roots(ids, links):
    label = {i: i for i in ids}

    def top(i):
        while label[i] != i:
            label[i] = i = label[label[i]]
        return i

    for a, b in links:
        x, y = top(a), top(b)
        label[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, name):
    got, want = run(spark, name).toPandas(), views().sql(queries.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_op1_has_its_own_conversation(spark):
    r = run(spark, "op1_chat_formatting").where("conv_id = -7").first()
    text = "\\### Assistant: </turn> ok"
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())
    assert r.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def test_op3_listed_rules(spark):
    url = {r.page_id: r.url or "" for r in spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url").collect()}
    got = run(spark, "op3_url_rules").collect()
    assert len(got) == len(url)
    for r in got:
        rest = url[r.page_id].partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0].lower()
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        fits = [(rule, v) for rule, v in urls.LISTED if (host == rule.split("/")[0] or host.endswith("." + rule.split("/")[0])) and path.startswith("/" + rule.partition("/")[2])]
        rule, verdict = max(fits, key=lambda f: len(f[0]), default=(None, None))
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")


def test_mined_rules_are_all_rules(spark):
    r = random.Random(50)
    sets = []
    for _ in range(600):
        have = {t for t in "abcdefg" if r.random() < 0.45} or {"a"}
        bad = r.random() < (0.9 if {"a", "c"} <= have else 0.8 if {"b", "d", "e"} <= have else 0.7 if have == {"f"} else 0.25)
        sets.append((sorted(have), bad))
    least = 25
    rules = {}
    for size in range(1, 8):
        for s in itertools.combinations("abcdefg", size):
            of = [bad for have, bad in sets if set(s) <= set(have)]
            if sum(of) >= least and sum(of) / len(of) >= 0.6 and not any(set(x) <= set(s) for x in rules):
                rules[s] = sum(of) / len(of)
    got = urls.mine_rules(spark.createDataFrame(sets, "tokens array<string>, bad boolean"), confidence=0.6)
    assert {tuple(sorted(t)): c for t, c in got} == pytest.approx(rules)
    count = {t: sum(t in have for have, _ in sets) for t in "abcdefg"}
    assert all([count[x] for x in t] == sorted(count[x] for x in t) for t, _ in got)


def test_blocked_pages_come_from_mined_rules(spark):
    pages = spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/pages.parquet").select("page_id", "url")
    url = {r.page_id: r.url for r in pages.collect()}
    word = next(w for w in ("html", "en", "de", "fr", "es") if 40 < sum(f"/{w}/" in (u or "") for u in url.values()) < 200)
    labels = spark.createDataFrame([(i, f"/{word}/" in (u or "")) for i, u in url.items()], "page_id long, bad boolean")
    got = {r.page_id: r for r in urls.judge(pages, labels, rules=(), confidence=1.0).collect()}
    assert all((got[i].verdict == "block") == (f"/{word}/" in (u or "")) for i, u in url.items())
    assert all(r.rule is None for r in got.values())


def test_op4_against_brute_force(spark, documents):
    from tests.llm.test_small import plain_simhash

    fp = {i: plain_simhash(t) for i, t in documents}
    links = [(a, b) for a, b in itertools.combinations(fp, 2) if (fp[a] ^ fp[b]).bit_count() <= 2]
    want = roots(fp, links)
    got = {r.doc_id: r for r in run(spark, "op4_simhash_bk_trees").collect()}
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{fp[i]:016x}", want[i]) for i in fp}


def test_op5_against_brute_force(spark):
    given = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.array([r.embedding for r in given], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    ids = [r.vec_id for r in given]
    root = roots(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near), strict=True)])
    got = {r.vec_id: r for r in run(spark, "op5_nn_descent").collect()}
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (int(n), root[i], root[i] == i) for i, n in zip(ids, near.sum(1), strict=True)}


def test_op6_finds_all_verbatim_passages(spark, documents):
    got = run(spark, "op6_collinear_chains").collect()
    words = {i: t.encode().lower().split() for i, t in documents}
    covered = {i: np.zeros(len(w), bool) for i, w in words.items()}
    for r in got:
        assert r.n_words == r.end_word - r.start_word >= 50 and 0 <= r.start_word < r.end_word <= len(words[r.doc_id]) and r.source_doc_id < r.doc_id and r.similarity >= 0.8
        covered[r.doc_id][r.start_word:r.end_word] = True
    first = {}
    for i, w in words.items():
        for k in range(len(w) - 49):
            first.setdefault(b" ".join(w[k:k + 50]), i)
    for i, w in words.items():
        for k in range(len(w) - 49):
            if first[b" ".join(w[k:k + 50])] < i:
                assert covered[i][k:k + 50].all(), (i, k)


def test_op7_against_one_agenda_a_word(spark, documents):
    model = pieces.Pieces(pieces.MODEL)
    got = {r.doc_id: r for r in run(spark, "op7_sentencepiece_dropout").collect()}
    assert len(got) == len(documents) and all(r.lossless for r in got.values())
    below = int(pieces.RATE * 2**64)
    for i, t in documents[::9]:
        words = pieces._WORDS.findall(" " + t) if t else []
        doc = pieces.xxhash.xxh64_intdigest(f"{pieces.SEED} 0 {i}")
        ids = b"".join(model.segment(w, int(pieces._mixed(doc ^ pieces._mixed((k + 1) * pieces._B % 2**64))), below) for k, w in enumerate(words))
        assert (got[i].n_tokens, got[i].tokens_sha256) == (len(ids) // 2, hashlib.sha256(ids).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_op8_against_brute_force(spark, documents):
    first = {}
    for i, t in documents:
        b = t.encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k:k + 50], i)
    got = {r.doc_id: r for r in run(spark, "op8_suffix_array_dedup").collect()}
    for i, t in documents:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k:k + 50]] < i:
                gone[k:k + 50] = True
        left = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(np.r_[0, gone.astype(np.int8), 0]) == 1).sum())
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest())


def test_op9_against_plain_forms(spark, documents):
    def form(t):
        t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())
        return " ".join(re.split(r"[\s\u0085   -     　]+", t)).strip()

    got = {r.doc_id: r for r in run(spark, "op9_canonical_digest").collect()}
    prints = {}
    for k, (i, t) in enumerate(documents):
        after, tail = documents[(k + 1) % len(documents)][1], len(t) // 4
        edited = t[:len(t) - tail] + after[:tail]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(form(t), r.fingerprint) == r.fingerprint and prints.setdefault(form(edited), r.edited_fingerprint) == r.edited_fingerprint
        assert (r.near_edited, r.near_next) == (float(form(t) == form(edited)), float(form(t) == form(after)))
    assert len(set(prints.values())) == len(prints)


def test_op10_on_held_out_labels(spark, documents):
    got = {r.doc_id: r for r in run(spark, "op10_quality_votes").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert set(got) == {i for i, _ in documents}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    good = [got[i].score for i, q in labels.items() if q == 1 and i in got and got[i].held_out]
    bad = [got[i].score for i, q in labels.items() if q == 0 and i in got and got[i].held_out]
    assert good and (not bad or np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) >= 0.9)


def test_op3_words_of_the_contract(spark):
    urls_ = ["http://a.com/en/1", "http://example.com/en/71", "http://a.net/de/1", "http://b.example.net/de/80", "http://a.org/es/"]
    pages = spark.createDataFrame(list(enumerate(urls_)), "page_id long, url string")
    got = urls.judge(pages, spark.createDataFrame([], "page_id long, bad boolean")).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in got] == [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
