"""Brute force, round trips and edge cases for the training-data operators."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from longwatch.llm import chat, common, digest, embeddings, mixing, neartext, passages, pieces, quality, simhash, suffix, urls

DOC = "doc_id bigint, text string, lang string, source string, fp string, score string, kept string, _row string"


def docs(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, None, s, "x", "y", "z", "w") for i, t, s in rows], DOC)


def words(n, seed, vocabulary=2000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


EDGES = [(None, "null id text here", None), (1, None, "a"), (2, "", "a"), (3, "   \n", "b"), (4, "one", "b"), (4, "one", "b"), (5, "one", None), (6, "x" * 30000 + " " + "\u00e9" * 5000, "c"), (7, words(20000, 1), "c")]


@pytest.fixture(scope="module")
def edge(spark):
    return docs(spark, EDGES)


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, [])


# ---- components


@pytest.mark.parametrize("most", [1 << 20, 40])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr(common, "LINKS", most)
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(260)] + [(5, 5), (None, 3)]
    parent = list(range(300))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges[:260]:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    got = {x.node: x.root for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {n: top(n) for e in edges[:260] for n in e if e[0] != e[1]}
    assert got == want
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- SimHash


def plain_simhash(text, k=3):
    import xxhash

    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_matches_its_definition(monkeypatch):
    monkeypatch.setattr(simhash, "_BLOCK", 50)
    for t in ("", "a", "A b", "a b c", "\u0130 B\tc\x0bd e", words(300, 2)):
        assert simhash.simhash(simhash.shingle_hashes(t, 3)) == plain_simhash(t)


def test_simhash_is_spark_xxhash(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % 2**64 == int(simhash.shingle_hashes("a b c", 3)[0])


@pytest.mark.parametrize("tree", [4096, 7])
def test_fingerprint_links(spark, tree):
    r = random.Random(4)
    values = {r.getrandbits(64) for _ in range(40)}
    values |= {v ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for v in list(values) for _ in range(3)} | {0, 1, 3, 2**63}
    fps = np.array(sorted(values), np.uint64)
    links = simhash.fingerprint_links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"), 2, tree)
    got = {r.node: r.root for r in common.components(links).collect()}
    signed = fps.view(np.int64)
    label = {int(v): int(v) for v in signed}
    near = [(int(signed[i]), int(signed[j])) for i in range(len(fps)) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= 2]
    for _ in range(len(fps)):
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
    assert {k: got.get(k, k) for k in label} == label


def test_simhash_groups_edges(spark, edge, none):
    got = simhash.simhash_groups(edge).collect()
    assert len(got) == len(EDGES)
    by = {r.doc_id: (r.fp, r.component_id) for r in got}
    assert by[1] == by[2] == by[3] == (0, 1) and by[4] == by[5] and by[5][1] == 4 and by[None][1] is None
    assert simhash.simhash_groups(none).count() == 0


def test_near_texts(spark, edge, none):
    base = words(200, 5).split()
    near = base[:]
    near[100] = "changed"
    far = base[:]
    far[::7] = ["other"] * len(far[::7])
    rows = [(10, " ".join(base), None), (11, " ".join(near), None), (12, " ".join(base).upper(), None), (13, " ".join(base), None), (14, " ".join(far), None), (15, "a b", None), (16, "A  b", None), (17, "", None), (18, None, None), (19, " ", None)]
    got = {r.doc_id: r.component_id for r in neartext.near_text_groups(docs(spark, rows)).collect()}
    assert got == {11: 10, 12: 10, 13: 10, 16: 15, 18: 17}
    assert sorted(r.doc_id for r in neartext.keep_one(docs(spark, rows)).collect()) == [10, 14, 15, 17, 19]
    assert sorted((r.doc_id or 0) for r in neartext.keep_one(edge).collect()) == [0, 1, 3, 4, 6, 7]
    assert neartext.keep_one(none).count() == 0


def test_near_texts_against_brute_force(spark):
    r = random.Random(6)
    texts = []
    for g in range(12):
        base = words(120, 100 + g).split()
        for k in range(8):
            t = base[:]
            for _ in range(k):
                t[r.randrange(120)] = f"z{r.randrange(10**6)}"
            texts.append(" ".join(t))
    sets = [set(map(int, simhash.shingle_hashes(t, 5))) for t in texts]
    label = list(range(len(texts)))
    near = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    for _ in range(len(texts)):
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
    for tree in (4096, 16):
        got = {x.doc_id: x.component_id for x in neartext.near_text_groups(docs(spark, [(k, t, None) for k, t in enumerate(texts)]), tree=tree).collect()}
        assert [got.get(k, k) for k in range(len(texts))] == label


def test_refuted_pairs_hide_no_link(spark):
    r = random.Random(31)
    base = words(404, 32, 10**6).split()
    texts = []
    for _ in range(150):
        t = base[:]
        for at in r.sample(range(5, 399), r.choice((4, 5))):
            t[at] = f"z{r.randrange(10**9)}"
        texts.append(" ".join(t))
    sets = [set(map(int, simhash.shingle_hashes(t, 5))) for t in texts]
    label = list(range(len(texts)))
    near = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    for _ in range(len(texts)):
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
    got = {x.doc_id: x.component_id for x in neartext.near_text_groups(docs(spark, [(k, t, None) for k, t in enumerate(texts)])).collect()}
    assert [got.get(k, k) for k in range(len(texts))] == label


def test_sets_and_not_counts_decide(spark):
    rows = []
    for k in range(12):
        w = words(300, 40 + k, 10**6).split()
        line = w[100:114]
        rows += [(2 * k, " ".join(w + line)), (2 * k + 1, " ".join(w + line * 500))]
    rows += [(100 + k, ("a", "A")[k & 1] + " " * (1 + k // 2) + "b") for k in range(12)]
    for k in range(60):
        w = [f"s{k}x{i}" for i in range(9)]
        rows += [(200 + 2 * k, " ".join(w)), (201 + 2 * k, " ".join(w[:8]))]
    sets = {i: set(map(int, simhash.shingle_hashes(t, 5))) for i, t in rows}
    want = {2 * k + 1: 2 * k for k in range(12)} | {100 + k: 100 for k in range(1, 12)} | {201 + 2 * k: 200 + 2 * k for k in range(60)}
    assert all(len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8 for a, b in want.items())
    for tree in (4096, 4):
        assert {x.doc_id: x.component_id for x in neartext.near_text_groups(docs(spark, [(*x, None) for x in rows]), tree=tree).collect()} == want


def test_a_hot_tree_is_searched_in_bounded_pieces():
    r = np.random.default_rng(12)
    base = int(r.integers(1, 2**62))
    noise = np.array([sum(1 << int(b) for b in r.choice(64, r.integers(0, 7), replace=False)) for _ in range(12000)], np.uint64)
    values = np.uint64(base) ^ noise
    nodes = np.unique(values[:4000])
    forest = simhash.Forest(nodes, np.zeros(len(nodes), np.int64))
    found, widest = 0, 0
    for q, node in forest.search(values, np.zeros(len(values), np.int64), 8, most=1 << 14):
        assert (np.bitwise_count(values[q] ^ nodes[node]) <= 8).all()
        found, widest = found + len(q), max(widest, len(q))
    assert widest <= 1 << 14
    assert found == sum(int((np.bitwise_count(v ^ nodes) <= 8).sum()) for v in values)


def test_documents_of_one_id_count_as_one(spark):
    a, b = words(60, 70, 10**6), words(60, 71, 10**6)
    rows = [(1, a, None), (2, b, None), (3, a + " x", None), (3, b + " y", None), (4, words(60, 72, 10**6), None), (4, words(60, 72, 10**6), None), (5, words(60, 73, 10**6), None)]
    got = {r.doc_id: r.component_id for r in neartext.near_text_groups(docs(spark, rows)).collect()}
    assert got == {2: 1, 3: 1}


# ---- suffix dedup


def plain_removal(rows, length):
    first = {}
    for i, t in sorted(rows):
        for k in range(len(t) - length + 1):
            first.setdefault(t[k:k + length], i)
    out = []
    for i, t in rows:
        gone = [False] * len(t)
        for k in range(len(t) - length + 1):
            if first[t[k:k + length]] < i:
                gone[k:k + length] = [True] * length
        out.append((i, bytes(c for c, g in zip(t, gone, strict=True) if not g)))
    return sorted(out)


def test_bwt_orders_all_suffixes():
    r = random.Random(7)
    for _ in range(20):
        strings = list({bytes(r.choice(b"ab") for _ in range(r.randint(4, 14))) for _ in range(25)})
        table = np.zeros((len(strings), 14), np.uint8)
        for row, s in zip(table, strings, strict=True):
            row[14 - len(s):] = list(s)
        string, size, near = suffix.bwt_windows(table, np.array(list(map(len, strings))), 4)
        found = [strings[i][len(strings[i]) - n:] for i, n in zip(string, size, strict=True)]
        assert found == sorted(found) and len(found) == sum(len(s) + 1 for s in strings)
        assert all(near[k] == (found[k][:4] == found[k - 1][:4]) for k in range(1, len(found)) if min(size[k], size[k - 1]) >= 4)


@pytest.mark.parametrize("length", [50, 32])
def test_removal_against_brute_force(spark, length, monkeypatch):
    r = random.Random(length)
    shared = [bytes(r.choice(b"abcdefg ") for _ in range(n)).decode() for n in (49, 50, 51, 200, 3000)]
    rows = []
    for i in range(60):
        parts = [r.choice(shared) if r.random() < 0.5 else "".join(r.choice("abcdefg ") for _ in range(r.randint(0, 300))) for _ in range(r.randint(0, 5))]
        rows.append((i, "".join(parts)))
    rows += [(60, "a" * 500), (61, "a" * 400 + "b"), (62, "\u00e9" * 100), (63, "x\u00e9" * 50 + "\u00e9" * 60), (7, "a" * 120)]
    got = suffix.remove_repeats(docs(spark, [(i, t, None) for i, t in rows]), length=length).collect()
    assert sorted((r.doc_id, bytes(r.kept)) for r in got) == plain_removal([(i, t.encode()) for i, t in rows], length)


def test_removal_edges(edge, none):
    got = suffix.remove_repeats(edge).collect()
    assert len(got) == len(EDGES) and all(r.n_bytes - sum(e - s for s, e in zip(r.starts, r.ends, strict=True)) == len(r.kept) for r in got)
    assert suffix.remove_repeats(none).count() == 0


def test_removal_keeps_whole_characters(spark):
    rows = [(1, "\u00e9" * 40), (2, "a" + "\u00e9" * 30 + "\u20ac")]
    got = {r.doc_id: bytes(r.kept).decode() for r in suffix.remove_repeats(docs(spark, [(*x, None) for x in rows]), characters=True).collect()}
    assert got == {1: "\u00e9" * 40, 2: "a\u20ac"}


# ---- passages


def test_chains_rise():
    r = np.random.default_rng(8)
    x, y = np.sort(r.integers(0, 500, 200)), r.integers(0, 500, 200)
    for size in (np.ones(200, np.int64), r.integers(1, 9, 200)):
        found = passages.chains(x, y, size)
        assert sorted(np.concatenate(found).tolist()) == list(range(200))
        assert all((np.diff(x[c]) >= size[c[:-1]]).all() and (np.diff(y[c]) >= size[c[:-1]]).all() for c in found)
        # the first chain is the best of all: by the plain recurrence
        best = np.zeros(200)
        for i in np.argsort(x, kind="stable"):
            ok = np.flatnonzero((x + size <= x[i]) & (y + size <= y[i]))
            gaps = passages._COST * (x[i] + y[i] - x[ok] - y[ok] - 2 * (size[ok] - 1))
            best[i] = passages._GAIN * size[i] + max(0.0, *(best[ok] - gaps)) if len(ok) else passages._GAIN * size[i]
        c = found[0]
        steps = passages._COST * (np.diff(x[c]) + np.diff(y[c]) - 2 * (size[c[:-1]] - 1))
        assert abs(passages._GAIN * size[c].sum() - steps.sum() - best.max()) < 1e-6


def test_stretches_hold_all_links():
    r = np.random.default_rng(9)
    x, y = r.integers(0, 40, 300), r.integers(0, 40, 300)
    a, b, n, _ = passages.stretches(x, y)
    assert {(i + k, j + k) for i, j, m in zip(a.tolist(), b.tolist(), n.tolist()) for k in range(m)} == set(zip(x.tolist(), y.tolist()))
    assert int(n.sum()) == len(set(zip(x.tolist(), y.tolist())))


def test_long_templates_do_not_recurse():
    shared = [f"s{i}" for i in range(24)]
    a, b = (np.concatenate([passages.word_hashes(" ".join([*shared, *(f"{side}{k}x{i}" for i in range(6))]).encode()) for k in range(1200)]) for side in "ab")
    ha, ia = passages.seeds(a)
    at = {}
    for h, i in zip(passages.seeds(b)[0].tolist(), range(len(b))):
        at.setdefault(h, i)
    x = np.array([30 * k + i for k in range(1200) for i in range(20)])
    n = passages.stretches(x, x)[:3]
    found = [[v[c] for v in n] for c in passages.pieces(*n)]
    parts = [q for p in found for q in passages.align(a, b, *p)]
    assert sum(z - s for s, z, _ in parts) >= 1200 * 24 and all(n >= 0.8 * (z - s) for s, z, n in parts)


@pytest.mark.parametrize("holders", [3, 12])
def test_scattered_holders_hide_no_pair(spark, holders):
    """Two documents share a passage whose seeds all occur in scattered earlier documents."""
    p = words(80, 900, 10**6).split()
    quotes = [" ".join(p[k:k + 6]) for k in range(0, 75, 2)]
    rows = [(i * 100 + k, f"{words(40, 1000 + i * 100 + k, 10**6)} {q} {words(40, 2000 + i * 100 + k, 10**6)}") for i in range(holders) for k, q in enumerate(quotes)]
    rows += [(5000, f"{words(60, 901, 10**6)} {' '.join(p)}"), (5001, f"{' '.join(p)} {words(60, 902, 10**6)}")]
    got = [tuple(r)[:4] for r in passages.shared_passages(docs(spark, [(*x, None) for x in rows])).collect()]
    assert (5001, 5000, 0, 80) in got


def test_common_words():
    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, p in enumerate(a):
            for j, q in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if p == q else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    r = np.random.default_rng(9)
    for _ in range(50):
        a, b = r.integers(0, 4, r.integers(0, 12)), r.integers(0, 4, r.integers(0, 12))
        assert passages.common_words(a, b) == slow(a.tolist(), b.tolist())


def test_passages(spark, edge, none):
    shared = words(80, 10, 10**6).split()
    fuzzy = [w if k % 11 else "changed" for k, w in enumerate(shared)]
    rows = [(1, words(50, 11, 10**6) + " " + " ".join(shared)), (2, " ".join(shared).upper() + " " + words(40, 12, 10**6)), (3, words(30, 13, 10**6) + " " + " ".join(fuzzy) + " " + words(30, 14, 10**6)),
            (4, words(300, 15, 10**6)), (5, " ".join(shared[:30])), (6, words(50, 11, 10**6) + " " + " ".join(shared)), (7, " ".join(shared[:40] + words(60, 16, 10**6).split() + shared[40:]))]
    got = sorted(tuple(r)[:4] for r in passages.shared_passages(docs(spark, [(*x, None) for x in rows])).collect())
    assert [g[:2] for g in got] == [(2, 1), (3, 1), (6, 1)]
    assert got[0][2:] == (0, 80) and got[2][2:] == (0, 130)
    assert abs(got[1][2] - 30) <= 2 and abs(got[1][3] - 110) <= 4
    assert [(r.doc_id, r.source) for r in passages.shared_passages(edge).collect()] == []
    assert passages.shared_passages(none).count() == 0


def test_passages_of_50_words_are_found(spark):
    rows = []
    for k in range(30):
        p = words(51 + k, 1000 + k, 10**6)
        rows += [(2 * k, f"{words(k * 3, 2000 + k, 10**6)} {p} {words(40, 3000 + k, 10**6)}", None), (2 * k + 1, f"{words(70, 4000 + k, 10**6)} {p}", None)]
    got = {(r.doc_id, r.source) for r in passages.shared_passages(docs(spark, rows)).collect()}
    assert got == {(2 * k + 1, 2 * k) for k in range(30)}


@pytest.mark.parametrize("length, step", [(60, 10), (60, 8), (80, 8)])
def test_fuzzy_passages_are_found(spark, length, step):
    rows = []
    for k in range(40):
        p = words(length, 5000 + k, 10**6).split()
        q = [w if (i + 1) % step else f"c{k}x{i}" for i, w in enumerate(p)]
        rows += [(2 * k, f"{words(30, 6000 + k, 10**6)} {' '.join(p)} {words(30, 7000 + k, 10**6)}", None), (2 * k + 1, f"{words(40, 8000 + k, 10**6)} {' '.join(q)} {words(20, 9000 + k, 10**6)}", None)]
    got = {(r.doc_id, r.source) for r in passages.shared_passages(docs(spark, rows)).collect()}
    assert got == {(2 * k + 1, 2 * k) for k in range(40)}


# ---- tokens


MODEL = pieces.Pieces(pieces.MODEL)
SAMPLES = ["", " ", "  a  b ", "\n\n x", "x\u2581y \u2581", "\ufb01 caf\u00e9 \u0301", "\u65e5\u672c\u8a9e", "\U0001f600 ok", "tab\tnul\x00", "a" * 300, "Hello world, hello worlds.", words(50, 17)]


@pytest.mark.parametrize("rate", [0, 0.1, 0.5, 1])
def test_tokens_decode_to_the_text(rate):
    e = pieces.Encoder(MODEL, rate, 7, 2)
    for s in SAMPLES:
        assert MODEL.decode(e.encode(s, "1")) == s


def test_tokens_without_dropout_are_the_librarys():
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    e = pieces.Encoder(MODEL, 0, 7, 2)
    for s in SAMPLES:
        if "\u2581" not in s:
            assert e.encode(s, "1").tolist() == lib.encode(s)


def test_both_agendas_agree(monkeypatch):
    for below in (0, 2**62):
        for w in words(300, 18).split() + ["antidisestablishmentarianism", "aaaaaaaaaaaaaaa"]:
            short = MODEL.segment(w, 99, below)
            monkeypatch.setattr(pieces, "_SHORT", 0)
            assert MODEL.segment(w, 99, below) == short
            monkeypatch.undo()


def test_tokens_edges(edge, none):
    got = pieces.encode_documents(edge, rate=0.3).collect()
    assert len(got) == len(EDGES) and all(r.lossless for r in got) and {r.doc_id: r.n_tokens for r in got}[1] == 0
    again = {(r.doc_id, r.tokens_sha256) for r in pieces.encode_documents(edge, rate=0.3, ids=False).collect()}
    assert again == {(r.doc_id, r.tokens_sha256) for r in got}
    assert pieces.encode_documents(none).count() == 0


def test_each_occurrence_is_drawn_anew():
    e = pieces.Encoder(MODEL, 0.1, 7, 2)
    word = " internationalization"
    assert len({e.encode(word, str(k)).tobytes() for k in range(300)}) > 4
    same = e.encode(word * 300, "1")
    whole = MODEL.segment(word, 0, 0)
    assert same.tobytes() != whole * 300 and e.encode(word * 300, "1").tolist() == same.tolist()


def test_kept_agendas_give_the_keyed_skips(monkeypatch):
    for cache in (100_000, 20):
        monkeypatch.setattr(pieces, "_CACHE", cache)
        e = pieces.Encoder(MODEL, 0.3, 7, 2)
        ws = pieces._WORDS.findall(" " + words(200, 18) + " antidisestablishmentarianism unbelievable internationalization" * 20)
        got = e.encode("".join(ws)[1:], "5")
        doc = np.uint64(pieces.xxhash.xxh64_intdigest("7 2 5"))
        keys = pieces._mixed(doc ^ pieces._mixed(np.arange(1, len(ws) + 1, dtype=np.uint64) * np.uint64(pieces._B))).tolist()
        assert got.tobytes() == b"".join(MODEL.segment(w, k, e.below) for w, k in zip(ws, keys, strict=True))


# ---- mixing


def test_mixing(spark):
    r = random.Random(19)
    rows = [(k, r.choice(["a", "b", "c", None]), r.choice([0, 1, 5, 50, 700])) for k in range(400)] + [(1, "a", 5), (1, "a", 5), (None, "d", 9), (999, "e", None)]
    got = mixing.mix(spark.createDataFrame(rows, "id long, source string, size long")).collect()
    assert sum(x.n_rows for x in got) == len(rows)
    sizes, taken, target = {}, {}, {}
    for x in got:
        sizes[x.source] = sizes.get(x.source, 0) + x.size * x.n_rows
        taken[x.source] = taken.get(x.source, 0) + x.size * x.n_rows * x.repeats
        target[x.source] = x.target
    assert {x.repeats for x in got} <= {0, 1, 2}
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    want, free = dict.fromkeys(order), set(order)
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in set(order) - free)
        even = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if even[s] >= 2 * sizes[s]}
        if not over:
            break
        free -= over
    want = {s: even[s] if s in free else 2 * sizes[s] for s in order}
    assert target == pytest.approx(want)
    for s in order:
        whole = target[s] // sizes[s] if sizes[s] else 0
        more = [x.size * x.n_rows for x in got if x.source == s and x.size and x.repeats == whole < 2]
        assert 0 <= target[s] - taken[s] < min(more, default=1), s  # no document that is left out still fits


def test_mixing_of_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], "id long, source string, size long")).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, None, 0)], "id long, source string, size long")).collect()
    assert [(x.target, x.repeats) for x in got] == [(0.0, 0)] or got[0].target == 0


def test_words(spark):
    texts = [None, "", " a\tb\x0bc ", "\u00a0x\u2003y", "a\x00b"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(mixing.word_count(F.col("t")).alias("n")).collect()
    assert [x.n for x in got] == [0, 0, 3, 1, 1]


# ---- quality


def test_quality(spark, none):
    r = random.Random(20)
    rows = [(k, words(60, k) if k % 3 else " ".join(w.upper() + "!!" for w in words(60, k).split()), None) for k in range(300)] + [(1000, None, None), (1001, "", None), (None, "word " * 50, None)]
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(300) if r.random() < 0.7] + [(5, None), (None, 1), (5, 1)], "doc_id long, quality int")
    got = {x.doc_id: x.score for x in quality.quality_scores(docs(spark, rows), labels).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    assert sum((got[k] >= 0.3) == (k % 3 > 0) for k in range(300)) >= 297
    assert quality.quality_scores(none, labels).count() == 0
    assert {x.score for x in quality.quality_scores(docs(spark, rows), labels.limit(0)).collect()} == {0.5}


def test_bags_do_not_depend_on_parts(monkeypatch):
    t = words(500, 21) + " b b b"
    whole = quality.bag(t)
    monkeypatch.setattr(quality, "_PART", 1 << 12)
    assert (quality.bag(t)[:4096] == whole[:4096]).all()


# ---- chat


def rewriting(turns):
    """Drops what comes before the last user turn."""
    last = max((k for k, t in enumerate(turns) if t[0] == "user"), default=0)
    return "".join(f"[{r}]{t}" for r, t in turns[last:])


def test_rewriting_templates_are_seen(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c")], "conv_id long, turn long, role string, text string")
    got = chat.format_conversations(rows, rewriting, lambda s: None).orderBy("nth").collect()
    assert [x.rewritten > 0 for x in got] == [False, False, True]
    assert not any(x.rewritten for x in chat.format_conversations(rows).collect())


def test_long_conversations_are_the_whole_rendering(spark):
    turns = [("user" if k % 2 else "assistant", f"t{k} \\ ### </turn> {'x' * k}") for k in range(100)]
    rows = spark.createDataFrame([(1, k, *t) for k, t in enumerate(turns)], "conv_id long, turn long, role string, text string")
    got = chat.format_conversations(rows).orderBy("nth").collect()
    assert "".join(x.span for x in got) == chat.turn_template(turns)
    assert all(chat.unescape("".join(y.span for y in got)[x.loss_start:x.loss_end]) == turns[x.nth][1] for x in got if x.loss_start is not None)
    assert [x.nth for x in got if x.loss_start is not None] == [k for k, t in enumerate(turns) if t[0] == "assistant"]


def test_rewriting_far_back_is_seen(spark):
    def template(turns):
        return "".join(f"[{r}]{'' if k == 0 and len(turns) > 30 else t}" for k, (r, t) in enumerate(turns))

    turns = [("user", f"text {k}") for k in range(40)]
    rows = spark.createDataFrame([(1, k, *t) for k, t in enumerate(turns)], "conv_id long, turn long, role string, text string")
    out = ""
    for x in chat.format_conversations(rows, template, lambda s: None).orderBy("nth").collect():
        assert (x.rewritten > 0) == (x.nth == 30)
        out = out[:x.start] + x.span
    assert out == template(turns)


@pytest.mark.parametrize("text", ["", "\\", "\\\\###", "####", "\\</turn>", "a</turn></turn>", "\n### user: x</turn>\n"])
def test_escapes(text):
    span = chat.turn_template([("r:\\ ###", text)])
    role, a, z = chat.read_turn(span)
    assert (role, chat.unescape(span[a:z])) == ("r:\\ ###", text)
    assert "</turn>" not in span[a:z].replace("\\</turn>", "")


def test_chat_edges(spark):
    rows = spark.createDataFrame([(None, None, None, None), (None, 1, "assistant", "x"), (2, 1, "user", None), (2, 1, "user", None)], "conv_id long, turn long, role string, text string").withColumn("nth", F.lit("clash"))
    got = {x.conv_id: x for x in chat.digest_conversations(chat.format_conversations(rows)).collect()}
    assert got[None].n_turns == 2 and got[2].n_turns == 2 and got[2].loss_chars == 0
    assert got[None].turns_sha256 == hashlib.sha256(b"assistant\nx\n\n\n").hexdigest()
    assert chat.digest_conversations(chat.format_conversations(rows.limit(0))).count() == 0


# ---- URLs


@pytest.mark.parametrize("url, host, path, rule, verdict", [
    ("http://A.Example.COM/en/70?x", "a.example.com", "/en/70", "example.com/en/7", "allow"), ("x://example.com/en/", "example.com", "/en/", "com/en/", "block"), ("https://xcom/en/1", "xcom", "/en/1", None, "allow"),
    ("https://b.net/de/", "b.net", "/de/", "net/de/", "block"), ("https://example.net/de/8#a/b", "example.net", "/de/8", "example.net/de/8", "allow"), ("https://o.org?/es/", "o.org", "", None, "allow"), ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"),
    ("https://\u00c9.org/es/", "\u00c9.org", "/es/", "org/es/", "block"),
])
def test_listed_rules(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url, "h")], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "page_id long, bad boolean")
    assert tuple(urls.judge(pages, labels).select("page_id", "url", "host", "path", "rule", "verdict").first()) == (1, url, host, path, rule, verdict)


def test_mined_rules(spark):
    rows = [(k, f"https://{'casino' if k % 4 == 0 else 'shop'}.example.{'io' if k % 2 else 'dev'}/{'win' if k % 8 < 4 else 'buy'}/{k}?ref=x") for k in range(400)]
    pages = spark.createDataFrame([*rows, (None, None), (3, rows[3][1])], "page_id long, url string")
    bad = {k for k in range(400) if k % 8 == 0}
    labels = spark.createDataFrame([(k, k in bad) for k in range(0, 400, 1) if k % 5] + [(7, None), (None, True)], "page_id long, bad boolean")
    got = {r.page_id: r.verdict for r in urls.judge(pages, labels, confidence=0.9).collect()}
    assert all((got[k] == "block") == (k in bad) for k in range(400)) and got[None] == "allow"
    assert urls.judge(pages.limit(0), labels).count() == 0


def test_one_site_does_not_crowd_out_others(spark):
    rows = [([f"a{i}" for i in range(30)] + ["z"], True)] * 80 + [([f"c{i}" for i in range(20)] + ["z"], k < 30) for k in range(80)]
    rows += [(["x", "y", "z"], k < 50) for k in range(60)] + [(["x", "z"], False)] * 150 + [(["y", "z"], False)] * 150
    got = urls.mine_rules(spark.createDataFrame(rows, "tokens array<string>, bad boolean"))
    assert [r for r, _ in got] == [[f"a{i}"] for i in sorted(range(30), key=str)] + [["x", "y"]]
    assert dict((tuple(r), c) for r, c in got)["x", "y"] == pytest.approx(50 / 60)


def test_rules_need_all_tokens(spark):
    rules = [(["a", "b"], 1.0), (["c"], 1.0)]
    rows = spark.createDataFrame([(["a"], False), (["b", "a"], True), (["c", "x"], True), ([], False)], "t array<string>, want boolean")
    assert all(r.got == r.want for r in rows.withColumn("got", urls.matches(F.col("t"), rules)).collect())


# ---- embeddings


def test_vectors_against_brute_force(spark):
    g = np.random.default_rng(22)
    base = g.standard_normal((400, 16))
    near = np.repeat(base[:30], 6, 0) + 0.02 * g.standard_normal((180, 16))
    dense = base[40] + 0.03 * g.standard_normal((60, 16))
    x = np.concatenate([base, near, dense, base[:5]]).astype(np.float32)
    special = [None, [], [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000 + k, v) for k, v in enumerate(special)] + [(0, x[0].tolist()), (None, x[1].tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("n_links", F.lit("clash"))
    got = embeddings.near_vectors(frame, audit=64).collect()
    assert len(got) == len(rows)
    y = x.astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    y = np.concatenate([y, y[:2]])  # the repeated row and the one without an id
    s = y @ y.T >= 0.9
    np.fill_diagonal(s, False)
    label = np.arange(len(x))
    label = np.r_[label, 0, 1]
    for _ in range(len(y)):
        new = np.minimum(label, np.where(s, label[None, :], len(y)).min(1))
        if (new == label).all():
            break
        label = new
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    for k in range(len(x)):
        assert {(r.n_links, r.component_id, r.kept) for r in by[k]} == {(s[k].sum(), label[k], label[k] == k)}, k
    assert by[None][0].component_id == label[1] and not by[None][0].kept
    assert [by[1000 + k][0].n_links for k in range(7)] == [0, 0, 0, 0, 0, 1, 1] and by[1006][0].component_id == 1005


def test_tight_groups_that_link_across_are_one(spark):
    g = np.random.default_rng(41)
    a, b = np.linalg.qr(g.standard_normal((64, 2)))[0].T
    rows = []
    for centre in (a, 0.93 * a + np.sqrt(1 - 0.93**2) * b):
        rows += [(centre + 0.003 * g.standard_normal(64)).astype(np.float32) for _ in range(80)]
    x = np.array(rows, float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert (x @ x.T >= 0.9).all()
    got = embeddings.near_vectors(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)], "vec_id long, embedding array<float>")).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(159, 0)}
    exact = embeddings.near_vectors(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)], "vec_id long, embedding array<float>"), rounds=0).collect()
    assert {(r.n_links, r.component_id) for r in exact} == {(159, 0)}


def test_vectors_of_nothing(spark):
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# ---- digests


def test_canonical_forms(spark):
    pairs = [("\ufb01x", "FIX"), ("Stra\u00dfe", "STRASSE"), ("e\u0301 a", "\u00c9\u00a0\n a"), (" a ", "a"), (None, ""), ("\u2460", "1")]
    for a, b in pairs:
        r = spark.createDataFrame([(a, b)], "a string, b string").select(digest.canonical(F.col("a")).alias("a"), digest.canonical(F.col("b")).alias("b")).first()
        assert r.a == r.b, (a, b)


def test_clashing_buckets_are_told_apart(spark, edge, none):
    frame = docs(spark, [(k, f"text {k % 60}", None) for k in range(180)])
    got = digest.fingerprint_documents(frame, bits=3).collect()
    assert len({r.fingerprint for r in got}) == 60 and len({(r.fingerprint, r.text) for r in got}) == 60
    by = {r.doc_id: r.fingerprint for r in digest.fingerprint_documents(edge).collect()}
    assert by[1] == by[2] == by[3] and by[4] == by[5] != by[6]
    assert digest.fingerprint_documents(none).count() == 0


def test_next_documents(spark, edge, none):
    r = random.Random(23)
    rows = [(k * k, f"t{k}") for k in range(300)]
    r.shuffle(rows)
    got = {x.doc_id: x.next_text for x in digest.with_next(docs(spark, [(*x, None) for x in rows])).collect()}
    assert got == {k * k: f"t{(k + 1) % 300}" for k in range(300)}
    assert digest.with_next(edge).count() == len(EDGES) and digest.with_next(none).count() == 0
    assert [x.next_text for x in digest.with_next(docs(spark, [(1, "only", None)])).collect()] == ["only"]




def test_no_machine_local_folder_on_a_cluster():
    class Unset:
        """A session on a cluster without a checkpoint folder."""

        master = "spark://host:7077"

        def __getattr__(self, _):
            return self

        def __call__(self, *_):
            return self

        def get(self, *_):
            return None

        def isDefined(self):  # noqa: N802
            return False

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_dir(Unset())
