"""Brute force and edge cases for line removal, the prefix trie and phrase collocations."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from longwatch.llm import lines, phrases, trie
from tests.llm.test_small import EDGES, docs, words

# ---- lines


def keys(n, seed):
    r = np.random.default_rng(seed)
    return r.integers(0, 2**64, n, np.uint64), r.integers(0, 2**64, n, np.uint64)


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50000])
def test_perfect_hash_is_minimal_and_perfect(n):
    a, b = keys(n, 1)
    a[: n // 3] = a[0] if n else 0  # equal first halves
    slots = lines.PerfectHash.of(a, b).slots(a, b)
    assert sorted(slots) == list(range(n))


def test_shard_knows_its_lines_and_no_other():
    a, b = keys(5000, 2)
    n = np.arange(5000) + 2
    shard = lines.Shard.load(lines.Shard.of(a, b, n, 10).dump())
    assert (shard.counts_of(a, b) == np.minimum(n, 10)).all() and shard.counts.dtype == np.uint8
    x, y = keys(20000, 3)
    assert not shard.counts_of(x, y).any()
    assert not shard.counts_of(a, b + np.uint64(1)).any()
    many = lines.Shard.load(lines.Shard.of(a, b, n, 1000).dump())
    assert many.counts.dtype == np.uint16 and (many.counts_of(a, b) == np.minimum(n, 1000)).all()


def plain_lines(texts, documents, least):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
    each = [(t or "").split("\n") for t in texts]
    have = collections.Counter(k for ls in each for k in {key(x) for x in ls} if len(k) >= least)
    out = []
    for ls in each:
        left = [x for x in ls if have[key(x)] < documents]
        out.append(("\n".join(left), len(ls), len(ls) - len(left)))
    return out


@pytest.mark.parametrize(("broadcast", "shard"), [(lines.BROADCAST, lines.SHARD), (0, 7), (0, lines.SHARD), (lines.BROADCAST, 7)])
@pytest.mark.parametrize(("documents", "least"), [(2, 1), (5, 3)])
def test_lines_against_brute_force(spark, monkeypatch, broadcast, shard, documents, least):
    monkeypatch.setattr(lines, "_BATCH", 2000)
    r = random.Random(7)
    pool = [words(r.randrange(1, 5), k) for k in range(60)] + ["", " ", "Äb", "äb", "ab", " AB\t", "x" * 9000]
    texts = ["\n".join(r.choice(pool[: r.choice([3, 20, 67])]) + r.choice(["", " ", "\r"]) for _ in range(r.randrange(0, 9))) for _ in range(150)]
    texts += [texts[0]] * 40 + [None, "", "\n", "\n\n", "  \n", "one line\nand a last"]
    rows = [(i, t, None) for i, t in enumerate(texts)]
    got = {x.doc_id: (x.kept, x.n_lines, x.n_dropped) for x in lines.drop_lines(docs(spark, rows), documents=documents, least=least, broadcast=broadcast, shard=shard).collect()}
    assert got == dict(enumerate(plain_lines(texts, documents, least)))


@pytest.mark.parametrize("broadcast", [lines.BROADCAST, 0])
def test_lines_edges(spark, broadcast):
    got = lines.drop_lines(docs(spark, EDGES), documents=2, broadcast=broadcast)
    assert got.columns == ["doc_id", "text", "lang", "source", "fp", "score", "_row", "kept", "n_lines", "n_dropped"]
    rows = got.collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in rows) == sorted((i or 0, t or "") for i, t, _ in EDGES)
    for r in rows:  # "one" is the line of three rows, two of them equal
        assert (r.kept, r.n_dropped) == (("", 1) if r.text == "one" else (r.text or "", 0)) and r.n_lines == (r.text or "").count("\n") + 1
    assert lines.drop_lines(docs(spark, []), broadcast=broadcast).count() == 0
    with pytest.raises(ValueError, match="two documents"):
        lines.drop_lines(docs(spark, []), documents=1)


def test_no_shared_line_leaves_all(spark):
    rows = [(i, f"line {i}\nother {i}", None) for i in range(20)]
    assert all(r.kept == r.text for r in lines.drop_lines(docs(spark, rows)).collect())


# ---- trie


def conversations(spark, rows):
    return spark.createDataFrame([(c, t, r, x, 5, "n", "p") for c, t, r, x in rows], "conv_id long, turn long, role string, text string, depth int, node string, path string")


def plain_turns(rows):
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            by[c].append((t is not None, t or 0, r, hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).digest(), x))
    return {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in by.items()}


def plain_rebuilt(turns):
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = turns.get(base, [])[:h] + own[h:]
    return out


def plain_trie(turns):
    members = collections.defaultdict(list)
    for c, t in turns.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    nodes = set(members)
    children = collections.Counter(k[:-1] for k in nodes if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k in nodes:
        for d in range(len(k) + 1):
            leaves[k[:d]] += children[k] == 0
            saved[k[:d]] += (len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0
    out = set()
    for k in nodes:
        ends = ",".join(str(c) for c in sorted(c for c in members[k] if len(turns[c]) == len(k)))
        parent = min(members[k[:-1]]) if k else None
        out.add((min(members[k]), len(k), parent, len(members[k]), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def some_conversations(seed):
    r = random.Random(seed)
    rows = []
    for c in [*range(-12, 40), 1000, 1003, 2**40]:
        for t in range(r.choice([1, 2, 3, 5, 12])):
            rows.append((c, t, r.choice(["user", "assistant", None]), r.choice(["hi", "hä", "", None, "x y"])))
    rows += [(c, t, "user", "same") for c in range(50, 75) for t in range(3)]  # many copies
    rows += [(c, None, "user", "first") for c in range(80, 84)] + [(c, 0, "a", x) for c in range(80, 84) for x in ("tie b", "tie a", "tie b")]
    rows += [(None, 0, "user", "nobody's"), (90, 1, "user", "z" * 70000), (91, 1, "user", "z" * 70000)]
    rows += [(95, t, "user", str(t % 2)) for t in range(300)] + [(96, t, "user", str(t % 2)) for t in range(299)]
    r.shuffle(rows)
    return rows


FIELDS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("hot", [trie._HOT, 4])
def test_trie_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(trie, "_HOT", hot)
    monkeypatch.setattr(trie, "_CHUNK", 10)
    rows = some_conversations(1)
    got = trie.prefix_trie(conversations(spark, rows)).collect()
    want = plain_trie(plain_turns(rows))
    assert len(got) == len(want) and {tuple(r[f] for f in FIELDS) for r in got} == want


def test_rebuilt_trie_against_brute_force(spark):
    rows = some_conversations(2)
    rows = [r for r in rows if r[0] is None or r[0] % 10]  # so that some bases are absent
    built = plain_rebuilt(plain_turns(rows))
    assert any(not t for t in built.values())  # some have no turn left
    got = trie.trie(trie.rebuilt(trie.turn_rows(conversations(spark, rows)))).collect()
    want = plain_trie(built)
    assert len(got) == len(want) and {tuple(r[f] for f in FIELDS) for r in got} == want


def test_trie_of_one_path_and_of_nothing(spark):
    got = trie.prefix_trie(conversations(spark, [(7, k, "user", "ab") for k in range(40)])).orderBy("depth").collect()
    assert [(r.conv_id, r.depth, r.n_convs, r.n_leaves, r.saved_tokens) for r in got] == [(7, d, 1, 1, 0) for d in range(41)]
    assert trie.prefix_trie(conversations(spark, [])).count() == 0


def test_trie_with_many_levels_of_light_edges(spark):
    rows = [(c, d, "user", f"{c >> (9 - d) & 1}") for c in range(1024) for d in range(10)]  # a full binary tree
    got = trie.prefix_trie(conversations(spark, rows)).collect()
    assert len(got) == 2047 and all(r.n_leaves == r.n_convs == 2 ** (10 - r.depth) for r in got)
    assert next(r.saved_tokens for r in got if r.depth == 0) == sum(1024 - 2**d for d in range(1, 11))


# ---- phrases


def plain_phrases(rows, least, longest, first, share=100):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    good = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    inside = collections.Counter()
    for (lang, g), a in good.items():
        for k in range(2, len(g)):
            for i in range(len(g) - k + 1):
                inside[lang, g[i:i + k]] = max(inside[lang, g[i:i + k]], a)
    out = []
    for (lang, g), a in good.items():
        if 100 * inside[lang, g] >= share * a:
            continue
        score, _, l, r = min((1000 * a * n[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g)))
        out.append((lang, score, a, " ".join(g), l, r, n[lang]))
    ranked = []
    for lang in {x[0] for x in out}:
        mine = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[1], -x[2], x[3].encode()))
        ranked += [(lang, k, p, a, l, r, m, s) for k, (_, s, a, p, l, r, m) in enumerate(mine[:first], 1)]
    return set(ranked)


@pytest.mark.parametrize(("block", "shard"), [(phrases.BLOCK, phrases._SHARD_WORDS), (90, 100)])
@pytest.mark.parametrize(("least", "longest", "first", "share"), [(3, 5, 2000, 100), (2, 4, 10, 60), (4, 2, 2000, 100)])
def test_collocations_against_brute_force(spark, monkeypatch, block, shard, least, longest, first, share):
    monkeypatch.setattr(phrases, "_SHARD_WORDS", shard)
    r = random.Random(5)
    vocabulary = ["a", "B", "b", "É", "é", "the", "of", "x y", "\x00", "\x1c", "w-1"]
    rows = [(r.choice(["en", "de", None]), "".join(r.choice(vocabulary) + r.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "\r\n", ",", "\x0b"]) for _ in range(r.randrange(0, 60)))) for _ in range(80)]
    rows += [("en", "the end of all. the end of all, the end of all")] * 5 + [("fr", None), (None, ""), ("en", " . , \n"), ("en", words(3000, 1, 40))]
    df = spark.createDataFrame([(i, t, lang, "w", 7) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, word string, n int").repartition(3)
    got = phrases.collocations(df, least, longest, first, share, block=block)
    assert {tuple(x[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for x in got.collect()} == plain_phrases(rows, least, longest, first, share)
    assert all(kind == "bigint" for name, kind in got.dtypes if name not in ("lang", "phrase"))


def test_collocations_of_nothing(spark):
    assert phrases.collocations(docs(spark, [])).count() == 0
    assert phrases.collocations(docs(spark, [(1, None, None), (2, "one", None), (2, "one", None)]), least=1).count() == 0


def test_score_is_exact_beyond_64_bits(spark):
    cases = [(10**12 + 7, 16 * 10**12 + 3, 10**12 + 9, 10**12 + 11), (100, 10**13, 100, 100), (3 * 10**9, 10**13 + 1, 7 * 10**11 + 3, 3 * 10**9)]
    got = spark.createDataFrame([(k, *x) for k, x in enumerate(cases)], "k int, a long, n long, l long, r long").select("k", phrases.cut_score(*(phrases.F.col(c) for c in "anlr")).alias("s")).collect()
    assert {x.k: x.s for x in got} == {k: 1000 * a * n // (l * r) for k, (a, n, l, r) in enumerate(cases)}


def test_lists_are_exact():
    data = ("Ab ab, aB ab\tab\n" * 50).encode()
    found, at = phrases.words_of(data)
    assert set(found.to_pylist()) == {b"ab"} and len(set(at.tolist())) == len(found) == 250
    a, b, count, lists = phrases.merged(at, np.zeros(250, np.int64))
    assert (a.tolist(), b.tolist(), count.tolist()) == ([0], [0], [150]) and len(lists) == 150
    x = [np.array([5, -3, 2**40, 0]), np.zeros(0, np.int64), np.arange(100000) % 7]
    assert all((p == q).all() and len(p) == len(q) for p, q in zip(x, phrases._unpacked(phrases._packed(*x)), strict=True))
