"""Methods against naive versions of themselves: prefixes of chats, skipped merges, thresholds of rules."""

import random

import pytest

from longwatch.llm import chat, pieces, urls


def plain_spans(render, turns):
    out, last = [], render([])
    for k in range(1, len(turns) + 1):
        now = render(turns[:k])
        same = 0
        while same < min(len(last), len(now)) and last[same] == now[same]:
            same += 1
        out.append((now[same:], len(last) - same))
        last = now
    return out


def appends(turns):
    return "<s>" + "".join(f"[{r}|{t}]" for r, t in turns)


def numbers_all(turns):
    return f"{len(turns)} turns: " + "".join(t for _, t in turns)


def looks_back(turns):
    return "".join(f"{t}({turns[k - 20][1]})" if k >= 20 else t for k, (_, t) in enumerate(turns))


def marks_first(turns):
    return "".join(f"{t}!" if k == 0 and len(turns) > 23 else t for k, (_, t) in enumerate(turns))


@pytest.mark.parametrize("render", [appends, numbers_all, looks_back, marks_first])
@pytest.mark.parametrize("n", [0, 1, 4, 5, 6, 17, 22, 24, 40, 64])
def test_windows_give_what_whole_prefixes_give(render, n):
    turns = [("ab"[k % 2], f"text {k * 7919 % 101}") for k in range(n)]
    want = plain_spans(render, turns)
    assert chat.conversation_spans(render, turns) == want
    assert chat.conversation_spans(render, turns, window=4) == want


def test_windows_stay_cheap_for_a_template_that_appends():
    seen = []

    def render(turns):
        seen.append(len(turns))
        return appends(turns)

    chat.conversation_spans(render, [("u", str(k)) for k in range(1000)], window=16)
    assert sum(seen) < 1000 * 18 + 4 * 1000


def test_rewrites_are_told_of_a_long_conversation(spark):
    rows = [(1, k, "user", f"t{k}") for k in range(40)] + [(2, k, "user", f"t{k}") for k in range(10)]
    got = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), template=marks_first, reader=lambda s: None, window=4).collect()
    assert {(r.conv_id, r.nth): r.rewritten for r in got if r.rewritten} == {(1, 23): sum(len(f"t{k}") for k in range(1, 23))}


def naive_segment(model, word, key, below):
    """One pair at a time: the best candidate of all neighbours is joined, or dropped for good if its hash is below."""
    at = list(range(len(word)))
    symbols = [pieces._SPACE if c == " " else c for c in word]
    dropped = set()
    while True:
        open_ = []
        for k in range(len(symbols) - 1):
            joined = symbols[k] + symbols[k + 1]
            if joined in model.score and (at[k], at[k + 1], joined) not in dropped:
                open_.append((model.score[joined], k, joined))
        if not open_:
            return model.ids(symbols)
        _, k, joined = min(open_)
        name = (at[k] * pieces._A + model.id[joined] * pieces._B + at[k + 1] * pieces._C) % 2**64
        if pieces._mixed(key ^ name) < below:
            dropped.add((at[k], at[k + 1], joined))
        else:
            symbols[k:k + 2] = [joined]
            del at[k + 1]


def test_skipped_merges_against_a_naive_agenda():
    model = pieces.Pieces(pieces.MODEL)
    r = random.Random(3)
    words = [" " + "".join(r.choice("aeinrstlhou") for _ in range(r.randrange(1, 30))) for _ in range(150)] + [" " + "an" * 40, " the", "  a", "x", " " + "été" * 9]
    for w in words:
        for rate in (0.0, 0.2, 0.7):
            key, below = r.getrandbits(64), int(rate * 2**64)
            assert model.segment(w, key, below) == naive_segment(model, w, key, below), (w, rate)


def test_documents_against_a_naive_agenda(spark):
    texts = ["The thatin other nation", "aa aaa aaaa aaa", "", "one  two\nthree\tfour " * 3]
    got = {x.doc_id: x for x in pieces.encode_documents(spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")).collect()}
    model, below = pieces.Pieces(pieces.MODEL), int(pieces.RATE * 2**64)
    for i, t in enumerate(texts):
        doc = pieces.xxhash.xxh64_intdigest(f"{pieces.SEED} 0 {i}")
        words = pieces._WORDS.findall(" " + t) if t else []
        ids = b"".join(naive_segment(model, w, int(pieces._mixed(doc ^ pieces._mixed((k + 1) * pieces._B % 2**64))), below) for k, w in enumerate(words))
        assert list(got[i].tokens) == list(memoryview(ids).cast("H"))


def test_fewest_examples_are_a_parameter(spark):
    rows = [(["a"], True)] * 6 + [(["b"], False)] * 30
    df = spark.createDataFrame(rows, "tokens array<string>, bad boolean")
    assert urls.mine_rules(df) == [] and urls.mine_rules(df, fewest=6) == [(["a"], 1.0)] and urls.mine_rules(df, fewest=7) == []


def test_pages_with_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://x.com/en/1", "r", "m", "h", "v"), (None, None, None, None, None, None), (1, "http://x.com/en/1", "r", "m", "h", "v")], "page_id long, url string, _rule string, _method string, host string, verdict string")
    labels = spark.createDataFrame([(1, True), (1, None), (None, True)], "page_id long, bad boolean")
    got = urls.judge(pages, labels).collect()
    assert sorted((r.page_id or 0, r.host, r.verdict, r._rule) for r in got) == [(0, "", "allow", None), (1, "x.com", "block", "r"), (1, "x.com", "block", "r")]
