"""Phrases of adjacent words, mined over vertical lists of positions.

Texts are put into blocks of one language and a bounded size; a block holds,
for each of its words, the ascending list of the word's positions, numbered so
that the words of a piece follow each other and those of two pieces do not. A
list's length is the exact frequency in the block. To sum them, a block sends
each shard the names and lengths of its lists, in one packed row; the shard
answers which of them are frequent over all blocks, again in one row. Frequent
phrases of k words become phrases of k + 1 by a merge of two lists: the
positions of a phrase with those of what is adjacent one place further, which
is a word where k is 1 and else a frequent phrase, as a phrase whose last k
words are not frequent is not frequent either. Each round sends a phrase once
for each block, never an occurrence, and only lists of phrases that are
frequent so far are kept.

Phrases have numbers, not hashes: a shard counts its own. So nothing is counted
under another phrase's name.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longwatch.llm.blocks import by_value
from longwatch.llm.common import cut, lean, read, shuffle_width

#: Fixed values of the registered query.
LEAST, LONGEST, FIRST, SCALE, SHARE = 100, 5, 2000, 1000, 100
#: Bytes of text in a block; one piece of a text is not divided.
BLOCK = 1 << 23
#: A block's number is that of its task and, in so many bits, its own in the task.
_NTH = 24
#: Words for each shard, where that gives no fewer shards than shuffle partitions and not over so many times as many.
_SHARD_WORDS, _MOST_SHARDS = 1 << 20, 8
#: A phrase's number is that of its shard and, in so many bits, its own in the shard.
_RANK = 32
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_ENDS = b".,;:!?\n\x0b\x0c\r"
#: Every byte as it is in a key: ends of pieces are newlines, tabs are spaces, A to Z are in lower case.
_TABLE = bytes.maketrans(_ENDS + b"\t", b"\n" * len(_ENDS) + b" ").translate(bytes(range(256)).lower())
_SEPARATE = np.isin(np.arange(256), [10, 32])
_LAST_END = re.compile(rb"[.,;:!?\x0a-\x0d](?=[^.,;:!?\x0a-\x0d]*\Z)")


def words_of(data: bytes) -> tuple[pa.Array, np.ndarray]:
    """(words, their positions): those of a piece have positions in a row, and there is a gap between pieces."""
    x = np.frombuffer(data.translate(_TABLE), np.uint8)
    gap = _SEPARATE[x]
    inside = x[~gap]
    edge = np.diff(np.r_[True, gap, True].astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    offsets = np.r_[0, np.cumsum(end - start)].astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(inside)])
    breaks = np.flatnonzero(x == 10)
    return words, np.arange(len(start)) + np.searchsorted(breaks, start)


def _lists(number: np.ndarray, at: np.ndarray, lists: int) -> tuple[np.ndarray, np.ndarray]:
    """(lengths of the lists, all lists behind each other) from the number of each position's list."""
    return np.bincount(number, minlength=lists), at[np.argsort(number, kind="stable")]


def merged(first: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Adjacent pairs of lists, all at once: (numbers of the first, of the second, lengths, lists behind each other).

    first: ascending positions of all lists together, number: the list that
    each is of. Position p of a list meets p + 1 of another.
    """
    at = np.searchsorted(first, first + 1)
    at[at == len(first)] = 0
    meets = first[at] == first + 1 if len(first) else np.zeros(0, bool)
    a, b, p = number[meets].astype(np.int64), number[at[meets]].astype(np.int64), first[meets]
    width = int(number.max()) + 1 if len(number) else 1
    order, begin = by_value(a * width + b)
    return a[order[begin]], b[order[begin]], np.diff(np.r_[begin, len(order)]), p[order]


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers as compressed bytes: differences first, as all but few of them are small."""
    head, body = [len(columns)], []
    for c in columns:
        d = np.diff(np.asarray(c, np.int64), prepend=0)
        low = int(d.min()) if len(d) else 0
        kind = np.min_scalar_type((int(d.max()) if len(d) else 0) - low)
        head += [len(d), low, kind.itemsize]
        body.append((d - low).astype(kind).tobytes())
    raw = np.array(head, "<i8").tobytes() + b"".join(body)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    head = np.frombuffer(raw, "<i8", 3 * n, 8).reshape(n, 3)
    at, out = 8 + 24 * n, []
    for length, low, width in head:
        out.append(np.cumsum(np.frombuffer(raw, f"<u{width}", length, at).astype(np.int64) + low))
        at += int(length * width)
    return out


#: Rows of blocks: the block's own state has shard -1, what it sends to a shard that shard's number.
_ROWS = "block long, shard int, lang string, n long, data binary, lists binary"
_NAMES = ["block", "shard", "lang", "n", "data", "lists"]
_KINDS = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.binary()]
#: Answers of shards; those for block -1 are the shard's frequent phrases.
_ANSWERS = "block long, shard int, data binary"


def _batch(rows: list[tuple], names=_NAMES, kinds=_KINDS) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _texts(words: pa.Array) -> bytes:
    """Binary words as compressed bytes."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("w", words.type)]), options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(pa.RecordBatch.from_arrays([words], names=["w"]))
    return sink.getvalue().to_pybytes()


def _read_texts(data: bytes) -> pa.Array:
    return pa.ipc.open_stream(data).read_all().column(0).combine_chunks()


def _both(first: bytes, second: bytes) -> bytes:
    return len(first).to_bytes(8, "little") + first + second


def _parts(data: bytes) -> tuple[bytes, bytes]:
    n = 8 + int.from_bytes(data[:8], "little")
    return data[8:n], data[n:]


def _by_shard(shard: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order that puts lists of a shard together, each list's new place, lists of each shard)."""
    order = np.argsort(shard, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return order, place, np.bincount(shard, minlength=shards)


def blocks_of(docs: DataFrame, text_col: str, lang_col: str, size: int, shards: int) -> DataFrame:
    """Blocks of word lists. Blocks have numbers of their own and hold one language each; they send shards their words."""

    def run(batches):
        task, made, held = TaskContext.get().partitionId(), 0, {}

        def done(lang):
            nonlocal made
            words, at = words_of(b"\n".join(held.pop(lang)[0]))
            found = words.dictionary_encode()
            names = found.dictionary.cast(pa.binary())
            shard = np.array([xxhash.xxh64_intdigest(w) % shards for w in names.to_pylist()], np.int64)
            order, place, sizes = _by_shard(shard, shards)
            n, lists = _lists(place[found.indices.to_numpy(zero_copy_only=False)], at, len(names))
            names = names.take(pa.array(order))
            block, made = task << _NTH | made, made + 1
            rows = [(block, -1, lang, len(at), _packed(n, sizes), _packed(lists))]
            for k, lo in zip(np.flatnonzero(sizes), np.cumsum(sizes)[sizes > 0] - sizes[sizes > 0], strict=True):
                rows.append((block, int(k), lang, None, _both(_texts(names.slice(lo, sizes[k])), _packed(n[lo:lo + sizes[k]])), None))
            return _batch(rows)

        for batch in batches:
            for lang, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = data.as_py() or b""
                while data:
                    part = data
                    if len(data) > size:  # a long text is divided at the last end of a piece that fits, else at the next
                        end = _LAST_END.search(data[:size])
                        end = end.start() + 1 if end else next((i + 1 for i in range(size, len(data)) if data[i] in _ENDS), len(data))
                        part = data[:end]
                    data = data[len(part):]
                    mine = held.setdefault(lang, [[], 0])
                    mine[0].append(part)
                    mine[1] += len(part) + 1
                    if mine[1] >= size:
                        yield done(lang)
                    elif sum(h[1] for h in held.values()) >= 2 * size:
                        yield done(max(held, key=lambda k: held[k][1]))
        for lang in list(held):
            yield done(lang)

    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")), F.col(text_col).cast("binary"))
    return rows.mapInArrow(lean(run), _ROWS)


def frequent(a: np.ndarray, b: np.ndarray, n: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sums of n by (a, b): (rows of pairs with a sum of at least `least`, the number of each one's pair, a row of each pair, its sum)."""
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    starts = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if len(order) else np.zeros(0, np.int64)
    sums = np.add.reduceat(n[order], starts) if len(order) else np.zeros(0, np.int64)
    good = sums >= least
    number = np.repeat(np.where(good, np.cumsum(good) - 1, -1), np.diff(np.r_[starts, len(order)]))
    rows = order[number >= 0]
    back = np.argsort(rows)
    return rows[back], number[number >= 0][back], order[starts[good]], sums[good]


def _answered(blocks: DataFrame, least: int, words: bool) -> DataFrame:
    """What shards answer: to each block the places of its frequent lists and their phrases' numbers; and the phrases themselves."""

    def run(batches):
        now, held = None, []

        def done():
            ids = [h[0] for h in held]
            if words:
                parts = [_parts(h[2]) for h in held]
                texts = [_read_texts(x) for x, _ in parts]
                names = pa.concat_arrays(texts)
                b = names.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
                langs = pa.array([h[1] for h in held], pa.string()).dictionary_encode()
                a = np.repeat(langs.indices.to_numpy(zero_copy_only=False).astype(np.int64), [len(t) for t in texts])
                n = [_unpacked(y)[0] for _, y in parts]
            else:
                a, b, n = zip(*(_unpacked(h[2]) for h in held), strict=True)
                a, b = np.concatenate(a), np.concatenate(b)
            edges = np.r_[0, np.cumsum([len(x) for x in n])]
            rows, number, one, f = frequent(a, b, np.concatenate(n), least)
            if not len(rows):
                return None
            number = number + (now << _RANK)
            cuts = np.searchsorted(rows, edges)
            out = [(ids[k], now, _packed(rows[lo:hi] - edges[k], number[lo:hi])) for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if hi > lo]
            mine = np.arange(len(one)) + (now << _RANK)
            told = _both(_both(_texts(names.take(pa.array(one))), _texts(langs.dictionary.take(pa.array(a[one])).cast(pa.binary()))), _packed(mine, f)) if words else _packed(mine, f, a[one], b[one])
            return _batch([*out, (-1, now, told)], ["block", "shard", "data"], [pa.int64(), pa.int32(), pa.binary()])

        for batch in batches:
            for shard, block, lang, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != now and held:
                    if (found := done()) is not None:
                        yield found
                    held = []
                now = shard
                held.append((block, lang, data))
        if held and (found := done()) is not None:
            yield found

    rows = blocks.where("shard >= 0").select("shard", "block", "lang", "data").repartition("shard").sortWithinPartitions("shard", "block")
    return cut(rows.mapInArrow(lean(run), _ANSWERS))


def _phrases(answers: DataFrame, words: bool) -> DataFrame:
    """(id, f, lang, word) or (id, f, a, b): the phrases that shards found frequent."""

    def run(batches):
        for batch in batches:
            for x in batch.column(0):
                data = x.as_py()
                if words:
                    texts, rest = _parts(data)
                    names, langs = map(_read_texts, _parts(texts))
                    ids, f = _unpacked(rest)
                    cols, keys = (ids, f, langs.cast(pa.string()), names), ("lang", "word")
                else:
                    cols, keys = _unpacked(data), ("a", "b")
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in cols], names=["id", "f", *keys])

    return answers.where("block < 0").select("data").mapInArrow(lean(run), "id long, f long, " + ("lang string, word binary" if words else "a long, b long"))


def _next(blocks: DataFrame, answers: DataFrame, shards: int) -> DataFrame:
    """Blocks of the next round: each one's lists of frequent phrases merged with each other."""

    def run(batches):
        now, state, told = None, None, []

        def done():
            lists, (n, sizes) = _unpacked(state[1])[0], _unpacked(state[0])
            first = np.cumsum(sizes) - sizes
            of = np.full(len(n), -1, np.int64)
            ids, at = [], 0
            for shard, data in told:
                place, number = _unpacked(data)
                of[first[shard] + place] = at + np.arange(len(place))
                ids.append(number)
                at += len(place)
            ids = np.concatenate(ids)
            which = np.repeat(of, n)
            lists, which = lists[which >= 0], which[which >= 0]
            order = np.argsort(lists)
            a, b, n, lists = merged(lists[order], which[order])
            with np.errstate(over="ignore"):
                key = (ids[a].view(np.uint64) * _A) ^ (ids[b].view(np.uint64) * _B)
                shard = ((key ^ (key >> np.uint64(29))) * _B >> np.uint64(33)).astype(np.int64) % shards
            order, place, sizes = _by_shard(shard, shards)
            n, lists = _lists(np.repeat(place, n), lists, len(n))
            a, b = ids[a[order]], ids[b[order]]
            rows = [(now, -1, None, None, _packed(n, sizes), _packed(lists))]
            for k, lo in zip(np.flatnonzero(sizes), np.cumsum(sizes)[sizes > 0] - sizes[sizes > 0], strict=True):
                hi = lo + sizes[k]
                rows.append((now, int(k), None, None, _packed(a[lo:hi], b[lo:hi], n[lo:hi]), None))
            return _batch(rows)

        for batch in batches:
            for block, shard, data, lists in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != now:
                    if told:
                        yield done()
                    now, state, told = block, (data, lists), []
                else:
                    told.append((shard, data))
        if told:
            yield done()

    rows = blocks.where("shard < 0").select("block", "shard", "data", "lists").union(answers.where("block >= 0").select("block", "shard", "data", F.lit(None).cast("binary")))
    return cut(rows.repartition("block").sortWithinPartitions("block", "shard").mapInArrow(lean(run), _ROWS))


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): all phrases of up to `longest` words that occur at least `least` times in a language, and n words of each lang.

    phrases: (id, lang, k, words, f, heads, tails, first, rest): ids are unlike
    among phrases of k words, words is an array, f the frequency, heads and tails those of its first 1, 2, ... k - 1
    and of its last k - 1, ... 1 words; first and rest are the ids of the phrases
    without its last and without its first word (null for one word).
    """
    width = shuffle_width(docs.sparkSession)
    blocks = cut(blocks_of(docs, text_col, lang_col, block, width))
    totals = blocks.where("shard < 0").groupBy("lang").agg(F.sum("n").alias("n"))
    words = blocks.where("shard < 0").agg(F.sum("n")).first()[0] or 0
    shards = min(max(width, -(-words // _SHARD_WORDS)), _MOST_SHARDS * width)
    answers = _answered(blocks, least, True)
    none = F.array().cast("array<long>")
    level = _phrases(answers, True).select("id", "lang", F.lit(1).alias("k"), F.array(F.col("word").cast("string")).alias("words"), "f", none.alias("heads"), none.alias("tails"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("rest"))
    found = level
    for k in range(2, longest + 1):
        blocks = _next(blocks, answers, shards)
        answers = _answered(blocks, least, False)
        first = level.select(F.col("id").alias("a"), "lang", F.col("words").alias("w"), F.col("f").alias("fa"), "heads")
        rest = level.select(F.col("id").alias("b"), F.element_at("words", -1).alias("end"), F.col("f").alias("fb"), "tails")
        joined = _phrases(answers, False).join(first, "a").join(rest, "b")
        level = cut(
            joined.select(
                "id", "lang", F.lit(k).alias("k"), F.concat("w", F.array("end")).alias("words"), "f", F.concat("heads", F.array("fa")).alias("heads"),
                F.concat(F.array("fb"), "tails").alias("tails"), F.col("a").alias("first"), F.col("b").alias("rest"),
            )
        )
        found = found.union(level)
    return found, totals


def cut_score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(SCALE * a * n / (left * right)), exact where products pass 64 bits."""
    wide = lambda c: c.cast("decimal(18,0)")
    top = F.lit(SCALE).cast("decimal(4,0)") * wide(a) * n.cast("decimal(16,0)")
    return F.call_function("div", top, wide(left) * wide(right))


def collocations(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, first: int = FIRST, share: int = SHARE, text_col: str = "text", lang_col: str = "lang", block: int = BLOCK,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to `longest` words.

    Words are maximal runs without spaces and tabs inside pieces, which end at
    . , ; : ! ? and at line ends (line feed to carriage return); A to Z are in
    lower case. A phrase that occurs a times, at least `least`, is as good as its
    worst cut into l and r occurrences of its parts (the first of equal ones);
    it is dropped if a longer one with at least share percent of its
    occurrences holds it. Ties go by a, then by the phrase's bytes. Null texts
    are empty, a null lang is und, rows are documents each for itself.
    """
    phrases, totals = frequent_phrases(docs, least, longest, text_col, lang_col, block)
    held = phrases.where("k > 2").select(F.explode(F.array("first", "rest")).alias("id"), (F.col("k") - 1).alias("k"), "f").groupBy("id", "k").agg(F.max("f").alias("within"))
    rows = phrases.where("k > 1").join(held, ["id", "k"], "left").where(F.coalesce(F.col("within") * 100 < F.col("f") * share, F.lit(True)))
    rows = rows.join(totals, "lang").select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), "n", F.arrays_zip(F.col("heads").alias("l"), F.col("tails").alias("r")).alias("cuts"))
    scored = F.transform("cuts", lambda c, i: F.struct(cut_score(F.col("a"), F.col("n"), c["l"], c["r"]).alias("score"), i.alias("i"), c["l"].alias("l"), c["r"].alias("r")))
    rows = rows.select("lang", "phrase", "a", "n", F.array_min(scored).alias("_")).select("lang", "phrase", "a", "n", "_.l", "_.r", "_.score")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    best = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrase_collocations(spark, sf_dir) -> DataFrame:
    """The first 2000 phrases of each language of documents."""
    return collocations(read(spark, sf_dir, "documents").select("text", "lang"))


OP11_SQL = r"""
WITH RECURSIVE pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
         regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p
  FROM documents
), piece AS (
  SELECT lang, regexp_extract_all(unnest(p), '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, k, list_slice(w, i, i + k - 1) AS g
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM piece, range(1, 6) t(k))
), f AS (
  SELECT lang, k, g, count(*) AS a FROM grams GROUP BY ALL
), total AS (
  SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT * FROM f WHERE k > 1 AND a >= 100
), inside AS (
  SELECT lang, list_slice(g, i, i + j - 1) AS g, max(a) AS most
  FROM (SELECT lang, g, a, k, j, unnest(range(1, k - j + 2)) AS i FROM c, range(2, 5) t(j) WHERE j < k) GROUP BY ALL
), left_over AS (
  SELECT c.* FROM c LEFT JOIN inside i ON i.lang = c.lang AND i.g = c.g WHERE i.most IS NULL OR 100 * i.most < 100 * c.a
), cuts AS (
  SELECT o.lang, o.g, o.a, x.a AS l, y.a AS r, t.n, o.j, (1000::HUGEINT * o.a * t.n) // (x.a::HUGEINT * y.a) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM left_over) o
  JOIN f x ON x.lang = o.lang AND x.g = list_slice(o.g, 1, o.j)
  JOIN f y ON y.lang = o.lang AND y.g = list_slice(o.g, o.j + 1, o.k)
  JOIN total t ON t.lang = o.lang
), worst AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1
), ranked AS (
  SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score::BIGINT AS score FROM worst
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase COLLATE "binary") AS rank, phrase, a, l, r, n, score
FROM ranked QUALIFY rank <= 2000
"""
