"""Removal of lines that many documents share, by sharded minimal perfect hashes.

Documents are counted for each distinct line by a 128-bit hash of the line's
key. The hashes of lines that two documents or more have are dealt into shards
of a bounded size; each shard gets a minimal perfect hash (levels of bits, as
in cascaded collision-free hashing) that gives every line a slot of a compact
fingerprint array and of a count array. Documents probe these arrays: no line
is joined with another, and no text is shuffled as long as all arrays together
have a bounded size, which is measured; then they are broadcast. Beyond that
size batches of documents send each shard one block of hashes and get back
those that go, by the text's own hash.

A slot holds 64 bits beside those that chose it, so a line that is not in the
index is taken for one that is with a chance of 2**-64, and two lines count as
one with a chance of 2**-128.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longwatch.llm.blocks import by_value_rows, join_blocks, pack
from longwatch.llm.common import cut, lean, read

#: A line of so many documents goes, if its key has so many code points.
DOCUMENTS, CODE_POINTS = 10, 1
#: Bytes of all arrays up to which they are broadcast.
BROADCAST = 64 << 20
#: Lines of a shard, on average.
SHARD = 1 << 20
_SPACE = b" \t\n\x0b\x0c\r"
#: Bytes of text whose line hashes are put together before they are sent.
_BATCH = 1 << 24
#: Bits of a level for each line that is left: fewer bits need more levels.
_LOAD = 1.5
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def line_key(line: bytes) -> bytes:
    """White space at both ends off, A to Z in lower case."""
    return line.strip(_SPACE).lower()


def line_hashes(lines: list[bytes], least: int) -> np.ndarray:
    """(2, n) of 64 bits: the hashes of the lines' keys; (0, 0) for a key of too few code points."""
    keys = [line_key(x) for x in lines]
    there = [len(k) >= least and (least <= 1 or len(k.decode("utf-8", "replace")) >= least) for k in keys]
    found = np.frombuffer(b"".join(xxhash.xxh3_128_digest(k) if t else bytes(16) for k, t in zip(keys, there, strict=True)), "<u8")
    return found.reshape(-1, 2).T


def _mixed(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (a ^ (b << np.uint64(1))) + np.uint64(2 * level + 1) * _A + (b >> np.uint64(63))
        x = (x ^ (x >> np.uint64(30))) * _B
        x ^= b
        x = (x ^ (x >> np.uint64(27))) * _A
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of distinct 128-bit keys: level after level, a key takes a bit that no other key left asks for."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.start = np.r_[0, np.cumsum(sizes)].astype(np.int64)
        self.rank = np.r_[0, np.cumsum(np.bitwise_count(bits))].astype(np.int64)

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        sizes, words, level = [], [], 0
        while len(a):
            m = max(64, -(-int(len(a) * _LOAD) // 64) * 64)
            at = (_mixed(a, b, level) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m)[at] == 1
            bits = np.zeros(m, np.uint8)
            bits[at[alone]] = 1
            sizes.append(m)
            words.append(np.packbits(bits, bitorder="little").view("<u8"))
            a, b, level = a[~alone], b[~alone], level + 1
        return cls(np.array(sizes, np.int64), np.concatenate(words) if words else np.zeros(0, "<u8"))

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Each key's slot: unlike ones below the number of keys for the keys that it was built of, any or -1 for others."""
        out = np.full(len(a), -1, np.int64)
        left = np.arange(len(a))
        for level, m in enumerate(self.sizes):
            at = (_mixed(a[left], b[left], level) % np.uint64(m)).astype(np.int64) + self.start[level]
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            here = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word[here] & ((np.uint64(1) << bit[here]) - np.uint64(1)))
            out[left[here]] = self.rank[at[here] >> 6] + below
            left = left[~here]
            if not len(left):
                break
        return out


class Shard:
    """Fingerprints and counts of a shard's lines, by the slots of its perfect hash. Counts above most are stored as most."""

    def __init__(self, hash_: PerfectHash, prints: np.ndarray, counts: np.ndarray):
        self.hash, self.prints, self.counts = hash_, prints, counts

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray, n: np.ndarray, most: int) -> Shard:
        hash_ = PerfectHash.of(a, b)
        at = hash_.slots(a, b)
        prints, counts = np.empty(len(a), "<u8"), np.empty(len(a), np.min_scalar_type(most))
        prints[at], counts[at] = b, np.minimum(n, most)
        return cls(hash_, prints, counts)

    def counts_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many documents have each line: 0 for one that is not in the index."""
        out = np.zeros(len(a), np.int64)
        if len(self.prints):
            at = self.hash.slots(a, b)
            same = (at >= 0) & (self.prints[at] == b)
            out[same] = self.counts[at[same]]
        return out

    def dump(self) -> bytes:
        head = np.array([len(self.hash.sizes), len(self.hash.bits), len(self.prints), self.counts.itemsize], "<i8")
        return pack(head, self.hash.sizes.astype("<i8"), self.hash.bits, self.prints, self.counts)

    @classmethod
    def load(cls, data: bytes) -> Shard:
        levels, words, n, width = np.frombuffer(data, "<i8", 4)
        at, parts = 32, []
        for kind, count in (("<i8", levels), ("<u8", words), ("<u8", n), (f"<u{width}", n)):
            parts.append(np.frombuffer(data, kind, count, at))
            at += parts[-1].nbytes
        return cls(PerfectHash(parts[0], parts[1]), parts[2], parts[3])


def _shard_of(a: np.ndarray, shards: int) -> np.ndarray:
    return ((a >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def _columns(names: list[str], kinds: list, values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names)


def line_counts(docs: DataFrame, text_col: str = "text", least: int = CODE_POINTS) -> DataFrame:
    """(a, b, n): how many rows have each distinct line, by its hash; batches count their own lines first."""

    def run(batches):
        held, size = [], 0

        def done():
            both = np.concatenate(held)
            found, n = np.unique(both, return_counts=True)
            words = np.frombuffer(found.tobytes(), "<i8").reshape(-1, 2)
            return _columns(["a", "b", "n"], [pa.int64()] * 3, (words[:, 0], words[:, 1], n.astype(np.int64)))

        for batch in batches:
            for x in batch.column(0):
                data = x.as_py() or b""
                a, b = line_hashes(data.split(b"\n"), least)
                there = np.unique(np.ascontiguousarray(np.stack([a, b], 1)[(a != 0) | (b != 0)]).view("V16").ravel())
                held.append(there)
                size += len(data) + 64
                if size >= _BATCH:
                    yield done()
                    held, size = [], 0
        if held:
            yield done()

    return docs.select(F.col(text_col).cast("binary")).mapInArrow(lean(run), "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def line_index(counts: DataFrame, most: int, shard: int = SHARD) -> tuple[DataFrame, int]:
    """((shard, data), number of shards): a Shard for each part of the lines of two documents or more."""
    counts = cut(counts.where("n > 1"))
    shards = max(1, -(-counts.count() // shard))

    def run(batches):
        now, held = None, []

        def done():
            a, b, n = (np.concatenate(c) for c in zip(*held, strict=True))
            return _columns(["shard", "data"], [pa.int64(), pa.binary()], ([now], [Shard.of(a.view("<u8"), b.view("<u8"), n, most).dump()]))

        for batch in batches:
            s, *rest = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for value, at in by_value_rows(s, np.arange(len(s))):
                if value != now and held:
                    yield done()
                    held = []
                now = int(value)
                held.append([c[at] for c in rest])
        if held:
            yield done()

    where = F.pmod(F.shiftrightunsigned("a", 32), F.lit(shards))
    rows = counts.select(where.alias("shard"), "a", "b", "n").repartition("shard").sortWithinPartitions("shard", "a", "b")
    return cut(rows.mapInArrow(lean(run), "shard long, data binary")), shards


def _kept(schema: T.StructType) -> T.StructType:
    more = [T.StructField("_kept", T.BinaryType()), T.StructField("_n", T.LongType()), T.StructField("_gone", T.LongType())]
    return T.StructType([schema["_row"], *more])


def _without(data: bytes, gone_of) -> tuple[bytes, int, int]:
    """(what stays, lines before, lines dropped); gone_of says for the hashes of lines which go."""
    lines = data.split(b"\n")
    gone = gone_of(lines)
    n = int(gone.sum())
    return (data if not n else b"\n".join([x for x, g in zip(lines, gone, strict=True) if not g])), len(lines), n


def _probed(rows: DataFrame, index: DataFrame, shards: int, documents: int, least: int) -> DataFrame:
    """Rows without the lines that go, by arrays that are sent to every task."""
    sent = rows.sparkSession.sparkContext.broadcast({r.shard: r.data for r in index.collect()})  # at most the bytes that were checked

    def run(batches):
        loaded = {s: Shard.load(d) for s, d in sent.value.items()}
        for batch in batches:
            texts = [x.as_py() or b"" for x in batch.column(1)]
            each = [x.split(b"\n") for x in texts]
            a, b = line_hashes([x for lines in each for x in lines], least)
            count = np.zeros(len(a), np.int64)
            for s, at in by_value_rows(_shard_of(a, shards), np.arange(len(a))):
                if int(s) in loaded:
                    count[at] = loaded[int(s)].counts_of(a[at], b[at])
            gone, at, out = (count >= documents) & ((a != 0) | (b != 0)), 0, []
            for data, lines in zip(texts, each, strict=True):
                out.append(_without(data, lambda _, g=gone[at:at + len(lines)]: g))
                at += len(lines)
            kept, n, dropped = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), pa.array(n, pa.int64()), pa.array(dropped, pa.int64())], names=["_row", "_kept", "_n", "_gone"])

    return rows.mapInArrow(lean(run), _kept(rows.schema))


def _asked(rows: DataFrame, index: DataFrame, shards: int, documents: int, least: int) -> DataFrame:
    """Rows without the lines that go, where the arrays are too large to be sent: shards answer blocks of hashes by text."""
    rows = rows.select("_row", "_data", F.xxhash64("_data").alias("_t"), F.xxhash64(F.lit("longwatch"), "_data").alias("_u"))
    names, kinds = ["shard", "first", "data"], [pa.int64(), pa.bool_(), pa.binary()]

    def asks(batches):
        held, size, seen = [], 0, set()

        def done():
            t, u, a, b = (np.concatenate(c) for c in zip(*held, strict=True))
            found = [(int(s), False, pack(t[at], u[at], a[at], b[at])) for s, at in by_value_rows(_shard_of(a, shards), np.arange(len(a)))]
            return _columns(names, kinds, zip(*found, strict=True))

        for batch in batches:
            for x, t, u in zip(batch.column(0), *(c.to_pylist() for c in batch.columns[1:]), strict=True):
                data = x.as_py() or b""
                size += len(data) + 64
                if (t, u) not in seen:
                    seen.add((t, u))
                    a, b = line_hashes(data.split(b"\n"), least)
                    there = np.unique(np.stack([a, b], 1)[(a != 0) | (b != 0)], axis=0)
                    if len(there):
                        held.append((np.full(len(there), t, "<i8"), np.full(len(there), u, "<i8"), there[:, 0], there[:, 1]))
                if size >= _BATCH:
                    if held:
                        yield done()
                    held, size, seen = [], 0, set()
        if held:
            yield done()

    def answers(batches):
        now, shard = None, None
        for batch in batches:
            out = []
            for s, first, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if first:
                    now, shard = s, Shard.load(data)
                elif s == now:
                    t, u, a, b = join_blocks([data], "<i8", "<i8", "<u8", "<u8")
                    goes = shard.counts_of(a, b) >= documents
                    t, u, a, b = t[goes], u[goes], a[goes], b[goes]
                    order = np.lexsort((u, t))
                    for at in np.split(order, np.flatnonzero((np.diff(t[order]) != 0) | (np.diff(u[order]) != 0)) + 1):
                        if len(at):
                            out.append((int(t[at[0]]), int(u[at[0]]), s, pack(np.stack([a[at], b[at]], 1))))
            if out:
                yield _columns(["t", "u", "shard", "gone"], [pa.int64()] * 3 + [pa.binary()], zip(*out, strict=True))

    asked = rows.select("_data", "_t", "_u").mapInArrow(lean(asks), "shard long, first boolean, data binary")
    meet = index.select("shard", F.lit(True).alias("first"), "data").union(asked).repartition("shard").sortWithinPartitions("shard", F.col("first").desc())
    found = meet.mapInArrow(lean(answers), "t long, u long, shard long, gone binary")
    found = found.groupBy("t", "u", "shard").agg(F.first("gone").alias("gone"))  # copies of a text get one answer of a shard
    found = found.groupBy(F.col("t").alias("_t"), F.col("u").alias("_u")).agg(F.collect_list("gone").alias("_found"))
    rows = rows.join(found, ["_t", "_u"], "left").select("_row", "_data", "_found")

    def run(batches):
        for batch in batches:
            out = []
            for x, f in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                goes = {k[i:i + 16] for k in f or [] for i in range(0, len(k), 16)}
                out.append(_without(x.as_py() or b"", lambda lines, goes=goes: np.array([h.tobytes() in goes for h in np.ascontiguousarray(line_hashes(lines, least).T)]) if goes else np.zeros(1, bool)))
            kept, n, dropped = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), pa.array(n, pa.int64()), pa.array(dropped, pa.int64())], names=["_row", "_kept", "_n", "_gone"])

    return rows.mapInArrow(lean(run), _kept(rows.schema))


def drop_lines(docs: DataFrame, text_col: str = "text", documents: int = DOCUMENTS, least: int = CODE_POINTS, broadcast: int = BROADCAST, shard: int = SHARD) -> DataFrame:
    """The given rows with kept, n_lines and n_dropped: the text without the lines that many rows have.

    A line's key is the line without white space at its ends and with A to Z in
    lower case. Keys of at least `least` code points (1 or more: empty lines
    always stay) that at least `documents` rows (2 or more) have lose all their
    lines in every row; each row counts once for a key, repeated rows each for
    themselves. Other lines stay as they are, joined by newlines. A null text is
    an empty text, which is one empty line. Columns named kept, n_lines and
    n_dropped are replaced.
    """
    if documents < 2 or least < 1:
        raise ValueError("a line goes for two documents and one code point at least")
    index, shards = line_index(line_counts(docs, text_col, least), documents, shard)
    size = index.agg(F.sum(F.length("data"))).first()[0] or 0
    other = [c for c in docs.columns if c not in ("kept", "n_lines", "n_dropped")]
    rows = docs.select(F.struct(*[docs[c] for c in other]).alias("_row"), docs[text_col].cast("binary").alias("_data"))
    done = (_probed if size <= broadcast else _asked)(rows, index, shards, documents, least)
    return done.select(*[F.col("_row")[c].alias(c) for c in other], F.col("_kept").cast("string").alias("kept"), F.col("_n").alias("n_lines"), F.col("_gone").alias("n_dropped"))


def op12_line_dedup(spark, sf_dir) -> DataFrame:
    """Every document without the lines that ten documents or more have."""
    done = drop_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS nth FROM documents
), k AS (
  SELECT doc_id, nth, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), often AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(o.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (WHERE o.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN often o ON o.key = k.key GROUP BY doc_id
"""
