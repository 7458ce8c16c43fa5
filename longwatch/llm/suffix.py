"""Suffix-array dedup of byte strings, exact, over all documents.

Every 50-byte window of a text belongs to the run of neighbouring windows that
share one minimizer (the least hashed 16-byte gram in the window), and equal
windows share it. So only runs whose minimizer occurs in two documents can hold
repeats, and their bytes are sorted shard by shard, by minimizer: for the runs
of a shard a column-wise construction inserts one symbol of every run each
round, from the last to the first, and updates the collection's
Burrows-Wheeler transform and its common prefixes. These are sequential
arrays that each round reads and writes from end to end; as runs are at most 84
bytes, a shard takes at most 84 rounds and its arrays fit in a task, so they
are not put on an executor's disk. A stretch of common prefixes of 50 or more
is a set of equal windows, and its least document id decides which of them are
repeats.

The shuffles carry packed blocks, not single runs, and each is combined first:
whole equal texts are one text, a batch names each minimizer once, and of equal
runs in a batch only that of the least document is sent. So a passage that a
third of all documents share is a few rows for each batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longwatch.llm.blocks import BATCH, ROWS, SHARDS, block_rows, by_id, by_shard, by_value, by_value_rows, dealt, first_texts, found_for, grouped_texts, join_blocks, pack, per_document, shard_of, unpack
from longwatch.llm.common import lean, read, shuffle_width

LENGTH = 50
_GRAM = 16
_ODD = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)
#: Bytes hashed at a time, so that long texts take bounded memory.
_PART = 1 << 20
#: In the transform: no symbol precedes, or it is not inserted yet. Never a byte of UTF-8.
_NONE = 255
_CHECK = 32


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Tables:
    """Powers for rolling hashes, made once in each Python worker."""

    up = down = None

    @classmethod
    def get(cls):
        if cls.up is None:
            n = _PART + 256
            cls.up, cls.down = _powers(_ODD, n), _powers(pow(_ODD, -1, 1 << 64), n)
        return cls.up, cls.down


def gram_hashes(data: np.ndarray, m: int) -> np.ndarray:
    """A 64-bit hash of each m bytes of a byte array (at most _PART + 256 long)."""
    up, down = _Tables.get()
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    h = (total[m:] - total[:-m]) * down[:n - m + 1]
    h ^= h >> np.uint64(29)
    h *= _MIX
    h ^= h >> np.uint64(32)
    return h


def window_minima(x: np.ndarray, w: int) -> np.ndarray:
    k = 1
    while k * 2 <= w:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[:k - w], x[w - k:]) if w > k else x


def runs(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, first window, windows) of each run of windows; at most length - 15 windows each."""
    w = length - _GRAM + 1
    out = []
    whole = np.frombuffer(data, np.uint8)
    for at in range(0, len(data) - length + 1, _PART):
        part = whole[at:at + _PART + length - 1]
        h = window_minima(gram_hashes(part, _GRAM), w)
        begin = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        size = np.diff(np.r_[begin, len(h)])
        if (size > w).any():
            pieces = -(-size // w)
            of = np.repeat(np.arange(len(size)), pieces)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begin, size = begin[of] + nth * w, np.minimum(size[of] - nth * w, w)
        out.append((h[begin], begin + at, size))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _announce(length: int, shards: int):
    """First pass: each batch names its minimizers, once each, to their shards.

    Below shards: (minimizer, id, nth, known) blocks, one row for each
    minimizer of the batch. From shards on: minimizers of one document that
    occur in two documents of this batch.
    """

    def run(batches):
        for ids, nths, data, _ in grouped_texts(batches, BATCH):
            parts = [runs(x, length)[0] for x in data]
            h = np.concatenate(parts)
            if not len(h):
                continue
            doc = np.repeat(np.arange(len(ids)), [len(p) for p in parts])
            order, begin = by_value(h)
            size = np.diff(np.r_[begin, len(order)])
            of = doc[order]
            shared = of[begin] != of[begin + size - 1]
            out = []
            fresh = np.r_[True, of[1:] != of[:-1]]
            fresh[begin] = True
            rows = order[np.repeat(shared, size) & fresh]
            for k, x in by_value_rows(doc[rows], rows):
                out.append((shards + int(ids[k]) % shards, int(ids[k]), int(nths[k]), pack(_high(h[x]))))
            first, known = order[begin], shared
            near = np.argsort(first, kind="stable")  # by document, so that a block's ids and zeros compress
            first, known = first[near], known[near]
            for s, x in by_value_rows(shard_of(h[first], shards), np.arange(len(first))):
                r = first[x]
                out.append((int(s), 0, 0, pack(_high(h[r]), _low(h[r]), ids[doc[r]], nths[doc[r]], known[x])))
            yield block_rows(out)

    return run


def _high(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(32)).astype(np.uint32)


def _low(h: np.ndarray) -> np.ndarray:
    """With the high half, 48 bits of a minimizer: where these meet by chance, a run is looked at in vain."""
    return (h >> np.uint64(16) & np.uint64(0xFFFF)).astype(np.uint16)


def _shared(blocks: list[bytes]) -> pa.RecordBatch:
    """Minimizers, by document, that occur in two documents."""
    high, low, ids, nths, known = join_blocks(blocks, np.uint32, np.uint16, np.int64, np.int32, bool)
    order, begin = by_value(high.astype(np.uint64) << np.uint64(16) | low)
    size = np.diff(np.r_[begin, len(order)])
    i, n = ids[order], nths[order]
    differ = (np.minimum.reduceat(i, begin) != np.maximum.reduceat(i, begin)) | (np.minimum.reduceat(n, begin) != np.maximum.reduceat(n, begin))
    rows = order[np.repeat(differ, size) & ~known[order]]
    return per_document(ids[rows], nths[rows], high[rows])


def _matrix(data: bytes, begin: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """The bytes of each run, right-aligned and zero-filled: one row each."""
    whole = np.frombuffer(data, np.uint8)
    at = (begin + size)[:, None] - width + np.arange(width)[None, :]
    return np.where(at >= begin[:, None], whole[np.maximum(at, 0)], 0).astype(np.uint8)


def _distinct(row: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row of each distinct run, number of the run that each row holds)."""
    keyed = np.ascontiguousarray(np.concatenate([row, size[:, None].astype(np.uint8)], 1))
    keyed = np.pad(keyed, ((0, 0), (0, -keyed.shape[1] % 8))).view(np.uint64)
    mixed = np.zeros(len(keyed), np.uint64)
    for c in range(keyed.shape[1]):
        mixed = (mixed ^ keyed[:, c]) * _MIX
        mixed ^= mixed >> np.uint64(31)
    order = np.lexsort((np.arange(len(mixed)), mixed))
    same = (keyed[order[1:]] == keyed[order[:-1]]).all(1) if len(order) else np.zeros(0, bool)
    # equal bytes have equal mixes, but not the reverse: where mixes meet without equal bytes, sort by the bytes
    if ((mixed[order[1:]] == mixed[order[:-1]]) & ~same).any():
        order = np.lexsort((np.arange(len(mixed)), *keyed.T))
        same = (keyed[order[1:]] == keyed[order[:-1]]).all(1)
    start = np.r_[True, ~same]
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(start) - 1
    return order[start], of


def _cut_runs(length: int, shards: int):
    """Second pass: the bytes of the flagged runs to their minimizers' shards.

    Below shards: (id, nth, first window, size) and bytes, for the least
    document of each distinct run of the batch. From shards on: (first window,
    windows) of the runs that repeat one of a lesser document in the batch.
    """
    width = 2 * length - _GRAM

    def run(batches):
        for ids, nths, data, flags in grouped_texts(batches, BATCH):
            parts = []
            for k, found in enumerate(flags):
                if found:
                    h, begin, windows = runs(data[k], length)
                    pick = np.flatnonzero(np.isin(_high(h), np.concatenate([unpack(f, np.uint32)[0] for f in found])))
                    size = windows[pick] + length - 1
                    parts.append((h[pick], np.full(len(pick), k), begin[pick], size, _matrix(data[k], begin[pick], size, width)))
            if not parts:
                continue
            h, doc, begin, size, row = (np.concatenate(x) for x in zip(*parts, strict=True))
            first, of = _distinct(row, size)
            least = doc[first][of]
            later = ids[doc] > ids[least]
            out = []
            for k, x in by_value_rows(doc[later], np.flatnonzero(later)):
                out.append((shards + int(ids[k]) % shards, int(ids[k]), int(nths[k]), pack(begin[x], size[x] - length + 1)))
            own = np.flatnonzero(~later)
            for s, x in by_value_rows(shard_of(h[own], shards), own):
                out.append((int(s), 0, 0, pack(ids[doc[x]], nths[doc[x]], begin[x], size[x].astype(np.uint8), row[x])))
            yield block_rows(out)

    return run


def bwt_windows(text: np.ndarray, size: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Column-wise construction over many strings at once.

    text: one right-aligned row of bytes (none of them 255) for each string;
    size: its symbols. Round j inserts the suffix of length j of every string
    that has one: the count of its first symbol in the transform above the
    suffix inserted last gives its place. Returns, for all suffixes in order,
    (string, suffix length, whether the common prefix with the one before
    reaches length).
    """
    n, width = text.shape
    flat = np.concatenate([text.ravel(), np.zeros(length, np.uint8)])
    windows = np.ndarray((n * width,), f"V{length}", flat, strides=(1,))  # the bytes from each place on
    tag = np.arange(n, dtype=np.int64) << 8  # string and suffix length
    bwt = np.full(n, _NONE, np.uint8)
    near = np.zeros(n, bool)
    place = np.arange(n)
    heads = np.zeros(257, np.int64)  # suffixes by first symbol
    for j in range(1, int(size.max(initial=0)) + 1):
        live = np.flatnonzero(size >= j)
        symbol = text[live, width - j].astype(np.int64)
        at = place[live]
        total = len(bwt)
        order = np.argsort(bwt, kind="stable")
        begin = np.searchsorted(bwt[order], np.arange(257))
        keys = bwt[order].astype(np.int64) * (total + 1) + order
        above = np.searchsorted(keys, symbol * (total + 1) + at) - begin[symbol]
        to = n + (np.cumsum(heads) - heads)[symbol] + above
        by = np.lexsort((at, symbol))
        live, symbol, at, to = live[by], symbol[by], at[by], to[by]
        bwt[at] = symbol
        heads += np.bincount(symbol, minlength=257)
        new = to + np.arange(len(live))
        old = np.ones(total + len(live), bool)
        old[new] = False
        tag, bwt, near = (_merged(x, old, new, v) for x, v in ((tag, (live << 8) | j), (bwt, _NONE), (near, False)))
        place[live] = new
        if j >= length:
            own = windows[(tag[new] >> 8) * width + width - j]
            for beside, target in ((new - 1, new), (new + 1, new + 1)):
                ok = beside < len(tag)
                t = tag[np.where(ok, beside, 0)]
                ok &= (t & 255) >= length
                k = np.flatnonzero(ok)
                near[target[k]] = windows[(t[k] >> 8) * width + width - (t[k] & 255)] == own[k]
                lost = target[~ok & (target < len(near))]
                near[lost] = False
    return tag >> 8, tag & 255, near


def _merged(x: np.ndarray, old: np.ndarray, new: np.ndarray, values) -> np.ndarray:
    out = np.empty(len(old), x.dtype)
    out[old] = x
    out[new] = values
    return out


def _promising(row: np.ndarray, size: np.ndarray, length: int) -> np.ndarray:
    """Strings with a window all of whose 32-byte grams other strings have too; a string with an equal window is one."""
    if length < _CHECK:
        return np.ones(len(row), bool)
    width = row.shape[1]
    up, down = _Tables.get()
    total = np.zeros((len(row), width + 1), np.uint64)
    np.cumsum((row.astype(np.uint64) + np.uint64(1)) * up[:width], axis=1, out=total[:, 1:])
    h = (total[:, _CHECK:] - total[:, :-_CHECK]) * down[:width - _CHECK + 1]
    h *= _MIX
    h ^= h >> np.uint64(32)
    real = np.arange(h.shape[1])[None, :] >= (width - size)[:, None]
    of = np.repeat(np.arange(len(row)), real.sum(1))
    order, begin = by_value(h[real])
    if not len(order):
        return np.zeros(len(row), bool)
    low, high = np.minimum.reduceat(of[order], begin), np.maximum.reduceat(of[order], begin)
    shared = np.empty(len(order), bool)
    shared[order] = np.repeat(low != high, np.diff(np.r_[begin, len(order)]))
    full = np.zeros(h.shape, bool)
    full[real] = shared
    run = np.cumsum(full, axis=1)
    need = length - _CHECK + 1
    run = np.concatenate([np.zeros((len(row), 1), run.dtype), run], axis=1)
    return ((run[:, need:] - run[:, :-need]) == need).any(1)


def _repeats(length: int):
    """For each document of a shard, (first window, windows) that also start in a lesser document."""
    width = 2 * length - _GRAM

    def work(blocks: list[bytes]) -> pa.RecordBatch:
        kinds = (np.int64, np.int32, np.int64, np.uint8, np.dtype((np.uint8, width)))
        ids, nths, begin, size, row = join_blocks(blocks, *kinds)
        size = size.astype(np.int64)
        first, of = _distinct(row, size)
        least = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(least, of, ids)
        text, held = row[first], size[first]
        reach = np.repeat(least[:, None], width - length + 1, 1)  # least id of each window, by string
        some = np.flatnonzero(_promising(text, held, length))
        if len(some):
            string, tail, near = bwt_windows(text[some], held[some], length)
            full = np.flatnonzero(tail >= length)
            string, tail, near = some[string[full]], tail[full], near[full]
            start = np.flatnonzero(~near)
            best = np.minimum.reduceat(least[string], start)
            reach[string, held[string] - tail] = np.repeat(best, np.diff(np.r_[start, len(full)]))
        covered = (reach[of] < ids[:, None]) & (np.arange(width - length + 1)[None, :] <= (size - length)[:, None])
        edges = np.diff(np.pad(covered, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        a, b = np.nonzero(edges == 1), np.nonzero(edges == -1)
        rows = a[0]
        return per_document(ids[rows], nths[rows], begin[rows] + a[1], b[1] - a[1])

    return work


def removed_runs(n: int, found: list[bytes] | None, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the maximal runs of bytes under the found windows."""
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, count = join_blocks(found, np.int64, np.int64)
    edge = np.zeros(n + 2, np.int32)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + count + length - 1, -1)
    step = np.diff(np.r_[0, (np.cumsum(edge) > 0)[:n].astype(np.int8), 0])
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _finish(length: int, characters: bool):
    def run(batches):
        for b in batches:
            starts, ends, kept, sizes = [], [], [], []
            for x, state, found in zip(b.column(2), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                x = x.as_py() or b""
                if state["whole"] and len(x) >= length:
                    s, e = np.array([0]), np.array([len(x)])
                else:
                    s, e = removed_runs(len(x), [] if state["whole"] else found_for(found, state["nth"]), length)
                sizes.append(len(x))
                starts.append(s.tolist())
                ends.append(e.tolist())
                left = b"".join(x[i:j] for i, j in zip([0, *e], [*s, len(x)], strict=True)) if len(s) else x
                kept.append(left.decode("utf-8", "ignore").encode() if characters and len(s) else left)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(1), pa.array(sizes, pa.int64()), pa.array(starts, longs), pa.array(ends, longs), pa.array(kept, pa.binary())],
                names=["_row", "n_bytes", "starts", "ends", "kept"],
            )

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, characters: bool = False) -> DataFrame:
    """The given rows with n_bytes, starts and ends (runs of bytes removed) and kept (the other bytes) for the text.

    A byte goes if a string of length bytes over it also starts in a document
    with a lesser id. Null and empty texts lose nothing, nor do texts shorter
    than length. Rows of equal id are never repeats of each other; a null id is
    below all others. With characters, kept loses what is left of characters
    that lost some of their bytes. The other columns pass through, but for any
    named like the new ones.
    """
    if length < 2 * _GRAM or 2 * length - _GRAM > 254:
        raise ValueError(f"length must be from {2 * _GRAM} to {(254 + _GRAM) // 2}")
    shards = shuffle_width(docs.sparkSession) * SHARDS
    other = [c for c in docs.columns if c not in (text_col, "n_bytes", "starts", "ends", "kept")]
    base = first_texts(docs, id_col, text_col, other)
    lone = base.where(~F.col("_state.whole"))
    named = lone.mapInArrow(lean(_announce(length, shards)), ROWS)
    flags = dealt(named).mapInArrow(lean(by_shard(_shared, shards)), ROWS)
    picked = lone.join(by_id(flags).hint("shuffle_hash"), "_id").select("_id", "_row", "_data", "_state", "_found")
    sent = picked.mapInArrow(lean(_cut_runs(length, shards)), ROWS)
    found = dealt(sent).mapInArrow(lean(by_shard(_repeats(length), shards)), ROWS)
    done = base.join(by_id(found).hint("shuffle_hash"), "_id", "left").select("_id", "_row", "_data", "_state", "_found")
    longs = T.ArrayType(T.LongType())
    new = [("n_bytes", T.LongType()), ("starts", longs), ("ends", longs), ("kept", T.BinaryType())]
    schema = T.StructType([done.schema["_row"], *[T.StructField(name, kind) for name, kind in new]])
    out = done.mapInArrow(lean(_finish(length, characters)), schema)
    return out.select(*[F.col("_row")[c].alias(c) for c in other], "n_bytes", "starts", "ends", "kept")


def op8_suffix_array_dedup(spark, sf_dir) -> DataFrame:
    """What every document loses to earlier ones, in bytes."""
    rows = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate(F.zip_with("starts", "ends", lambda s, e: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
