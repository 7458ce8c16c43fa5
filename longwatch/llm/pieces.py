"""SentencePiece encoding and decoding with seeded merge-dropout.

A merge-type (BPE) model joins neighbouring symbols, the best-scored piece
first and the leftmost of equals. With dropout, each candidate that comes off
the agenda is skipped if a keyed hash of it falls below the rate; the key holds
the seed, the document, the word's place in it and the candidate, so that reruns
agree while each occurrence of a word is drawn anew. Characters without a piece
become byte pieces. A piece never reaches over a space that follows another
character, nor over a line end, so words are segmented one by one.

Agendas run over many words at a time, as arrays with one row for each word: a
round takes the best candidate of every row, skips or joins it, and looks up
the pairs that this makes. The candidates and ids of a word without any skip
are kept in a bounded cache. For each occurrence all kept candidates are hashed
under its own key; only where one of them is to be skipped does the agenda run
again, for that occurrence, skip by skip.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from longwatch.llm.common import lean, read, texts

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
RATE = 0.1
SEED = 7
#: Words whose agendas a Python worker keeps; then it starts afresh.
_CACHE = 250_000
#: Symbols of a word at most that agendas run over as arrays, and their widths.
_SHORT = 48
_WIDTHS = (4, 6, 8, 10, 12, 16, 24, _SHORT)
#: Words that are worked on at a time, and texts.
_CHUNK = 200_000
_TEXTS = 256
#: A symbol that is no piece: so much and its code point.
_OTHER = 1 << 17
_GONE = 0xFFFFFFFF
_LAST = np.iinfo(np.int32).max
_NEVER = float("inf")
_A, _B, _C, _M, _64 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 2**64 - 1
_SPACE = "\u2581"
#: Stands for a U+2581 of the text itself; no piece holds it.
_LITERAL = "\ufffe\ufffe"
_WORDS = re.compile(r" *[^ \n]+|\n| +")


def _mixed(x):
    """64 bits that hang on all bits of x: a number, or an array of them."""
    if isinstance(x, int):
        x = (x ^ x >> 32) * _M & _64
        x = (x ^ x >> 29) * _A & _64
        return x ^ x >> 32
    x = (x ^ x >> np.uint64(32)) * np.uint64(_M)
    x = (x ^ x >> np.uint64(29)) * np.uint64(_A)
    return x ^ x >> np.uint64(32)


class Pieces:
    """The pieces of a merge-type model: what can merge, and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.bytes: list[bytes] = []
        self.byte_id = [0] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[1:-1], 16)] = i
                self.bytes.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes.append(b"")
            else:
                self.score[piece], self.id[piece] = -model.get_score(i), i
                self.bytes.append(piece.replace(_SPACE, " ").encode())
                if _SPACE in piece.lstrip(_SPACE) or "\n" in piece:
                    raise ValueError("a piece of this model reaches over a word's start")
        if len(self.bytes) >= 1 << 16:
            raise ValueError("ids must fit in 16 bits")
        self._tabulate()

    def _tabulate(self):
        """Symbols of code points, and what each pair of symbols joins to, in an open hash table."""
        chars = sorted({c for piece in self.id for c in piece} - self.id.keys())
        symbol = self.id | {c: len(self.bytes) + i for i, c in enumerate(chars)}
        self.none = len(self.bytes) + len(chars)  # a symbol that joins with nothing, and the id of no pair
        if self.none >= 1 << 16:
            raise ValueError("symbols must fit in 16 bits")
        self.symbol_of = np.arange(0x110000, dtype=np.uint32) + np.uint32(_OTHER)
        for c, i in symbol.items():
            if len(c) == 1 and c != _SPACE:
                self.symbol_of[ord(c)] = i
        if _SPACE in symbol:
            self.symbol_of[ord(" ")] = symbol[_SPACE]
        self.char_of = dict(enumerate(chars, len(self.bytes)))
        scores = sorted(set(self.score.values()))
        at = {x: i for i, x in enumerate(scores)}
        self.rank = np.full(self.none + 1, _LAST, np.int32)
        pairs = {}
        for piece, i in self.id.items():
            self.rank[i] = at[self.score[piece]]
            for k in range(1, len(piece)):
                left, right = symbol.get(piece[:k]), symbol.get(piece[k:])
                if left is not None and right is not None:
                    pairs[left * (self.none + 1) + right] = i
        self.bits = max(8, (4 * len(pairs)).bit_length())
        self.pair = np.full(1 << self.bits, _GONE, np.uint32)
        self.joined = np.full(1 << self.bits, self.none, np.uint16)
        for key, i in pairs.items():
            slot = (key * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - self.bits
            while self.pair[slot] != _GONE:
                slot = (slot + 1) & (1 << self.bits) - 1
            self.pair[slot], self.joined[slot] = key, i

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of the piece that two symbols join to, or none."""
        key = np.minimum(left, self.none) * np.uint32(self.none + 1) + np.minimum(right, self.none)
        slot = key * np.uint32(0x9E3779B1) >> np.uint32(32 - self.bits)
        there = self.pair[slot]
        out = self.joined[slot]
        open_ = np.flatnonzero(there != key)
        out[open_] = self.none
        open_ = open_[there[open_] != _GONE]
        while open_.size:
            slot[open_] = (slot[open_] + np.uint32(1)) & np.uint32((1 << self.bits) - 1)
            there = self.pair[slot[open_]]
            hit = there == key[open_]
            out[open_[hit]] = self.joined[slot[open_[hit]]]
            open_ = open_[~hit & (there != _GONE)]
        return out

    def agendas(self, symbols: np.ndarray, keys: np.ndarray | None = None, below: int = 0, record: list | None = None) -> np.ndarray:
        """Symbols left of each row once its agenda is empty; _GONE where there is none.

        symbols: one word a row, filled up with _GONE. record gets (rows,
        candidates) of each round.
        """
        n, width = symbols.shape
        out = symbols.copy()
        if width < 2 or not n:
            return out
        now = np.full((n, width + 1), _GONE, np.uint32)  # the last column is before the first and behind the last symbol
        now[:, :-1] = symbols
        into = np.full((n, width + 1), self.none, np.uint16)
        into[:, :-2] = self.join(now[:, :-2].ravel(), now[:, 1:-1].ravel()).reshape(n, -1)
        rank = self.rank[into]
        after = np.broadcast_to(np.minimum(np.arange(1, width + 2), width).astype(np.int8), now.shape).copy()
        before = np.broadcast_to(((np.arange(width + 1) - 1) % (width + 1)).astype(np.int8), now.shape).copy()
        row = np.arange(n)
        while True:
            i = rank.argmin(1)
            at = np.arange(len(row)) * (width + 1)
            busy = rank.ravel()[at + i] != _LAST
            if not busy.all():
                over = ~busy
                out[row[over]] = now[over, :-1]
                now, into, rank, after, before, row, i = (x[busy] for x in (now, into, rank, after, before, row, i))
                if keys is not None:
                    keys = keys[busy]
                at = at[:len(row)]
                if not len(row):
                    return out
            flat = [x.reshape(-1) for x in (now, into, rank, after, before)]
            f_now, f_into, f_rank, f_after, f_before = flat
            here = at + i
            piece = f_into[here]
            if record is not None or keys is not None:
                candidate = i.astype(np.uint64) * np.uint64(_A) + piece.astype(np.uint64) * np.uint64(_B) + f_after[here].astype(np.uint64) * np.uint64(_C)
                if record is not None:
                    record.append((row, candidate))
            if keys is not None:
                skip = _mixed(candidate ^ keys) < np.uint64(below)
                f_rank[here[skip]] = _LAST
                go = np.flatnonzero(~skip)
                here, piece, at_, i_ = here[go], piece[go], at[go], i[go]
            else:
                at_, i_ = at, i
            gone = at_ + f_after[here]
            f_now[here] = piece
            f_rank[gone] = _LAST
            behind = f_after[gone]
            f_now[gone] = _GONE
            f_after[here] = behind
            f_before[at_ + behind] = i_
            ahead = at_ + f_before[here]
            f_before[at_ + width] = width
            both = self.join(np.concatenate([f_now[here], f_now[ahead]]), np.concatenate([f_now[at_ + behind], f_now[here]]))
            where = np.concatenate([here, ahead])
            f_into[where] = both
            f_rank[where] = self.rank[both]

    def flat_ids(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows' symbols one after another, ids of each row)."""
        there = symbols != _GONE
        flat, count = symbols[there], there.sum(1)
        odd = np.flatnonzero(flat >= len(self.bytes))
        if not odd.size:
            return flat.astype(np.uint16), count
        data = [(self.char_of.get(s) or chr(s - _OTHER)).encode("utf-8", "surrogatepass") for s in flat[odd].tolist()]
        size = np.ones(len(flat), np.int64)
        size[odd] = list(map(len, data))
        begin = np.cumsum(size) - size
        out = np.repeat(flat, size).astype(np.uint16)
        for at, x in zip(begin[odd].tolist(), data, strict=True):
            out[at:at + len(x)] = [self.byte_id[c] for c in x]
        row = np.repeat(np.arange(len(symbols)), count)
        return out, np.bincount(row, size, len(symbols)).astype(np.int64)

    def ids(self, symbols: list[str]) -> bytes:
        out = list(map(self.id.get, symbols))
        if None in out:
            found, out = out, []
            for i, s in zip(found, symbols, strict=True):
                if i is None:
                    out += [self.byte_id[b] for b in (_SPACE if s == _LITERAL else s).encode()]
                else:
                    out.append(i)
        return array("H", out).tobytes()

    def segment(self, word: str, key: int = 0, below: int = 0) -> bytes:
        """Ids of one word (its leading spaces included) as 16-bit numbers.

        A candidate is two neighbours: it is named by where they begin and by
        what they make. One that comes off the agenda is dropped if its hash
        under the key is below the bound; it comes back only if one of its sides
        changes, as another candidate.
        """
        return self._segment(word, (lambda x: _mixed(key ^ x) < below) if below else None)

    def _segment(self, word: str, skip) -> bytes:
        symbols = list(word) if _SPACE not in word else [_LITERAL if c == _SPACE else c for c in word]
        symbols = [_SPACE if c == " " else c for c in symbols]
        return self.ids((self._short if len(symbols) <= _SHORT else self._long)(symbols, skip))

    def _short(self, symbols: list[str], skip) -> list[str]:
        """The agenda of a short word is a list with a place for each pair of neighbours."""
        score, id_ = self.score.get, self.id
        start = list(range(len(symbols)))
        agenda = [score(a + b, _NEVER) for a, b in zip(symbols, symbols[1:], strict=False)]
        while agenda:
            best = min(agenda)
            if best == _NEVER:
                break
            i = agenda.index(best)
            joined = symbols[i] + symbols[i + 1]
            if skip and skip(start[i] * _A + id_[joined] * _B + start[i + 1] * _C & _64):
                agenda[i] = _NEVER
                continue
            symbols[i] = joined
            del symbols[i + 1], start[i + 1], agenda[i]
            if i < len(agenda):
                agenda[i] = score(joined + symbols[i + 1], _NEVER)
            if i:
                agenda[i - 1] = score(symbols[i - 1] + joined, _NEVER)
        return symbols

    def _long(self, symbols: list[str], skip) -> list[str]:
        """The agenda of a long word is a heap; candidates whose sides have changed are passed over."""
        score, n = self.score, len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(score[p], i, p) for i in range(n - 1) if (p := symbols[i] + symbols[i + 1]) in score]
        heapq.heapify(agenda)
        while agenda:
            _, i, joined = heapq.heappop(agenda)
            k = after[i]
            if symbols[i] is None or k >= n or symbols[i] + symbols[k] != joined:
                continue
            if skip and skip(i * _A + self.id[joined] * _B + k * _C & _64):
                continue
            symbols[i], symbols[k] = joined, None
            after[i] = j = after[k]
            if j < n:
                before[j] = i
                if (p := joined + symbols[j]) in score:
                    heapq.heappush(agenda, (score[p], i, p))
            if (h := before[i]) >= 0 and (p := symbols[h] + joined) in score:
                heapq.heappush(agenda, (score[p], h, p))
        return [s for s in symbols if s is not None]

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids; the space put before it is taken off."""
        table = self.bytes
        data = b"".join(map(table.__getitem__, ids.tolist()))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


class _Known(dict):
    """Numbers of words; a word that has none gets the next one, a long one -1."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        if len(word) > _SHORT:
            return -1
        self[word] = out = len(self)
        self.fresh.append(word)
        return out


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... size[0] of them, then those of begin[1], and so on."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Encoder:
    """Encodes texts; draw numbers independent encodings of the same text."""

    def __init__(self, pieces: Pieces, rate: float, seed: int, draw: int = 0):
        self.pieces, self.seed, self.draw = pieces, seed, draw
        self.below = min(int(rate * 2**64), _64)
        self._forget()

    def _forget(self):
        self.known = _Known()
        self.symbols, self.steps, self.ids = np.zeros(0, np.uint32), np.zeros(0, np.uint64), np.zeros(0, np.uint16)
        self.ends = [np.zeros(1, np.int64) for _ in range(3)]  # of the words in symbols, steps and ids

    def _matrix(self, begin: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
        at = begin[:, None] + np.arange(width)
        return np.where(np.arange(width) < size[:, None], self.symbols[np.minimum(at, len(self.symbols) - 1)], np.uint32(_GONE))

    def _by_width(self, begin: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, their symbols as a matrix) for words of about the same length."""
        width = np.searchsorted(_WIDTHS, size)
        for k, w in enumerate(_WIDTHS):
            rows = np.flatnonzero(width == k)
            if len(rows):
                yield rows, self._matrix(begin[rows], size[rows], w)

    def _learn(self):
        """Keeps the agendas of the fresh words, run without a skip."""
        fresh, self.known.fresh = self.known.fresh, []
        if not fresh:
            return
        size = np.fromiter(map(len, fresh), np.int64, len(fresh))
        code = np.frombuffer("".join(fresh).encode("utf-32-le", "surrogatepass"), np.uint32)
        begin = np.cumsum(size) - size + len(self.symbols)
        self.symbols = np.concatenate([self.symbols, self.pieces.symbol_of[code]])
        step_rows, steps, id_rows, ids = [], [], [], []
        for rows, matrix in self._by_width(begin, size):
            record: list = []
            flat, count = self.pieces.flat_ids(self.pieces.agendas(matrix, record=record))
            ids.append(flat)
            id_rows.append(np.repeat(rows, count))
            step_rows += [rows[r] for r, _ in record]
            steps += [c for _, c in record]
        kept = [size]
        for name, of, what in (("steps", step_rows, steps), ("ids", id_rows, ids)):
            of = np.concatenate(of) if of else np.zeros(0, np.int64)
            order = np.argsort(of, kind="stable")
            old = getattr(self, name)
            setattr(self, name, np.concatenate([old, np.concatenate(what)[order]]) if len(of) else old)
            kept.append(np.bincount(of, minlength=len(fresh)))
        self.ends = [np.concatenate([e, e[-1] + np.cumsum(n)]) for e, n in zip(self.ends, kept, strict=True)]

    def _span(self, which: int, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin = self.ends[which][word]
        return begin, self.ends[which][word + 1] - begin

    def segment(self, words: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words one after another, how many each has); each word is drawn under its key."""
        if len(self.known) > _CACHE:
            self._forget()
        word = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        self._learn()
        sources, length = [self.ids], len(self.ids)
        long = np.flatnonzero(word < 0)
        begin, size = self._span(2, np.maximum(word, 0)) if len(self.ends[2]) > 1 else (np.zeros(len(words), np.int64),) * 2
        begin, size = begin.copy(), size.copy()

        def put(rows, flat, count):
            nonlocal length
            sources.append(flat)
            begin[rows], size[rows] = np.cumsum(count) - count + length, count
            length += len(flat)

        if self.below:
            short = np.flatnonzero(word >= 0)
            first, n = self._span(1, word[short])
            hit = _mixed(self.steps[_spread(first, n)] ^ np.repeat(keys[short], n)) < np.uint64(self.below)
            again = np.zeros(len(short), bool)
            again[np.repeat(np.arange(len(short)), n)[hit]] = True
            again = short[again]
            for rows, matrix in self._by_width(*self._span(0, word[again])) if len(again) else ():
                put(again[rows], *self.pieces.flat_ids(self.pieces.agendas(matrix, keys[again[rows]], self.below)))
        if len(long):
            own = [np.frombuffer(self.pieces.segment(words[i], int(keys[i]), self.below), np.uint16) for i in long.tolist()]
            put(long, np.concatenate(own), np.array(list(map(len, own)), np.int64))
        return np.concatenate(sources)[_spread(begin, size)] if len(sources) > 1 else self.ids[_spread(begin, size)], size

    def encode_many(self, given: list[str], keys: list[str]) -> list[np.ndarray]:
        """16-bit ids of each text; its key is the document."""
        split = [_WORDS.findall(" " + x) if x else [] for x in given]
        count = np.array(list(map(len, split)), np.int64)
        doc = np.array([xxhash.xxh64_intdigest(f"{self.seed} {self.draw} {k}") for k in keys], np.uint64)
        place = _spread(np.ones(len(count), np.int64), count).astype(np.uint64)
        key = _mixed(np.repeat(doc, count) ^ _mixed(place * np.uint64(_B)))
        words, flat, size = (w for s in split for w in s), [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)]
        for at in range(0, len(key), _CHUNK):
            ids, n = self.segment(list(islice(words, _CHUNK)), key[at:at + _CHUNK])
            flat.append(ids)
            size.append(n)
        ends = np.concatenate([[0], np.cumsum(np.concatenate(size))])[np.cumsum(count)]
        return np.split(np.concatenate(flat), ends[:-1])

    def encode(self, text: str, key: str) -> np.ndarray:
        return self.encode_many([text], [key])[0]


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, rate: float = RATE, seed: int = SEED, draw: int = 0, ids: bool = True) -> DataFrame:
    """The given rows, for the text: n_chars, n_tokens, tokens (ids, if wanted), tokens_sha256 (of the 16-bit
    little-endian ids), decoded_sha256 (of the decoded ids in UTF-8) and lossless (whether they give the text).

    Null and empty texts have no tokens. A null id keys its texts like an empty
    string. Other columns pass through, but for those named like the new ones.
    """
    new = {"n_chars": "long", "n_tokens": "long", "tokens": "array<int>", "tokens_sha256": "string", "decoded_sha256": "string", "lossless": "boolean"}
    if not ids:
        del new["tokens"]
    other = [c for c in docs.columns if c != text_col and c not in ("n_chars", "n_tokens", "tokens", "tokens_sha256", "decoded_sha256", "lossless")]
    given = docs.select(docs[id_col].cast("string").alias("_key"), docs[text_col].alias("_text"), *other)
    held = docs.sparkSession.sparkContext.broadcast(Pieces(model))
    kinds = {"long": pa.int64(), "array<int>": pa.list_(pa.int32()), "string": pa.string(), "boolean": pa.bool_()}

    def run(batches):
        encoder = Encoder(held.value, rate, seed, draw)
        for b in batches:
            for at in range(0, b.num_rows, _TEXTS):
                part = b.slice(at, _TEXTS)
                columns = {c: [] for c in new}
                keys, given_texts = texts(part.column(0)), texts(part.column(1))
                for text, got in zip(given_texts, encoder.encode_many(given_texts, keys), strict=True):
                    back = encoder.pieces.decode(got)
                    columns["n_chars"].append(len(text))
                    columns["n_tokens"].append(len(got))
                    if ids:
                        columns["tokens"].append(got.astype(np.int32))
                    columns["tokens_sha256"].append(hashlib.sha256(got.astype("<u2").tobytes()).hexdigest())
                    columns["decoded_sha256"].append(hashlib.sha256(back.encode("utf-8")).hexdigest())
                    columns["lossless"].append(back == text)
                made = [pa.array(columns[c], kinds[k]) for c, k in new.items()]
                yield pa.RecordBatch.from_arrays([*part.columns[2:], *made], names=[*other, *new])

    schema = docs.select(*other).schema
    for c, k in new.items():
        schema = schema.add(c, "integer" if k == "array<int>" else k)
    if ids:
        from pyspark.sql import types as T

        schema["tokens"].dataType = T.ArrayType(T.IntegerType())
    return given.mapInArrow(lean(run), schema)


def op7_sentencepiece_dropout(spark, sf_dir) -> DataFrame:
    """Digests of every text's ids under dropout and of the decoded ids."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, ids=False).select("doc_id", "n_chars", "n_tokens", "tokens_sha256", "decoded_sha256", "lossless")
