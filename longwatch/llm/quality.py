"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

A text is a bag of byte-class trigrams and of a few marks for words that repeat
the word before. Inverse document frequencies come from all documents. A
bounded sample of labelled rows gives a truncated singular value decomposition
of the weighted bags; its vectors and labels (a few MB, bounded by the
parameters) are broadcast, every document's vector is multiplied with all of
them in blocks, and the nearest labels vote by a power of their cosine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longwatch.llm.common import lean, read, texts

#: Labelled rows to fit on at most; those of the least keyed hash.
SAMPLE = 4096
DIMENSIONS = 64
NEIGHBOURS = 15
POWER = 4
THRESHOLD = 0.3
FOLDS = 5
_TRIGRAMS = 4096
_MARKS, _COPIES = 6, 24
WIDTH = _TRIGRAMS + _MARKS * _COPIES
_PART = 1 << 20


def _classes() -> np.ndarray:
    """Sixteen classes of bytes: vowels, consonants, capitals, digits, spaces, marks, and bytes of longer characters."""
    out = np.full(256, 15, np.uint8)
    for i, chars in enumerate((b"bcdfghjklmnpqrstvwxyz", b"aeiou", bytes(range(65, 91)), b"0123456789", b" ", b"\n", b".", b",", b"!", b"|", b"*$%&#", b"?;:-_/\\", b"\"'()[]{}<>=@+~^`", bytes(range(128, 192)), bytes(range(192, 256)))):
        out[np.frombuffer(chars, np.uint8)] = i
    return out


_CLASS = _classes()
#: Shares of words equal to the word before, from which the next mark is set.
_REPEATS = np.array([0.005, 0.02, 0.05, 0.15, 0.4])


def bag(text: str) -> np.ndarray:
    """Feature counts of a whole text; an empty one is three line ends."""
    data = (text or "\n\n\n").encode("utf-8", "surrogatepass")
    out = np.zeros(WIDTH, np.float32)
    raw = np.frombuffer(data, np.uint8)
    words = same = 0
    last = None
    for i in range(0, len(raw), _PART):
        a = _CLASS[raw[i:i + _PART + 2]].astype(np.int32)
        if len(a) > 2:
            out[:_TRIGRAMS] += np.bincount((a[:-2] << 8) | (a[1:-1] << 4) | a[2:], minlength=_TRIGRAMS)
        part = data[i:i + _PART].split()
        words += len(part)
        same += sum(map(bytes.__eq__, part, part[1:])) + (bool(part) and part[0] == last)
        last = part[-1] if part else last
    mark = int(np.searchsorted(_REPEATS, same / words if words else 0, side="right"))
    out[_TRIGRAMS + mark * _COPIES:_TRIGRAMS + (mark + 1) * _COPIES] = max(1, len(raw) // 8)
    return out


def _weigh(bags: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(bags) * idf
    return x / np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))


def _bags(column: pa.Array, step: int = 512):
    """Bags of a column of texts, so many rows at a time."""
    for i in range(0, len(column), step):
        yield np.stack([bag(x) for x in texts(column.slice(i, step))])


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[int, np.ndarray]:
    """(documents, documents that hold each feature), over all rows; each task sends one bounded row."""

    def run(batches):
        n, df = 0, np.zeros(WIDTH, np.int64)
        for b in batches:
            for x in _bags(b.column(0)):
                n += len(x)
                df += (x > 0).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([df.tolist()], pa.list_(pa.int64()))], names=["n", "df"])

    parts = docs.select(text_col).mapInArrow(lean(run), "n long, df array<bigint>")
    sums = parts.select("n", F.posexplode("df").alias("i", "d")).groupBy("i").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    df, n = np.zeros(WIDTH), 0
    for r in sums.collect():  # WIDTH rows
        df[r.i], n = r.d, r.n
    return n, df


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int, folds: int) -> tuple[np.ndarray, np.ndarray]:
    """(bags, labels) of at most sample labelled rows outside the held-out fold, those of the least keyed hash."""
    known = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).where(_remainder(id_col, folds) != 0)
        .groupBy(id_col).agg(F.avg((F.col(label_col) > 0).cast("int")).alias("_label"))
    )
    picked = known.join(docs.select(id_col), id_col, "left_semi").orderBy(F.xxhash64(F.lit(10), id_col), id_col).limit(sample)
    rows = docs.select(id_col, text_col).join(F.broadcast(picked), id_col).select("_label", text_col)

    def run(batches):
        for b in batches:
            rows = []
            for x in _bags(b.column(1)):
                rows += [np.concatenate([np.flatnonzero(r), r[r > 0]]).astype(np.float32).tobytes() for r in x]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], names=["label", "bag"])

    got = rows.mapInArrow(lean(run), "label double, bag binary").orderBy("label", "bag").limit(sample).collect()
    bags = np.zeros((len(got), WIDTH), np.float32)
    for row, r in zip(bags, got, strict=True):
        x = np.frombuffer(r.bag, np.float32)
        row[x[:len(x) // 2].astype(int)] = x[len(x) // 2:]
    return bags, np.array([r.label for r in got], np.float32)


def _remainder(id_col: str, folds: int):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def fit(bags: np.ndarray, idf: np.ndarray, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """(projection, latent unit vectors of the bags) by a seeded randomized decomposition."""
    a = _weigh(bags, idf)
    q = np.random.default_rng(10).standard_normal((a.shape[1], dimensions + 16)).astype(np.float32)
    for _ in range(4):
        q, _r = np.linalg.qr(a.T @ (a @ q))
    _u, _s, vt = np.linalg.svd(a @ q, full_matrices=False)
    v = np.ascontiguousarray((q @ vt.T)[:, :dimensions], np.float32)
    return v, _unit(a @ v)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    sample: int = SAMPLE, dimensions: int = DIMENSIONS, neighbours: int = NEIGHBOURS, folds: int = FOLDS, with_text: bool = True,
) -> DataFrame:
    """The given rows with score (0 to 1, higher: label 1 likelier) for every row.

    Scores use the text alone. Labels come from rows whose crc32 of the id mod
    folds is not 0; null labels and ids are passed over, of several labels of
    one id the mean counts. Null and empty texts are scored like a text of line
    ends. Without any label each score is 0.5. Other columns pass through, but
    for one named score, and for the text unless with_text.
    """
    docs = docs.drop("score")
    out_columns = [c for c in docs.columns if with_text or c != text_col]
    bags, known = labelled_sample(docs, labels, id_col, text_col, label_col, sample, folds)
    if not len(known):
        return docs.select(*out_columns, F.lit(0.5).alias("score"))
    n, df = document_frequencies(docs, text_col)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    v, vectors = fit(bags, idf, min(dimensions, len(known)))
    prior, k = float(known.mean()), min(neighbours, len(known))
    held = docs.sparkSession.sparkContext.broadcast((idf, v, vectors, known))
    at = docs.columns.index(text_col)

    def run(batches):
        idf, v, vectors, known = held.value
        for b in batches:
            out = [np.zeros(0)]
            for x in _bags(b.column(at)):
                cosine = _unit(_weigh(x, idf) @ v) @ vectors.T
                near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
                weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** POWER
                total = weight.sum(1)
                out.append(np.where(total > 0, (weight * known[near]).sum(1) / np.maximum(total, 1e-300), prior))
            score = np.clip(np.concatenate(out), 0, 1)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in out_columns), pa.array(score)], names=[*out_columns, "score"])

    return docs.mapInArrow(lean(run), docs.select(*out_columns).schema.add("score", "double"))


def op10_quality_votes(spark, sf_dir) -> DataFrame:
    """Quality score of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_scores(docs, read(spark, sf_dir, "labels").select("doc_id", "quality"), with_text=False)
    held_out = F.coalesce(_remainder("doc_id", FOLDS) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
