"""The pipeline's stages on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest

import corpus_pipeline
from tests.llm.test_small import EDGES, docs, words

LABELS = "doc_id long, quality int, toxic int, text string"


@pytest.fixture
def folder(spark, tmp_path):
    def made(rows, labels):
        at = str(tmp_path / str(len(list(tmp_path.iterdir()))))
        docs(spark, rows).selectExpr("*", "cast(length(text) as bigint) AS n_chars", "7 AS repeats", "'x' AS _size", "'y' AS _id").write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame(labels, LABELS).write.parquet(f"{at}/labels.parquet")
        return at

    return made


GOOD = [(100 + k, words(120, k, 300) + ".", "ab"[k % 2]) for k in range(12)]
MARKED = [(100 + k, 1, 0, None) for k in range(12)] + [(200 + k, 0, 0, "z") for k in range(12)] + [(None, 1, 0, None), (100, None, None, None)]
JUNK = [(200 + k, " ".join([f"buy{k % 3}"] * 90), "a") for k in range(12)]


def test_every_stage_takes_what_the_one_before_leaves(spark, folder):
    at = folder(EDGES + GOOD + GOOD[:2] + JUNK, MARKED)
    left = spark.read.parquet(f"{at}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        left = stage(spark, left, at)
        if k < 4:
            assert left.columns == corpus_pipeline.COLUMNS
        left.write.parquet(f"{at}/{k}")
        left = spark.read.parquet(f"{at}/{k}")
    ids = {r.doc_id for r in left.select("doc_id").collect()}
    assert {100 + k for k in range(12)} & ids and not {200 + k for k in range(12)} & ids
    assert all(r.lossless for r in left.collect())


def test_copies_and_ties_leave_one_document(spark, folder):
    at = folder([(5, GOOD[0][1], "a"), (5, GOOD[0][1], "a"), (4, GOOD[0][1], "b"), (6, GOOD[0][1].upper(), "a")], MARKED)
    left = corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{at}/documents.parquet"), at)
    assert [r.doc_id for r in left.collect()] == [4]


@pytest.mark.parametrize("labels", [[], MARKED])
def test_pipeline_of_nothing(spark, folder, labels):
    assert corpus_pipeline.run(spark, folder([], labels)).count() == 0


def test_pipeline_without_labels(spark, folder):
    got = corpus_pipeline.run(spark, folder(GOOD[:3], []))
    assert got.where("NOT lossless").count() == 0
