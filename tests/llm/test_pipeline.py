"""The pipeline's stages: their columns, and what each may do to its input."""

import os

import pytest

import corpus_pipeline as pipeline
from tests.oracle import DATA

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = [{r.doc_id: r.text for r in docs.collect()}]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == pipeline.COLUMNS
            seen.append({r.doc_id: r.text for r in docs.collect()})
            assert set(seen[-1]) <= set(seen[-2])
    kept, single, cut, mixed = seen[1:]
    assert all(kept[i] == seen[0][i] for i in kept) and all(single[i] == kept[i] for i in single)
    assert len(set(single.values())) == len(single) and set(cut) == set(single)
    assert all(len(cut[i]) <= len(single[i]) for i in cut) and all(mixed[i] == cut[i] for i in mixed)
    assert all(r.lossless and r.n_chars == len(mixed[r.doc_id]) for r in docs.collect())
