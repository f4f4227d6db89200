"""The pipeline's stages against what they promise, and its run."""

import pytest

import corpus_pipeline
from engram.llm import decontam, secrets
from tests.llm.helpers import documents, odd_documents, word_set

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = documents(spark, SF), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        out.append(docs)
    return out


def test_stages(spark, steps):
    raw = documents(spark, SF)
    kept, unique, clean, safe, mixed = (s.collect() for s in steps)
    for df in steps[:-1]:
        assert df.dtypes == raw.dtypes
    original = {r.doc_id: r.text for r in raw.collect()}
    assert all(original[r.doc_id] == r.text for r in clean)
    assert {r.doc_id for r in clean} <= {r.doc_id for r in unique} <= {r.doc_id for r in kept}
    sets = {r.doc_id: word_set(r.text, 5) for r in kept}
    ids = {r.doc_id for r in unique}
    for gone in set(sets) - ids:  # each that went has a near copy, directly or through others
        assert any(len(sets[gone] & s) >= 0.8 * len(sets[gone] | s) for k, s in sets.items() if k != gone)
    survivors = sorted(ids)
    for i, a in enumerate(survivors):
        for b in survivors[:i]:
            assert 100 * len(sets[a] & sets[b]) < 80 * len(sets[a] | sets[b])
    leaked = {r.doc_id for r in decontam.leaks(steps[1], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert leaked and {r.doc_id for r in clean} == ids - leaked
    assert {r.doc_id for r in safe} == {r.doc_id for r in clean}
    assert not any(kind in ("assign", "access", "hex") for r in safe for kind, *_ in secrets.scan(r.text))
    assert all(r.n_chars == len(r.text) for r in safe)
    assert {r.doc_id for r in mixed} == {r.doc_id for r in safe}


def test_run(spark, steps):
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, steps[-1].collect()))


def test_odd_documents(spark):
    for docs in (odd_documents(spark), odd_documents(spark).limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        assert docs.count() >= 0
