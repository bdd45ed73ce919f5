import duckdb
import pytest

import corpus_pipeline
from tabproof.llm.decontaminate import contaminated
from tabproof.llm.store import stored
from tests.conftest import SF_DIR

LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def staged(spark):
    docs, out = spark.read.parquet(f"{LARGER}/documents.parquet"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], LARGER), "test-stage"))
    return out


def test_columns_and_order(staged):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "near-dedup", "substring dedup", "benchmark decontamination", "packing"]
    assert all(s.columns == staged[0].columns for s in staged[:-1])


def test_decisions_take_effect(staged, spark):
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in staged]
    assert all(b <= a for a, b in zip(ids, ids[1:])) and ids[4] == ids[5]
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{LARGER}/labels.parquet'").fetchall()
    assert not any(i in ids[1] for i, q in labels if q == 0)
    assert sum(i not in ids[1] for i, q in labels if q == 1) <= 1
    texts = [r.text for r in staged[2].collect()]
    assert len(set(texts)) == len(texts)
    items = spark.read.parquet(f"{LARGER}/benchmark.parquet")
    assert ids[3] - ids[4] == {r.doc_id for r in contaminated(staged[3], items).collect()} != set()
    assert contaminated(staged[4], items).collect() == []


def test_no_passage_is_left_twice(staged):
    first = {}
    for r in sorted(staged[3].collect(), key=lambda r: r.doc_id):
        words = r.text.lower().split()
        runs = {tuple(words[j:j + 60]) for j in range(len(words) - 59)}
        assert not any(first.get(x, r.doc_id) != r.doc_id for x in runs), r.doc_id
        first |= {x: r.doc_id for x in runs}


def test_packing_holds_every_document(staged):
    pieces = staged[5].groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert all(r["sum(length)"] == r["max(doc_tokens)"] for r in pieces)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF_DIR).count() > 0


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_edges(spark, edges, nothing, k):
    name, stage = corpus_pipeline.STAGES[k]
    rows = stage(spark, edges, SF_DIR)
    rows.collect()
    if name != "packing":
        assert rows.columns == edges.columns
    assert stage(spark, nothing, SF_DIR).collect() == []
