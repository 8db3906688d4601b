"""The pipeline's stages against their operators' definitions."""

from __future__ import annotations

import corpus_pipeline
from tillroll.llm import decontam
from tillroll.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = stage(spark, docs, SF)
        docs.cache()
        if i < 4:
            assert docs.columns == columns, name
            after = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert after.items() <= before.items()
            seen[name] = (before, after)
    before, after = seen["near_duplicates"]
    assert len(set(after.values())) == len(after)
    before, after = seen["decontamination"]
    items = [decontam.folded(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    exact = {d for d, t in before.items() if any(x in decontam.folded(t) for x in items)}
    assert exact and exact <= set(before) - set(after)
    before, after = seen["mixing"]
    assert after == before
    assert {d for r in docs.collect() for d in r["doc_ids"]} == set(after)


def test_registered():
    names = list(queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
    assert set(oracle_sql()) <= set(names)
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
