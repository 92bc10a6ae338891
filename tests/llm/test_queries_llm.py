"""The registered queries and the pipeline on the smallest tables."""

import pytest

import corpus_pipeline as P
from memloom.llm import queries as L


@pytest.mark.parametrize("name", sorted(L.oracle_sql()))
def test_against_sql(spark, duck, data, name):
    df = L.queries()[name](spark, data)
    cols = sorted(df.columns)
    r = duck.execute(L.oracle_sql()[name])
    at = [[x[0] for x in r.description].index(c) for c in cols]
    assert sorted((tuple(x[c] for c in cols) for x in df.collect()), key=str) == sorted((tuple(row[i] for i in at) for row in r.fetchall()), key=str)


def test_held_out_languages(spark, data):
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = [r for r in L.op5_language_id(spark, data).collect() if r["held_out"]]
    assert len(got) > 20 and sum(docs[r["doc_id"]] == r["lang_pred"] for r in got) / len(got) > 0.95


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in L.queries()] == [f"op{i}" for i in range(1, 11)]


def test_pipeline(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    before = {r["doc_id"] for r in docs.select("doc_id").collect()}
    out = P.run(spark, data)
    rows = out.collect()
    ids = [r["doc_id"] for r in rows]
    assert len(ids) == len(set(ids)) and set(ids) <= before and len(ids) > 0.7 * len(before)
    assert all(r["copies"] >= 1 and r["rate"] >= 0 for r in rows)
    leaks = {r["doc_id"] for r in L.op7_benchmark_decontamination(spark, data).collect()}
    assert not leaks & set(ids)


def test_stages_return_the_columns_of_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(40).cache()
    for name, stage in P.STAGES[:-1]:
        got = stage(spark, docs.withColumn("extra", docs.doc_id), data)
        assert got.columns == list(P.COLUMNS), name
        assert stage(spark, docs.limit(0), data).count() == 0, name
    assert 4 <= len(P.STAGES) <= 5
