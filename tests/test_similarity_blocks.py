"""Similarity joins whose blocks land in many partitions, as they do on large tables."""

import math
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom.operators import cluster as C
from memloom.operators import wiki as W
from memloom.plans import registry, search_queries


@pytest.fixture
def dealt(spark):
    """Shuffles keep their partitions, which small tables hide by having them joined up."""
    keys = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "13"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def table(spark, n, seed=2, dim=4):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>"), x / np.linalg.norm(x, axis=1, keepdims=True)


def test_blocks_in_many_partitions(dealt):
    df, u = table(dealt, 60)
    got = [(r["a"], r["b"]) for r in C.similarity_join(df, df, 0.7, block=7, self_join=True).collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i in range(60) for j in range(i + 1, 60) if u[i] @ u[j] >= 0.7}


def test_pending_over_many_partitions(dealt):
    df, u = table(dealt, 2100)
    rows, pages = df.where("id >= 5").withColumn("id", F.col("id").cast("string")), df.where("id < 5").select(F.concat(F.lit("p"), "id").alias("path"), "embedding")
    got = {(r["drawer_id"], r["page_path"]) for r in W.pending(rows, pages, threshold=0.8).collect()}
    assert got == {(str(i), f"p{j}") for i in range(5, 2100) for j in range(5) if u[i] @ u[j] >= 0.8}


def test_forest_has_the_components_of_all_pairs(dealt):
    df, u = table(dealt, 120)
    edges = C.similarity_join(df, df, 0.97, block=11, self_join=True, forest=True)
    got = {r["id"]: r["cluster_id"] for r in C.connected(edges, df.select("id")).collect()}
    root = list(range(120))
    for i, j in zip(*np.nonzero(u @ u.T >= 0.97)):
        old, new = max(root[i], root[j]), min(root[i], root[j])
        root = [new if r == old else r for r in root]
    assert got == dict(enumerate(root)) and 1 < len(set(root)) < 120
    again = df.limit(1).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(299).cast("long"))).alias("id"), "embedding")
    assert C.similarity_join(again, again, 0.97, self_join=True, forest=True).count() == 299  # not 44850 pairs


def near_theta(theta):
    """Vectors of which two have a cosine that rounds up to ``theta``."""
    c = theta - 3e-7
    return [(0, [1.0, 0.0, 0.0]), (1, [c, math.sqrt(1 - c * c), 0.0]), (2, [0.0, 0.0, 1.0])]


def test_scores_that_round_up_count(spark, tmp_path):
    for theta, name, want in ((0.4, "similarity_self_join", {(0, 1, 0.4)}), (0.45, "admission_near_duplicates", {(0, 1)}), (0.4, "similarity_components", {(0, 0), (1, 0), (2, 2)})):
        spark.createDataFrame(near_theta(theta), "vec_id long, embedding array<double>").write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
        assert {tuple(r) for r in registry.queries()[name](spark, str(tmp_path)).collect()} == want


def test_pairs_over_many_partitions_as_by_sql(dealt, tmp_path):
    x = np.random.default_rng(4).normal(size=(4500, 64))
    dealt.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(np.round(u @ u.T, 6) >= 0.45, 1))
    got = {(r["a"], r["b"]) for r in search_queries._pairs(dealt, str(tmp_path), 0.45).collect()}
    assert got == set(zip(i.tolist(), j.tolist())) and len(got) > 500


def by_sql(folder, name):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet/*.parquet'")
    return Counter(con.execute(registry.oracle_sql()[name]).fetchall())


def test_self_join_equals_its_sql(dealt, tmp_path):
    x = np.random.default_rng(6).normal(size=(4500, 24))
    rows = [(None if i % 900 == 7 else i, v.tolist()) for i, v in enumerate(x)]
    dealt.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = Counter(tuple(r) for r in registry.queries()["similarity_self_join"](dealt, str(tmp_path)).collect())
    assert got == by_sql(tmp_path, "similarity_self_join") and got.total() > 10000


def test_pending_equals_its_sql(dealt, tmp_path):
    x = np.random.default_rng(7).normal(size=(2500, 8))
    rows = [(None if i % 700 == 7 else i, v.tolist(), i % 9) for i, v in enumerate(x)]
    rows += rows[:1200]  # among them the rows of some medoids
    dealt.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = Counter(tuple(r) for r in registry.queries()["pending_updates"](dealt, str(tmp_path)).collect())
    assert got == by_sql(tmp_path, "pending_updates") and got.total() > 1000
