import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom.operators import cluster as C
from memloom.operators import evaluation as E
from memloom.operators import graph as G
from memloom.operators import memory as M
from memloom.operators import retrieval as R
from memloom.operators import wiki as W


def vectors(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "id long, embedding array<double>")


def test_mmr_matches_greedy(spark):
    rng = np.random.default_rng(3)
    x, s = rng.normal(size=(30, 8)), rng.random(30)
    df = spark.createDataFrame([(i, float(s[i]), x[i].tolist()) for i in range(30)], "id long, score double, embedding array<double>")
    got = [r["id"] for r in R.mmr(df, 6, 0.5).orderBy("position").collect()]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    left = sorted(range(30), key=lambda i: (-s[i], i))
    want = [left[0]]
    while len(want) < 6:
        want.append(max((i for i in left if i not in want), key=lambda i: 0.5 * s[i] - 0.5 * max(0, *(float(u[i] @ u[j]) for j in want))))
    assert got == want


def test_rrf_does_not_depend_on_order(spark):
    a = spark.createDataFrame([(1, 3.0), (2, 2.0)], "id long, score double")
    b = spark.createDataFrame([(2, 9.0), (3, 1.0)], "id long, score double")
    x = {r["id"]: r["score"] for r in R.rrf([R.ranked(a, "a"), R.ranked(b, "b")]).collect()}
    y = {r["id"]: r["score"] for r in R.rrf([R.ranked(b, "b"), R.ranked(a, "a")]).collect()}
    assert x == pytest.approx(y) and x[2] == pytest.approx(1 / 62 + 1 / 61)


def test_min_max_single_row(spark):
    df = spark.createDataFrame([(1, 5.0)], "id long, score double")
    assert R.min_max(df).first()["score"] == 5.0


def test_decay_ratio(spark):
    r = spark.range(1).select(R.decay_boost(F.lit(1.0), F.lit(100), F.lit(1)) / R.decay_boost(F.lit(1.0), F.lit(0), F.lit(1))).first()[0]
    assert 0.78 < r < 0.90


def test_guidance_bands(spark):
    rows = [(True, 0.10, 0, "verify"), (True, 0.30, 0, "ask_user"), (True, 0.72, 3, "proceed"), (False, 0.0, 0, "proceed"), (True, 1.0, 0, "ask_user")]
    df = spark.createDataFrame(rows, "seed boolean, score double, n int, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", R.seed_guidance(F.col("seed"), F.col("score"), F.col("n"))).collect())


def test_similarity_join_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 4))
    df = vectors(spark, enumerate(x))
    got = {(r["a"], r["b"]) for r in C.similarity_join(df, df, 0.7, block=7, self_join=True).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert got == {(i, j) for i in range(40) for j in range(i + 1, 40) if u[i] @ u[j] >= 0.7}


def direction(d, noise=0.0, seed=0, n=64):
    j = np.arange(n)
    v = np.cos(d * np.pi / 6 + j * 0.001) + np.sin(seed + j) * noise
    return v / np.linalg.norm(v)


def test_geometry_and_prune(spark):
    df = vectors(spark, [(0, direction(0)), (1, direction(0)), (2, direction(0)), (3, direction(3))])
    pairs = C.similarity_join(df, df, 0.97, self_join=True)
    m = df.join(C.connected(pairs, df.select("id")), "id").withColumn("access_count", F.lit(0))
    g = {r["cluster_id"]: r for r in C.geometry(m).collect()}
    assert g[0]["n"] == 3 and g[0]["d_bar"] == pytest.approx(0, abs=1e-9) and g[3]["d_bar"] == 0 and g[3]["d_eff"] == 1
    kept = {r["id"]: r["is_representative"] for r in C.prune(m, C.geometry(m), 0.97).collect()}
    assert kept == {0: True, 1: False, 2: False, 3: True}
    used = C.prune(m.withColumn("access_count", F.when(F.col("id") == 2, 3).otherwise(0)), C.geometry(m), 0.97)
    assert {r["id"] for r in used.where("is_representative").collect()} == {0, 2, 3}


def test_geometry_against_eigenvalues(spark):
    x = np.random.default_rng(5).normal(size=(12, 6))
    m = vectors(spark, enumerate(x)).withColumn("cluster_id", F.lit(1))
    r = C.geometry(m).first()
    u, c = x / np.linalg.norm(x, axis=1, keepdims=True), x - x.mean(0)
    lam = np.clip(np.linalg.eigvalsh(c @ c.T), 0, None)
    pairs = [1 - u[i] @ u[j] for i in range(12) for j in range(i)]
    assert r["d_bar"] == pytest.approx(np.mean(pairs)) and r["d_eff"] == pytest.approx(lam.sum() ** 2 / (lam**2).sum())


def test_regime(spark):
    df = spark.createDataFrame([(0.01, "Tight"), (0.20, "Spread"), (0.0, "Unknown"), (0.15, "Spread")], "d double, want string")
    theta = 0.85
    assert all(r["got"] == r["want"] for r in df.where("d <> 0.15").withColumn("got", C.regime(F.col("d"), theta)).collect())


def test_greedy_distinct_keeps_first(spark):
    df = vectors(spark, [(0, [1, 0]), (1, [1, 0.01]), (2, [0, 1])]).withColumn("wing", F.lit("w"))
    assert {r["id"] for r in C.greedy_distinct(df, 0.92, "wing", "id").collect()} == {0, 2}


def test_admission(spark):
    df = spark.createDataFrame([("TODO: fix", 0.0), ("A" * 200, 0.0), ("A" * 200, 0.99), ("#" * 200 + "a", 0.0)], "text string, near double")
    got = [r["reason"] for r in C.admission(df, nearest=F.col("near")).collect()]
    assert got == ["content too short", None, "near_duplicate", "mostly symbols"]


def test_triples_swap_and_as_of(spark):
    t = spark.createDataFrame([("lib", "required by", "app"), ("app", "Uses Tool", "duckdb")], "subject string, predicate string, object string")
    assert {tuple(r) for r in G.canonical_triples(t).collect()} == {("app", "depends_on", "lib"), ("app", "uses", "duckdb")}
    d = dt.date
    v = spark.createDataFrame([("a", "p", "b", d(2020, 1, 1), d(2021, 1, 1)), ("a", "p", "c", d(2021, 1, 1), None)], "subject string, predicate string, object string, valid_from date, valid_to date")
    assert [r["object"] for r in G.as_of(v, "2021-01-01").collect()] == ["c"]
    assert [r["object"] for r in G.as_of(v, "2020-12-31").collect()] == ["b"]


def test_predicate_boost(spark):
    docs = spark.createDataFrame([(1, "The App uses the DuckDB engine"), (2, "duckdb uses app")], "id long, text string")
    p = spark.createDataFrame([("app", "uses", "duckdb")], "s string, p string, o string")
    assert [tuple(r) for r in G.predicate_boost(docs, p).collect()] == [(1, 0.1)]


def test_merge_entities(spark):
    e = spark.createDataFrame([("a", "A", "{}"), ("b", "B", "{}")], "id string, name string, properties string")
    t = spark.createDataFrame([("b", "p", "x"), ("y", "p", "b")], "subject string, predicate string, object string")
    kept, moved = G.merge_entities(e, t, spark.createDataFrame([("b", "a")], "alias string, canonical string"))
    assert [tuple(r) for r in kept.collect()] == [("a", "A", '{"aliases":["B"]}')]
    assert {tuple(r) for r in moved.collect()} == {("a", "p", "x"), ("y", "p", "a")}


def test_lint(spark):
    pages = spark.createDataFrame(
        [("a", "w", "Alpha", "see Beta soon", ["deadbeef12345678"], 0.9), ("b", "w", "Beta", "alone", ["00000000000000aa"], 0.2)],
        "path string, wing string, title string, content string, citations array<string>, quality_score double",
    )
    drawers = spark.createDataFrame([("00000000000000aa", None, False)], "id string, valid_to timestamp, is_representative boolean")
    queue = spark.createDataFrame([(str(i), "a", "d", 0.9, None) for i in range(4)], "id string, page_path string, drawer_id string, similarity double, resolved_at timestamp")
    found = {(r["rule"], r["path"]) for r in W.lint(pages, drawers, queue).collect()}
    assert found >= {("BrokenCitation", "a"), ("OrphanPage", "a"), ("StalePage", "b"), ("MissingCrossLink", "a"), ("PendingUpdates", "a"), ("LowQuality", "b")}


def test_task_pruning(spark):
    m = spark.createDataFrame([(1, 10, 0), (2, 6, 4), (3, 2, 0), (4, 8, 1), (5, 0, 0)], "id long, retrieval_count int, utility_count int")
    assert {r["id"] for r in M.pruned(m).collect()} == {2, 3, 5}


def test_tool_statistics(spark):
    rows = [(str(i), "grep", i < 3, None, None, None, dt.datetime(2024, 1, 1)) for i in range(5)]
    c = spark.createDataFrame(rows, "id string, tool_name string, success boolean, score double, time_seconds double, token_cost int, called_at timestamp")
    r = M.tool_statistics(c, None).first()
    assert (r["total"], r["successes"], r["rate"]) == (5, 3, pytest.approx(4 / 7))


def test_calibration(spark):
    df = spark.createDataFrame([(1, 0.95, 1), (2, 0.85, 1), (3, 0.15, 0), (4, 1.0, 0)], "id long, score double, relevant int")
    assert E.brier(df).first()[0] == pytest.approx((0.0025 + 0.0225 + 0.0225 + 1) / 4)
    assert E.ece(df).first()[0] == pytest.approx((abs(0.975 - 0.5) * 2 + 0.15 + 0.15) / 4)
