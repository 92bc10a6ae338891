"""Learned operators, decontamination, licences, neighbours and mixing."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom.llm import quality as Q
from memloom.llm.ann import build_index, coarse, nearest, search_index, visits
from memloom.llm.decontam import contaminated
from memloom.llm.langid import identify_languages, learn_languages, viterbi
from memloom.llm.licenses import KNOWN, known_licenses, license_scan
from memloom.llm.linear import Sample, fit
from memloom.llm.mixing import fit_rates, mix_to_targets, replay, with_rates
from memloom.llm.toxicity import fit_chain, score_toxicity

EN = "the of and to in that is was he for it with as his on be at by had not are but from or have an they which".split()
FR = "le la les des est pour dans que une sur avec pas plus par sont elle nous vous mais cette leur comme tout être très".split()
RU = "и в не на я быть он с что а по это она этот к но они мы весь который из у".split()


def prose(words, n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rows = [(prose(w, 80, i), l) for i in range(8) for w, l in ((EN, "en"), (FR, "fr"), (RU, "ru"))]
    return learn_languages(spark.createDataFrame(rows + [(None, "en"), ("text", None), ("123", "fr")], "text string, lang string"))


def test_language(model, docs_of):
    rows = [prose(EN, 40, 90), prose(FR, 40, 91), prose(RU, 30, 92), None, "", "123 !!", "漢字仮名", "the", prose(EN, 9000, 93)]
    got = {r["doc_id"]: r for r in identify_languages(docs_of(rows).withColumn("score", F.lit("clash")), model).collect()}
    assert [got[i]["lang_pred"] for i in (0, 1, 2, 7, 8)] == ["en", "fr", "ru", "en", "en"]
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (3, 4, 5))
    assert got[6]["lang_pred"] in model.languages and got[6]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_spans(model, docs_of):
    r = identify_languages(docs_of([prose(EN, 30, 1) + " " + prose(FR, 60, 2)]), model).first()
    assert r["lang_pred"] == "fr" and [s["lang"] for s in r["lang_spans"]] == ["en", "fr"]
    assert abs(r["lang_spans"][0]["n_words"] - 30) <= 2


def test_language_nothing_learned(spark, docs_of):
    m = learn_languages(spark.createDataFrame([], "text string, lang string"))
    assert [r["lang_pred"] for r in identify_languages(docs_of(["some text"]), m).collect()] == ["und"]
    assert identify_languages(docs_of([]), m).count() == 0


def test_viterbi_is_optimal():
    rng = np.random.default_rng(0)
    for n in (1, 5, 30):
        for _ in range(40):
            s, pen = rng.normal(size=(n, 3)) * 4, float(rng.uniform(0.5, 12))
            best = s[0].copy()
            for t in range(1, n):
                best = s[t] + np.maximum(best, best.max() - pen)
            path = viterbi(s, pen)
            assert s[np.arange(n), path].sum() - pen * (path[1:] != path[:-1]).sum() == pytest.approx(best.max())


def test_licenses(spark, docs_of):
    mit = KNOWN["MIT"].replace("MIT License\n", "MIT License\n\nCopyright (c) 2024 Some Owner\n").upper().replace("SUBLICENSE", "SUB-LICENSE")
    rows = [mit, KNOWN["Zlib"].replace(" ", "\n  "), "Released under the  MIT License", "Released under the MIT License. And more.", None, "", "...", KNOWN["BSD-3-Clause"] * 40]
    got = {r["doc_id"]: r for r in license_scan(docs_of(rows).withColumn("license_id", F.lit(1)), known_licenses(spark)).collect()}
    assert [got[i]["license_id"] for i in range(8)] == ["MIT", "Zlib", "MIT-notice", None, None, None, None, None]
    assert got[4]["canonical_sha256"] is None and got[5]["canonical_sha256"] == got[6]["canonical_sha256"]
    assert license_scan(docs_of([]), known_licenses(spark).where("false")).count() == 0


def shingle_bag(text):
    import re

    w = [x for x in re.split(r"[^a-z0-9\x80-\U0010ffff]+", (text or "").lower()) if x]
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])


def brute_contaminated(rows, items):
    out = {}
    for d, t in rows:
        x = shingle_bag(t)
        for i, it in items:
            own = shingle_bag(it)
            m = len(own)
            for p in range(len(x) - m + 1 if m else 0):
                shared = sum((Counter(x[p : p + m]) & Counter(own)).values())
                if shared / (2 * m - shared) >= 0.8:
                    out[(d, i)] = max(out.get((d, i), 0), shared / (2 * m - shared))
    return out


def test_contaminated(spark, docs_of, words_of):
    items = [(k, " ".join(words_of(30 + k, 70 + k))) for k in range(6)] + [(6, "just three words"), (7, None), (8, ""), (9, "la " * 20), (10, " ".join(words_of(30, 70)))]
    item = dict(items)
    edited = item[1].split()
    edited[15] = "changed"
    long_edit = " ".join(words_of(60, 99))
    items.append((11, long_edit))
    close = long_edit.split()
    close.insert(3, "extra")
    rows = [
        (1, " ".join(words_of(50, 1)) + " " + item[0].upper().replace(" ", ", ") + " tail"), (2, " ".join(words_of(300, 2))), (3, " ".join(edited)),
        (4, item[2] + " x " + item[3]), (5, "Just three WORDS!"), (6, "just three words more"), (7, None), (8, "  "), (9, "la " * 50), (10, " ".join(item[4].split()[:20])),
        (11, " ".join(words_of(20, 3)) + " " + " ".join(close)), (12, " ".join(item[5].split()[18:] + item[5].split()[:18])), (13, " ".join(words_of(5000, 4)) + " " + item[2]), (13, item[2]),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in contaminated(docs_of(rows).withColumn("dc_id", F.lit(0)), bench).collect()}
    assert got == pytest.approx(brute_contaminated(rows, items))
    assert {(1, 0), (4, 2), (4, 3), (5, 6), (9, 9), (13, 2)} <= set(got) and (2, 0) not in got
    assert contaminated(docs_of([]), bench).count() == 0 and contaminated(docs_of(["a b c"]), bench.where("false")).count() == 0


def test_chain(spark, docs_of):
    bad, n = "idiot moron scum".split(), 160
    rows = [(i, prose(EN, 40, i) + (" " + bad[i % 3] if i % 4 == 0 else "") + (" %%%" * 6 if i % 5 == 0 else "")) for i in range(n)]
    labels = spark.createDataFrame([(i, int(i % 5 != 0), int(i % 4 == 0)) for i in range(n)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    chain = fit_chain(docs_of(rows), labels, {"junk": "1 - quality", "toxic": "toxic"})
    test = [(1000 + i, prose(EN, 50, 900 + i) + (" Moron!" if i % 2 else "")) for i in range(20)] + [(1, None), (2, ""), (3, "moron " * 9000)]
    got = {r["doc_id"]: r for r in score_toxicity(docs_of(test).withColumn("p_toxic", F.lit("clash")), chain).collect()}
    assert all((got[1000 + i]["p_toxic"] > 0.5) == bool(i % 2) for i in range(20)) and got[3]["p_toxic"] > 0.5
    assert got[1]["p_toxic"] == got[2]["p_junk"] == 0.0 and score_toxicity(docs_of([]), chain).count() == 0
    empty = fit_chain(docs_of([]), labels.where("false"), {"toxic": "toxic"})
    assert 0 <= score_toxicity(docs_of(["x"]), empty).first()["p_toxic"] <= 1


def test_em_finds_accuracies():
    rng = np.random.default_rng(1)
    y = rng.random(20000) < 0.8
    acc = [0.95, 0.9, 0.8, 0.7, 0.85, 0.6, 0.75, 0.9, 0.8, 0.7]
    v = np.stack([np.where(rng.random(len(y)) < 0.2, 1, np.where(rng.random(len(y)) < a, y, ~y) * 2) for a in acc], axis=1)
    p, c = np.unique((v * 3 ** np.arange(10)).sum(1), return_counts=True)
    weak = Q.expectation_maximisation(p, c)
    assert weak.prior == pytest.approx(0.8, abs=0.03)
    assert list(weak.accuracies().values()) == pytest.approx(acc, abs=0.04)


def test_quality(docs_of):
    good = [(i, "\n".join(f"{prose(EN, 12, i * 7 + j).capitalize()} sentence {i}." for j in range(8))) for i in range(60)]
    bad = [(100 + i, " ".join(f"{w}%%%" for w in prose(EN, 50, i).split())) for i in range(15)]
    odd = [(200, None), (201, ""), (202, "x"), (203, "word " * 20000)]
    docs = docs_of(good + bad + odd + [good[0]])
    got = {r["doc_id"]: r["quality"] for r in Q.score_quality(docs.withColumn("p_weak", F.lit(0)), Q.fit_quality(docs)).collect()}
    assert np.mean([got[i] > 0.5 for i, _ in good]) > 0.95 and np.mean([got[i] < 0.5 for i, _ in bad]) > 0.9 and got[200] == 0.0
    assert Q.score_quality(docs_of([]), Q.fit_quality(docs_of([]))).count() == 0


def test_linear_separates():
    rng = np.random.default_rng(0)
    rows = [np.unique(np.append(rng.integers(10, 4000, 30), 5 if i % 2 else 6)) for i in range(200)]
    m = fit(Sample.of(rows), np.eye(2)[[i % 2 for i in range(200)]])
    assert all((m.probabilities(r)[1] > 0.5) == bool(i % 2) for i, r in enumerate(rows))


def test_index_recall():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 32)).astype(np.float32) * rng.uniform(0.5, 2, (3000, 1)).astype(np.float32)
    q = x[:100]
    found = search_index(x, build_index(x), q, 100)
    want = np.argsort(-(q @ x.T), axis=1)[:, :20]
    assert np.mean([len(set(f[:20]) & set(w)) / 20 for f, w in zip(found.tolist(), want.tolist())]) > 0.95


def test_nearest_small_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [2.0, 0.0]), (3, [2.0, 0.0]), (20, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0]), (2, [2.0, 0.0]), (None, [1.0, 1.0]), (40, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(0))
    got = sorted(tuple(r) for r in nearest(df, df.where("vec_id % 20 = 0"), k=3).collect())
    assert got == [(0, 1, 2, 2.0), (0, 2, 3, 2.0), (0, 3, 1, 0.5), (20, 1, 1, 0.5), (20, 2, 0, 0.0), (20, 3, 2, 0.0)]
    assert nearest(df.where("false"), df, k=3).count() == 0
    assert nearest(df.where("vec_id = 0"), df.where("vec_id = 0"), k=3).count() == 0


def test_nearest_recall_over_shards_and_copies(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[700:900] = x[700]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = nearest(df, df.where("vec_id % 20 = 0"), k=20, shard=400).toPandas()
    hits = []
    for q, part in got.groupby("query_id"):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        best = np.lexsort([np.arange(1500), -np.round(s, 9)])[:20]
        assert list(part.sort_values("rank")["rank"]) == list(range(1, 21))
        hits.append(len(set(part["vec_id"]) & set(best)) / 20)
    assert len(hits) == 75 and np.mean(hits) > 0.95


def test_nearest_scores_are_of_the_original_doubles(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(60, 3)), [[1e300, -1e-300, 0.1], [0.37, 1 / 3, 1e-9], [3e38, 7e38, 1.0]]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = nearest(df, df.where("vec_id % 20 = 0"), k=100).collect()
    assert len(got) == 4 * 62
    for r in got:
        assert r["score"] == pytest.approx(float((x[r["vec_id"]] * x[r["query_id"]]).sum()), rel=1e-15)


def test_nearest_visits_few_shards_of_clustered_vectors(spark):
    """Rows of many clusters: queries visit a part of the centroids, and one cluster with a third of all rows is split."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 24)) * 3
    of = np.where(rng.random(4000) < 0.33, 0, rng.integers(0, 40, 4000))
    x = centres[of] + rng.normal(size=(4000, 24)) * 0.3
    centroids = coarse(x, 20)
    assert visits(x, centroids, 20) <= 6 and visits(rng.normal(size=(4000, 24)), coarse(rng.normal(size=(4000, 24)), 20), 20) > 10
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = nearest(df, df.where("vec_id % 100 = 0"), k=20, shard=200).toPandas()
    hits = []
    for q, part in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        hits.append(len(set(part["vec_id"]) & set(np.argsort(-s)[:20].tolist())) / 20)
        assert len(part) == 20
    assert len(hits) == 40 and np.mean(hits) > 0.95


def test_rates_meet_targets(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.3, 0.3, 0.3], 400)
    n = rng.integers(1, 500, 400)
    soft = spark.createDataFrame([(i, int(n[i]), p[i].tolist()) for i in range(400)] + [(999, 0, [1 / 3] * 3)], "doc_id long, n_tokens long, posterior array<double>")
    target = [0.6, 0.3, 0.1]
    grads = fit_rates(soft, target)
    got = {r["doc_id"]: r["rate"] for r in with_rates(soft, grads, 3).collect()}
    r = np.array([got[i] for i in range(400)])
    assert (r >= 0).all() and ((r * n) @ p / n.sum()) == pytest.approx(target, abs=0.01)
    # The same minimum by plain projected gradient.
    plain, w = np.ones(400), n / n.sum()
    for _ in range(20000):
        plain = np.maximum(0, plain - 0.9 * (p @ ((plain * w) @ p - target) + 1e-3 * (plain - 1)))
    cost = lambda x: 0.5 * (((x * w) @ p - target) ** 2).sum() + 5e-4 * (w * (x - 1) ** 2).sum()
    assert cost(r) == pytest.approx(cost(plain), abs=1e-5)
    assert replay(p, [np.zeros(3)], 1e-3)[0].tolist() == [1.0] * 400


def test_mixing_edge_cases(spark, docs_of):
    rows = [(i, prose(EN, 20, i) + (" moron" if i % 3 == 0 else "")) for i in range(30)] + [(50, None), (51, ""), (0, prose(EN, 20, 0) + " moron")]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(30)], "doc_id long, quality int, toxic int")
    domains, targets = {"toxic": "toxic = 1", "clean": "toxic = 0"}, {"toxic": 0.1, "clean": 0.9}
    got = mix_to_targets(docs_of(rows).withColumn("rate", F.lit("x")), labels, domains, targets).collect()
    assert len(got) == len(rows) and all(r["rate"] >= 0 for r in got) and {r["n_tokens"] for r in got if r["doc_id"] in (50, 51)} == {0}
    assert mix_to_targets(docs_of([]), labels, domains, targets).count() == 0
