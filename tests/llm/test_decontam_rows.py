"""Different texts of one id are each searched, and the pipeline's stage decides per row."""

import random

import pytest

import corpus_pipeline as P
from memloom.llm import decontam
from memloom.llm.decontam import contaminated
from tests.llm.test_models import brute_contaminated


def test_texts_of_one_id(spark, docs_of, words_of, tmp_path):
    head, item, other = words_of(30, 1), words_of(40, 2), words_of(40, 3)
    # One shared shingle at the same alignment, so that only one context an id was looked at before.
    decoys = [" ".join([*head, *item[:6], *words_of(80, 10 + i)]) for i in range(6)]
    leak, leak2 = " ".join([*head, *item, *words_of(40, 9)]), " ".join([*head, *other])
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(other))], "item_id long, text string")
    for i in (None, 5):
        found = contaminated(docs_of([(i, t) for t in [*decoys, leak, leak2]]), bench).collect()
        assert sorted((r["doc_id"], r["item_id"], r["similarity"]) for r in found) == [(i, 1, 1.0), (i, 2, 1.0)]
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = P.decontamination_stage(spark, docs_of([(None, t) for t in [*decoys, leak, leak2]]), str(tmp_path))
    assert sorted(r["text"] for r in kept.collect()) == sorted(decoys)


@pytest.mark.parametrize("broadcast", [decontam.BROADCAST_SHINGLES, 0])
def test_both_sizes_of_benchmark_against_brute_force(spark, docs_of, words_of, monkeypatch, broadcast):
    """Whole, edited, shifted and cut copies of items of several sizes; null and repeated ids; items of one id."""
    monkeypatch.setattr(decontam, "BROADCAST_SHINGLES", broadcast)
    r = random.Random(8)
    items = [(k, " ".join(words_of(n, 40 + k))) for k, n in enumerate((5, 9, 30, 31, 60, 60, 200))] + [(3, " ".join(words_of(45, 77))), (None, " ".join(words_of(33, 78)))]
    rows = []
    for i, (_, text) in enumerate(items):
        for edits in (0, 1, 1, 2, 5):
            w = text.split()
            for _ in range(edits):
                w[r.randrange(len(w))] = "zz"
            if edits == 2:
                w.insert(len(w) // 3, "more")
            rows.append((r.choice([i, 100 + i, None]), " ".join(words_of(r.randrange(50), i) + w + words_of(r.randrange(50), 90 + i))))
    rows += rows[:4] + [(200, items[4][1] + " " + items[4][1]), (201, "a b c d e " * 30), (202, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x["similarity"] for x in contaminated(docs_of(rows), bench).collect()}
    want = brute_contaminated(rows, items)
    assert got == pytest.approx(want) and len(want) >= 12
