"""Near copies and the pipeline's near-dedup stage against brute force over all pairs."""

import random
import re

import corpus_pipeline as P
from memloom.llm import jaccard


def brute_sets(texts):
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) for t in texts]
    return [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set() for w in words]


def brute_roots(texts):
    sets = brute_sets(texts)
    root = list(range(len(texts)))
    for a, x in enumerate(sets):
        for b in range(a):
            y = sets[b]
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    return root


def edited(words, places):
    out = list(words)
    for i in places:
        out[i] = f"new{i}"
    return " ".join(out)


def some(words_of):
    texts = []
    for k in range(6):
        base = words_of(200, 100 + k)
        r = random.Random(k)
        texts.append(" ".join(base))
        # One edit is about 0.95, four about 0.8, seven below it.
        texts += [edited(base, r.sample(range(5, 195), n)) for n in (1, 2, 3, 4, 4, 5, 7)]
    return [*texts, texts[0], texts[0].upper(), "", None, " \n", "one", "One", "one two three four", *[" ".join(words_of(60, 900 + i)) for i in range(10)]]


def partition(labels):
    groups = {}
    for i, x in enumerate(labels):
        groups.setdefault(x, set()).add(i)
    return sorted(map(sorted, groups.values()))


def test_near_copies_equal_brute_force(docs_of, words_of):
    texts = some(words_of)
    got = {r["jc_id"]: r["jc_root"] for r in jaccard.near_copies(docs_of(texts)).collect()}
    assert partition([got[i] for i in range(len(texts))]) == partition(brute_roots(texts))
    assert jaccard.near_copies(docs_of([])).count() == 0


def test_stage_drops_near_copies(spark, docs_of, words_of):
    texts = some(words_of)
    kept = sorted(r["doc_id"] for r in P.near_dedup_stage(spark, docs_of(texts), "").collect())
    assert kept == [g[0] for g in partition(brute_roots(texts))]


def test_stage_decides_per_row(spark, docs_of, words_of):
    a, b, c = (" ".join(words_of(80, 40 + i)) for i in range(3))
    rows = [(None, a), (None, a), (None, b), (1, b), (2, c), (2, a + " x"), (2, c)]
    got = sorted(((r["doc_id"], r["text"]) for r in P.near_dedup_stage(spark, docs_of(rows), "").collect()), key=str)
    assert got == sorted([(1, b), (2, c), (2, a + " x")], key=str)


def crowd(words_of):
    """Texts of which most are just below 0.8 of each other, with a partner of 0.8 for some."""
    base, r, texts = words_of(200, 77), random.Random(5), []
    for k in range(300):
        places = r.sample(range(5, 195), 3)
        words = [f"w{k}x{i}" if i in places else w for i, w in enumerate(base)]
        texts.append(" ".join(words))
        if k % 5 == 0:
            texts.append(edited(words, r.sample(range(5, 195), 4)))
    return texts


def test_no_partner_is_lost_in_a_crowd(docs_of, words_of, monkeypatch):
    texts = crowd(words_of)
    want = partition(brute_roots(texts))
    assert 60 < len(want) < 350
    got = {r["jc_id"]: r["jc_root"] for r in jaccard.near_copies(docs_of(texts)).collect()}
    assert partition([got[i] for i in range(len(texts))]) == want
    # Several homes a bucket, several copies of a home, and rounds before the visits.
    monkeypatch.setattr(jaccard, "HOME_SHINGLES", 4000)
    monkeypatch.setattr(jaccard, "HOME_VISITS", 10)
    monkeypatch.setattr(jaccard, "MANY_VISITS", 0)
    got = {r["jc_id"]: r["jc_root"] for r in jaccard.near_copies(docs_of(texts)).collect()}
    assert partition([got[i] for i in range(len(texts))]) == want


def test_only_texts_that_may_have_a_partner_are_counted_whole(spark, docs_of, words_of, monkeypatch):
    lonely = [" ".join(words_of(150, 2000 + i)) for i in range(60)]
    texts = [*some(words_of), *lonely]
    seen = []
    whole = jaccard._connected
    monkeypatch.setattr(jaccard, "_connected", lambda sets, percent: (seen.append(sets.count()), whole(sets, percent))[1])
    got = {r["jc_id"]: r["jc_root"] for r in jaccard.near_copies(docs_of(texts)).collect()}
    roots = brute_roots(texts)
    assert partition([got[i] for i in range(len(texts))]) == partition(roots)
    # All 48 texts of the six families at most, the three short ones and few of the 70 others.
    assert len({str(s) for s in brute_sets(texts)}) > 110 and seen[0] < 60
