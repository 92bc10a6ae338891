"""Substring, line and near dedup against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from memloom.operators.components import components
from memloom.llm.lines import chunk_ends, line_dedup
from memloom.llm.simhash import block_masks, near_links, simhash_dedup, spanning_links
from memloom.llm.simhash_kernel import fingerprint
from memloom.llm.substring import cover_for, difference_cover, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_substring(rows, n):
    texts = [(i, WORD.findall(t or "")) for i, t in rows]
    seen = Counter(tuple(w[p : p + n]) for _, w in texts for p in range(len(w) - n + 1))
    out = Counter()
    for i, w in texts:
        gone = [False] * len(w)
        for p in range(len(w) - n + 1):
            if seen[tuple(w[p : p + n])] > 1:
                gone[p : p + n] = [True] * n
        out[(i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))] += 1
    return out


@pytest.mark.parametrize("v", [1, 2, 7, 13, 21, 30])
def test_difference_cover(v):
    d = difference_cover(v)
    assert {(a - b) % v for a in d for b in d} == set(range(v)) and len(d) <= 2 * v**0.5 + 1


@pytest.mark.parametrize("n", [3, 12, 35])
def test_substring(docs_of, words_of, n):
    a, b, shared = words_of(150, 1), words_of(120, 2), words_of(n + 7, 3)
    rows = [
        (1, " ".join(a[:40] + shared + a[40:])), (2, "\n".join(b[:13] + shared + b[13:])), (3, " ".join(a)), (4, " ".join(a)), (4, " ".join(a)),
        (None, " ".join(b)), (5, None), (6, ""), (7, " \n "), (8, " ".join(shared[: n - 1])), (9, "la " * (n + 5)), (10, "a\u00a0b\u2003c " * n), (11, "é " * 3),
        (12, " ".join(words_of(3000, 9) + shared)),
    ]
    got = Counter(tuple(r) for r in substring_dedup(docs_of(rows), n).collect())
    assert got == brute_substring(rows, n)


def test_substring_properties(docs_of):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice("ab") for _ in range(r.randint(0, 60)))) for i in range(25)]
    assert Counter(tuple(x) for x in substring_dedup(docs_of(rows), 8).collect()) == brute_substring(rows, 8)


def test_substring_empty_and_clashing(docs_of, spark):
    assert substring_dedup(docs_of([]), 35).count() == 0
    d = docs_of(["x " * 40, "x " * 40]).withColumn("wl_row", F.lit("a")).withColumn("n_words", F.lit(None)).withColumn("wl_text", F.lit(1))
    assert [r["n_removed"] for r in substring_dedup(d, 35).collect()] == [40, 40]


def brute_print(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """Least id reachable, by search over all pairs."""
    n, label = len(prints), [i for i, _ in prints]
    for _ in range(n):
        for (a, (_, p)), (b, (_, q)) in itertools.permutations(enumerate(prints), 2):
            if (p ^ q).bit_count() <= 3:
                label[a] = min(label[a], label[b])
    return label


def test_simhash(docs_of, words_of):
    base = words_of(220, 5)
    rows = [(100 - i, " ".join(base[:i] + ["zz"] + base[i + 1 :])) for i in range(0, 30, 3)]
    rows += [(200, " ".join(base).upper()), (201, None), (202, ""), (203, "one"), (204, "One two"), (205, " \t"), (206, "É É x Y z"), (7, " ".join(base)), (7, " ".join(base))]
    rows += [(300 + i, " ".join(words_of(60, 50 + i))) for i in range(20)]
    got = sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash_dedup(docs_of(rows)).collect())
    prints = [(i, brute_print(t)) for i, t in rows]
    want = sorted((i, f"{p:016x}", c) for (i, p), c in zip(prints, brute_components(prints)))
    assert got == want and simhash_dedup(docs_of([])).count() == 0


def test_fingerprint_of_long_text(words_of):
    text = " ".join(words_of(9000, 8))
    assert fingerprint(text.encode()) == brute_print(text)


@pytest.mark.parametrize("limit", [2000, 2])
def test_links_hold_for_crowded_buckets(spark, limit):
    """With a tiny limit all buckets go through mid points: components stay the same."""
    r = random.Random(6)
    centre = [r.getrandbits(64) for _ in range(4)]
    prints = list({c ^ sum(1 << b for b in r.sample(range(64), k)) for c in centre for k in (0, 1, 2, 3, 5) for _ in range(6)} | {0, (1 << 64) - 1})
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "sh_print long")
    got = {r["node"] & (2**64 - 1): r["root"] for r in components(near_links(df, 3, 6, limit)).collect()}
    groups = {}
    for p, c in zip(prints, brute_components(list(enumerate(prints)))):
        groups.setdefault(c, set()).add(p)
    for g in groups.values():
        assert len({got.get(p, p) for p in g}) == 1
    assert len({got.get(p, ("own", p)) for p in prints}) == len(groups)


def test_masks_cover_every_near_pair():
    masks = block_masks(6, 3)
    r = random.Random(2)
    for _ in range(300):
        flip = sum(1 << b for b in r.sample(range(64), 3))
        assert any(flip & m == 0 for m in masks)


def test_spanning_links_chain():
    chain = np.array([0, 7, 63, 511], np.uint64)
    assert len(spanning_links(chain, 3)) == 3


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5), (None, 3), (101, 100)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert components(edges.where("false")).count() == 0


def brute_lines(rows):
    chunks, first = [], {}
    for k, (i, t) in enumerate(rows):
        lines, start = t.split("\n") if t is not None else [], 0
        for end in chunk_ends([x.encode() for x in lines]):
            chunks.append((i, start, k, "\n".join(lines[start:end]), end - start))
            start = end
    for i, s, k, t, n in sorted(chunks):
        if n > 1:
            first.setdefault(t, (i, s))
    gone = {}
    for i, s, k, t, n in chunks:
        if n > 1 and first[t] != (i, s):
            gone.setdefault(k, set()).update(range(s, s + n))
    return [
        (i, len(t.split("\n")) if t is not None else 0, len(gone.get(k, ())), None if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone.get(k, ())))
        for k, (i, t) in enumerate(rows)
    ]


def test_lines(docs_of, words_of):
    r = random.Random(3)
    pool = [" ".join(words_of(5, i)) for i in range(40)]
    shared = pool[:12]
    rows = [(i, "\n".join(r.sample(pool[12:], 5) + shared + r.sample(pool[12:], 4))) for i in range(12)]
    rows += [(20, "\n".join(shared * 2)), (21, None), (22, ""), (23, "one line"), (24, "\n\n\n"), (25, "\n".join(shared) + "\n"), (26, "\n".join(words_of(4000, 7)))]
    got = sorted((tuple(x) for x in line_dedup(docs_of(rows)).collect()), key=str)
    assert got == sorted(brute_lines(rows), key=str) and sum(x[2] for x in got) > 0


def test_line_boundaries_shift_with_the_text():
    lines = [hashlib.md5(bytes([i])).hexdigest().encode() for i in range(60)]
    ends = set(chunk_ends(lines))
    moved = {e - 3 for e in chunk_ends([b"x", b"y", b"z", *lines])}
    assert ends - {1, 2} <= moved | {60}


def test_lines_repeated_rows_empty_and_clashing(docs_of):
    text = "\n".join(f"line {i}" for i in range(9))
    same = line_dedup(docs_of([(1, text), (1, text)])).collect()
    assert [r["n_removed"] for r in same] == [0, 0]
    assert line_dedup(docs_of([])).count() == 0
    d = docs_of([(1, text), (2, text)]).withColumn("ln_row", F.lit(0)).withColumn("n_lines", F.lit("x"))
    assert sorted(r["n_removed"] for r in line_dedup(d, keep=("source",)).collect())[0] == 0
    assert line_dedup(d, keep=("source",)).columns == ["doc_id", "source", "n_lines", "n_removed", "kept_text"]


def test_cover_widths():
    for n in (2, 10, 35, 100):
        w, v, d = cover_for(n)
        assert w + v - 1 == n and w >= 1
