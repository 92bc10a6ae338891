"""Runs of repeated lines against brute force."""

import random

import corpus_pipeline as P
from memloom.llm.lines import line_dedup


def brute_runs(rows):
    """What is left of each text if all lines go that lie in a run of two or more lines standing at an earlier place."""
    seen, out = set(), []
    for i, text in rows:  # by id
        lines = text.split("\n")
        gone = set()
        for k in range(len(lines) - 1):
            pair = (lines[k], lines[k + 1])
            if not "".join(pair).strip():
                continue
            if pair in seen:
                gone |= {k, k + 1}
            seen.add(pair)
        out.append((i, len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return out


def some(words_of):
    r = random.Random(8)
    pool = [" ".join(words_of(6, i)) for i in range(60)]
    rows = []
    for i in range(30):  # short texts with a passage of two to four lines of an earlier place
        at = r.randrange(50)
        rows.append((i, "\n".join([f"own {i} a", *pool[at : at + r.randint(2, 4)], f"own {i} b"])))
    return [*rows, (40, "one line"), (41, "one line"), (42, ""), (43, "\n\n\n"), (44, "\n\n\n"), (45, "x\nx\nx\nx"), (46, "own 0 a\n\nother")]


def test_runs_equal_brute_force(docs_of, words_of):
    rows = some(words_of)
    got = sorted((r["doc_id"], r["n_removed"], r["kept_text"]) for r in line_dedup(docs_of(rows), runs=True).collect())
    assert got == brute_runs(rows) and sum(x[1] for x in got) > 20


def test_stage_removes_whole_runs(spark, docs_of, words_of):
    rows = some(words_of)
    got = {r["doc_id"]: r["text"] for r in P.line_stage(spark, docs_of(rows), "").collect()}
    assert got == {i: t for i, n, t in brute_runs(rows) if t.strip() or not n}
