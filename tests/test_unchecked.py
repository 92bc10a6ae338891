"""Queries beyond SQL against plain computations on the smallest tables."""

import numpy as np

from memloom.plans import registry
from memloom.sources import ingest as I


def unit_vectors(spark, data):
    rows = sorted((r["vec_id"], np.array(r["embedding"], float)) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect())
    x = np.stack([v for _, v in rows])
    return [i for i, _ in rows], x, x / np.linalg.norm(x, axis=1, keepdims=True)


def test_anchor_grouping(spark, data):
    ids, _, u = unit_vectors(spark, data)
    s = np.round(u @ u.T, 6)
    free, want = set(range(len(ids))), set()
    for i in range(len(ids)):
        if i in free:
            free.discard(i)
            near = sorted((j for j in free if s[i, j] >= 0.35), key=lambda j: (-s[i, j], j))[:16]
            free -= set(near)
            want |= {(ids[i], ids[j]) for j in [i, *near]}
    assert {(r["anchor"], r["id"]) for r in registry.queries()["anchor_grouping"](spark, data).collect()} == want


def test_prune_report(spark, data):
    ids, x, u = unit_vectors(spark, data)
    s, root = u @ u.T, list(range(len(ids)))
    for i, j in zip(*np.nonzero(np.round(s, 6) >= 0.4)):
        if root[i] != root[j]:
            old, new = max(root[i], root[j]), min(root[i], root[j])
            root = [new if r == old else r for r in root]
    kept = 0
    for c in set(root):
        m = [i for i, r in enumerate(root) if r == c]
        part = u[m]
        d_bar = 0.0 if len(m) < 2 else 1 - ((part @ part.T).sum() - len(m)) / (len(m) * (len(m) - 1))
        wanted = 1 if d_bar < 0.6 else min(len(m), int(np.ceil(d_bar / 0.6)))
        taken = [int(np.argmax(np.round(part @ part.mean(0), 12)))]
        while len(taken) < wanted:
            far = (1 - part @ part[taken].T).min(1)
            far[taken] = -1
            taken.append(int(np.argmax(far)))
        kept += len({m[t] for t in taken} | {i for i in m if ids[i] % 5 >= 3})
    got = registry.queries()["prune_report"](spark, data).first()
    assert (got["clusters"], got["kept"], got["retired"]) == (len(set(root)), kept, len(ids) - kept)


def test_chunks_of_documents(spark, data):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for name, most in (("chunks_structural", lambda c: len(c) <= 1200), ("chunks_topic_shift", lambda c: I.count_tokens(c) <= 1810)):
        parts: dict = {}
        for r in registry.queries()[name](spark, data).collect():
            parts.setdefault(r["doc_id"], []).append((r["ord"], r["chunk"]))
        assert {i for i, t in texts.items() if t.strip()} == set(parts)
        for i, p in parts.items():
            chunks = [c for _, c in sorted(p)]
            assert "".join("".join(chunks).split()) == "".join(texts[i].split()) and all(map(most, chunks)), (name, i)
    cut = sum(len(p) > 1 for p in parts.values())
    assert cut > len(parts) / 4  # topic shifts cut texts far under the cap


def test_part_starts():
    text = "# One\n\npublic sealed class A\n  record B\nplain\n\n\nmore\n---\n#region x\n//////\n\n"
    assert [text[p:].split("\n")[0] for p in I.part_starts(text)] == ["# One", "", "public sealed class A", "record B", "", "---", "#region x", "//////"]
    assert I.part_starts("fn a\ndef b\n-- x\n#no") == [0, 5]
    by_tokens = I.structural("word. " * 3000, 64, 512, 1024, I.count_tokens)
    assert all(I.count_tokens(c) <= 1024 for c in by_tokens) and len(by_tokens) > 4
