import hashlib
import re

from memloom import seams
from memloom.sources import ingest as I


def plain(texts, dim):
    """Word by word, as the vectors are defined."""
    out = []
    for text in texts:
        v = [0.0] * dim
        for word in re.findall(r"\w+", text.lower()):
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
            v[h % dim] += 1.0 if h >> 63 else -1.0
        n = sum(x * x for x in v) ** 0.5
        out.append([x / n for x in v] if n else v)
    return out


def test_vectors_and_hashes_made_once(monkeypatch):
    texts = ["the cat the dog", "", "...", "Ünder_score 12 İx ΣΑΣ", "word " * 700, "a b a b"]
    for dim in (1, 7, 64):
        assert seams.HashingEmbedder(dim).embed(texts) == plain(texts, dim)
    assert seams.HashingEmbedder().embed([]) == []
    made = []
    monkeypatch.setattr(seams.hashlib, "blake2b", lambda *a, f=hashlib.blake2b, **k: made.append(1) or f(*a, **k))
    seams.HashingEmbedder().embed(["onlyheremet " * 500] * 3)
    assert len(made) == 1


def test_chunks_of_many_rows_go_together(spark, monkeypatch):
    monkeypatch.setattr(I, "SENT_CHARS", 50)
    rows = [(i, f"# h{i}\n" + "x" * i) for i in range(40)] + [(99, None), (100, " ")]
    got = I.structural_chunks(spark.createDataFrame(rows, "i long, t string").coalesce(1), "i", "t").collect()
    assert sorted((r["i"], r["ord"], r["chunk"]) for r in got) == [(i, 0, t.strip()) for i, t in rows[:40]]
