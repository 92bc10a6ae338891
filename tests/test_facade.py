"""The composed calls of the facade, flows with a canned model, and MMR and hybrid search against plain computations."""

import math
import re

import numpy as np
from pyspark.sql import functions as F

from memloom.api import MemoryStore
from memloom.operators import flows
from memloom.operators import retrieval as R
from memloom.plans import registry
from memloom.plans.search_queries import TERMS
from memloom.seams import CannedLlm, HashingEmbedder

ROWS = "wing string, room string, content string, source string"
LONG = "We decided to keep the search index in memory because the latency budget is critical for every request we serve. "


def filled(spark, tmp_path):
    p = MemoryStore(spark, str(tmp_path / "m"))
    texts = ["alpha storage", "bravo compaction with Engine.Core", "carol scheduling", "delta retry policy", "echo tracing", "fox metrics"]
    out = p.add_memories(spark.createDataFrame([("w", "attempts" if i == 5 else "r", f"{LONG} {t} " * (i + 1), None) for i, t in enumerate(texts)], ROWS), "source")
    return p, out


def test_admission_tells_near_duplicates(spark, tmp_path):
    p = MemoryStore(spark, str(tmp_path / "m"))
    batch = spark.createDataFrame([("w", "r", LONG + "alpha", None), ("w", "r", LONG + "alpha.", None), ("w", "r", "short", None)], ROWS)
    got = sorted((r["admitted"], r["reason"] or "") for r in p.add_memories(batch).collect())
    assert got == [(False, "content too short"), (False, "near_duplicate"), (True, "")]
    again = p.add_memories(spark.createDataFrame([("w", "r", LONG + "alpha!", None)], ROWS)).first()
    assert again["reason"] == "near_duplicate" and again["duplicate_of"] == p.drawers().first()["id"] and p.drawers().count() == 1


def test_search_wake_up_and_pages(spark, tmp_path):
    p, _ = filled(spark, tmp_path)
    found = p.search("bravo compaction Engine.Core", "w", k=3, as_of="2030-01-01").collect()
    assert len(found) == 3 and "bravo" in found[0]["content"] and [r["position"] for r in found] == [1, 2, 3]
    assert {r["room"] for r in p.search("metrics", "w", "attempts", k=3).collect()} == {"attempts"}
    top = found[0]["id"]
    assert p.write_page("Topic/Index", "w", "Index", "About [[topic/other]] and more.", [top], "me") == "created"
    assert p.write_page("topic/index", "w", "Index", "About [[topic/other]].", [top]) == "updated"
    assert p.page("topic/index").first()["citations"] == [top] and p.pages("w").count() == 1 and p.page_log().count() == 2
    pack = p.wake_up("w", "bravo compaction").collect()
    assert [r["ord"] for r in pack] == list(range(1, len(pack) + 1)) and {"attempts", "pages", "recent"} <= {r["layer"] for r in pack}
    assert p.guidance("w", None) == "proceed" and p.guidance("w", "zzz qqq") == "verify"
    assert p.get(top).first()["id"] == top and p.store.read("access_events").where(F.col("id") == top).count() >= 2
    assert p.summary_of(top).count() == 1 and p.around("bravo compaction", "w", 1).count() >= 2


def test_flows(spark, tmp_path):
    p, _ = filled(spark, tmp_path)
    calls = [(f"c{i}", "w", "grep", "{}", "out", i % 2 == 0, None, None, 10, 1.0, False) for i in range(4)]
    schema = "id string, wing string, tool_name string, input_json string, output_json string, success boolean, score double, summary string, token_cost int, time_seconds double, is_summarized boolean"
    p.record_call(spark.createDataFrame(calls, schema).withColumn("called_at", F.current_timestamp()))
    llm = CannedLlm({"Judge": '{"score": 0.7, "summary": "fine"}', "guidelines": "Use it.", "three most": '{"questions": ["Why memory?", "why memory? ", "What next?"]}',
                     "Answer": '{"answer": "Latency.", "citations": ["nope"]}', "List facts": '[["app", "uses", "index"], ["x", "y"]]'})
    assert p.summarize_tool("grep", llm, "w") == "Use it."
    rows = p.table("tool_call_history").collect()
    assert all(r["is_summarized"] and r["score"] == 1.0 and r["summary"] == "fine" for r in rows) and p.guidelines("grep", "w").count() == 1
    assert p.summarize_tool("other", llm, "w") is None
    drafts = p.reflect("w", llm).collect()
    assert len(drafts) == 2 and all(len(d["citations"].split(",")) == 5 for d in drafts) and p.reflect("w", llm).count() == 0
    p.accept_draft(drafts[0]["id"], llm)
    assert p.drafts("w").count() == 1 and p.table("triples").first()["predicate"] == "uses"
    groups = [[("1", "App", 3), ("2", "the app", 1)]]
    assert [tuple(r) for r in flows.confirmed_aliases(spark, groups, None).collect()] == [("2", "1")]
    named = CannedLlm({"App": '```json\n{"canonical": "the app", "aliases": ["App", "unknown"]}\n```'})
    assert [tuple(r) for r in flows.confirmed_aliases(spark, groups, named).collect()] == [("1", "2")]
    assert flows.refined("f", None, llm) == [] and flows.duplicate_question("A ", None, ["a"], [], []) == "identical to earlier draft"
    runs = spark.createDataFrame([("q", 1, 0.9, True, "s1"), ("q", 2, 0.1, False, "s2")], "query string, id int, score double, success boolean, steps string")
    lesson = CannedLlm({"q": '{"when_to_use": "w", "content": "c", "score": 0.8}'})
    assert [r["score"] for r in flows.distilled(runs, lesson, "w").collect()] == [0.8]
    rated = flows.rescored(p.drawers("w"), CannedLlm({"Rate": "{" + ", ".join(f'"{r["id"]}": 2' for r in p.drawers("w").collect()) + "}"}))
    assert {r["importance"] for r in rated.collect()} == {1.0}
    edit = CannedLlm({"Improve": '[{"op": "ADD", "new": "good"}]'})
    assert flows.optimized_skill("a", [1], [1], lambda text, _: float("good" in text), edit) == "a\ngood"
    found = spark.createDataFrame([("/s/a", "a", "does a", 1)], "folder_path string, name string, description string, skill_md_mtime long")
    assert [r["action"] for r in p.reindex_skills(found, "w").collect()] == ["added"] and p.skill("a").count() == 1
    assert [r["action"] for r in p.reindex_skills(found.where("false"), "w").collect()] == ["removed"] and p.table("skills").count() == 0
    assert p.resolve_entities([]) == 0


def plain_mmr(rows, k, weight):
    """(id, position) greedily, from (id, score, vector) in falling order of score."""
    left = sorted(rows, key=lambda r: (-r[1], r[0]))
    unit = {r[0]: (np.asarray(r[2]) / np.linalg.norm(r[2]) if r[2] is not None else None) for r in left}

    def near(a, b):
        return 0.0 if unit[a] is None or unit[b] is None else float(unit[a] @ unit[b])

    taken = [left.pop(0)]
    while len(taken) < k and left:
        value = [weight * r[1] - (1 - weight) * max(0.0, *[near(r[0], t[0]) for t in taken]) for r in left]
        taken.append(left.pop(max(range(len(left)), key=lambda i: (value[i], -i))))
    return [(r[0], i) for i, r in enumerate(taken, 1)]


def test_mmr_and_hybrid_queries(spark, data):
    vecs = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()}
    cos = {i: float(v @ vecs[0] / np.linalg.norm(v) / np.linalg.norm(vecs[0])) for i, v in vecs.items()}
    rows = sorted(((i, round(c, 6), vecs[i]) for i, c in cos.items() if i), key=lambda r: (-r[1], r[0]))[:60]
    got = sorted((r["position"], r["id"]) for r in registry.queries()["mmr_rerank"](spark, data).collect())
    assert [(i, p) for p, i in got] == plain_mmr(rows, 10, 0.5)

    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    terms = {i: [t for t in re.split("[^a-z0-9_\x80-\U0010ffff]+", r["text"].lower()) if t] for i, r in docs.items()}
    mean = sum(map(len, terms.values())) / len(docs)
    df = {t: sum(t in x for x in terms.values()) for t in TERMS}
    words = {}
    for i, x in terms.items():
        s = [math.log((len(docs) - df[t] + 0.5) / (df[t] + 0.5) + 1) * (f := x.count(t)) * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(x) / mean)) for t in TERMS if t in x]
        if s:
            words[i] = sum(s)
    channels = [sorted(words, key=lambda i: (-words[i], i))[:200], sorted((i for i in docs if i in cos), key=lambda i: (-cos[i], i))[:200]]
    fused = {}
    for c in channels:
        for rank, i in enumerate(c):
            fused[i] = fused.get(i, 0) + 1 / (61 + rank)
    low, high = min(fused.values()), max(fused.values())
    score = {}
    for i, s in fused.items():
        worth = min(1.0, docs[i]["n_chars"] / 10000)
        score[i] = (s - low) / (high - low) + (0.1 * worth if 0 < worth != 1 else 0)
    want = plain_mmr([(i, s, vecs.get(i)) for i, s in score.items()], 10, 0.5)
    got = sorted((r["position"], r["id"]) for r in registry.queries()["hybrid_search"](spark, data).collect())
    assert [(i, p) for p, i in got] == want


def test_indexed_search_equals_bm25(spark):
    docs = spark.createDataFrame([("a", "the cat sat"), ("b", "the dog and the cat"), ("c", ""), ("d", None), ("e", "éclair cat")], "id string, text string")
    direct = {r["id"]: r["score"] for r in R.bm25(docs.where("text is not null"), "the cat éclair").collect()}
    known = docs.where("text is not null")
    by_index = {r["id"]: r["score"] for r in R.indexed(R.postings(known, "id", "text"), R.corpus_stats(known, "text"), "the cat éclair").collect()}
    assert direct.keys() == by_index.keys() == {"a", "b", "e"} and all(abs(direct[i] - by_index[i]) < 1e-12 for i in direct)
    assert HashingEmbedder().count_tokens("abcd") == 1
