import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from memloom import seams
from memloom.api import MemoryStore
from memloom.sources import ingest as I
from memloom.sources import store as S
from memloom.streaming import ingest as SI


def test_frontmatter():
    text = '---\ntype: Service\ntitle: "My `x`"\ntags:\n- a\n  - b\ndescription: >\n  folded\n  text\nextra: 1\n---\n\nBody'
    fields, body = I.parse_frontmatter(text)
    assert fields == {"type": "Service", "title": "My `x`", "tags": ["a", "b"], "description": "folded text", "extra": "1"} and body == "Body"
    assert I.parse_frontmatter("no header") == ({}, "no header")
    assert I.parse_frontmatter("---\ntype:\n---\nx")[0] == {"type": ""}


def test_links():
    body = "[a](../ops/run.md) [u](https://x.y/z.md) [s](#top)\n# Citations\n[c](b.md)"
    assert I.rewrite_links(body, "dev/sub") == "[[dev/ops/run]] [u](https://x.y/z.md) [s](#top)\n# Citations\n[c](b.md)"


def test_bundle_and_triples(spark, tmp_path):
    (tmp_path / "dev").mkdir()
    (tmp_path / "dev" / "pipe.md").write_text("---\ntype: Tool\ntags: [x, y]\n---\nSee [r](run.md)")
    (tmp_path / "index.md").write_text("skip")
    b = I.read_bundle(spark, str(tmp_path))
    r = b.first()
    assert b.count() == 1 and r["path"] == "dev/pipe" and r["body"] == "See [[dev/run]]"
    assert {(t["predicate"], t["object"]) for t in I.bundle_triples(b).collect()} == {("has_type", "Tool"), ("tagged", "x"), ("tagged", "y")}


def test_skill_issues():
    assert I.skill_issues("my-skill", {"name": "my-skill", "description": "does it"}) == []
    assert len(I.skill_issues("other", {"name": "My Skill", "description": "<b>"})) == 3


def test_files(spark, tmp_path):
    for name in ("a.py", "b.png", "node_modules/x.js", "c.min.js", "yarn.lock"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text("text")
    assert [r["source"].rsplit("/", 1)[1] for r in I.read_files(spark, str(tmp_path)).collect()] == ["a.py"]


def test_turns(spark):
    df = spark.createDataFrame([(1, '[{"content":"hi"},{"content":""},{"x":1}]'), (2, "plain")], "id long, j string")
    assert sorted((r["id"], r["content"]) for r in I.conversation_turns(df, "j", "id").collect()) == [(1, "hi"), (2, "plain")]


def test_facts(spark):
    text = "Parse(x) takes 3 args. DuckDB v1.5.3 here. Server port: 5432. Client timeout: 30s"
    df = spark.createDataFrame([(1, text), (2, None), (3, "returns int. Then Run (y) was slow; its, well, long timeout: 5 min and port 8080 port 9090"), (4, "port: 80")], "id long, t string")
    got = {(r["id"], r["subject"], r["predicate"], r["object"]) for r in I.numeric_facts(df, "id", "t", F.lit("room")).collect()}
    want = {(1, "Parse", "has_param_count", "3"), (1, "DuckDB", "has_version", "1.5.3"), (1, "Server", "uses_port", "5432"), (1, "Client", "has_timeout", "30s")}
    assert want <= got
    assert {x for x in got if x[0] > 1} == {
        (3, "unknown", "returns_type", "int"), (3, "long", "has_timeout", "5min"), (3, "and", "uses_port", "8080"), (3, "8080", "uses_port", "9090"), (4, "room", "uses_port", "80"),
    }


@pytest.mark.parametrize("most", [100, 400, 1800])
def test_chunks_stay_under_the_cap(most):
    text = "".join(f"public class C{i} {{ void M{i}() {{ return {i}; }} }}\n" for i in range(900))
    chunks = I.topic_chunks(text, least=20, target=80, most=most)
    assert len(chunks) > 1 and all(I.count_tokens(c) <= most + 10 for c in chunks)
    assert "".join("".join(chunks).split()) == "".join(text.split())


def test_topics_split():
    axes = {"alpha": [1.0, 0, 0], "bravo": [0, 1.0, 0], "carol": [0, 0, 1.0]}
    text = " ".join(f"{t} sentence number {i} is long enough to count." for t in axes for i in range(20))
    chunks = I.topic_chunks(text, lambda s: [next(v for k, v in axes.items() if k in x) for x in s], least=10, target=5000, most=9000)
    assert len(chunks) == 3


def test_structural():
    text = "\n".join(f"def f{i}():\n    return {i} * {i}" + " # pad" * 10 for i in range(80))
    chunks = I.structural(text)
    assert len(chunks) > 1 and all(len(c) <= 1200 for c in chunks) and I.structural("") == []


def test_upsert_and_retire(spark):
    t = spark.createDataFrame([(1, "a", True), (2, "b", True)], "id long, v string, is_representative boolean")
    n = spark.createDataFrame([(2, "x", True), (3, "y", True)], "id long, v string, is_representative boolean")
    assert {(r["id"], r["v"]) for r in S.upsert(t, n).collect()} == {(1, "a"), (2, "x"), (3, "y")}
    assert {(r["id"], r["v"]) for r in S.insert_absent(t, n).collect()} == {(1, "a"), (2, "b"), (3, "y")}
    r = S.retire(t, spark.createDataFrame([(2,)], "id long"))
    assert r.count() == 2 and {x["id"] for x in r.where("is_representative").collect()} == {1}
    with pytest.raises(ValueError):
        S.verify_schema(t, "id long, w string")


def test_memories_round_trip(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text(json.dumps({"id": "1", "content": "c"}) + "\n")
    r = I.import_memories(spark, str(tmp_path / "m.jsonl")).first()
    assert (r["score"], r["author"], r["source"]) == (0.8, "imported", "success")


def test_memory_store(spark, tmp_path):
    p = MemoryStore(spark, str(tmp_path / "memories"))
    text = "We decided to keep the search index in memory because the latency budget is critical for every request we serve. "
    rows = [("w", "r", text + "alpha", None), ("w", "r", "The bravo storage engine runs its compaction every night, and this is essential for the size of the files that it writes.", None), ("w", "r", "short", None)]
    out = p.add_memories(spark.createDataFrame(rows, "wing string, room string, content string, source string"))
    assert [r["reason"] for r in out.collect()].count("content too short") == 1
    assert p.drawers("w").count() == 2
    found = p.search("bravo compaction", "w", as_of="2030-01-01").collect()
    assert found and "bravo" in found[0]["content"]
    assert p.wake_up("w", "alpha").count() >= 1
    assert p.grep("compaction").count() == 1
    p.add_triples(spark.createDataFrame([("app", "requires", "lib", dt.date(2020, 1, 1), 0.9, "d")], "subject string, predicate string, object string, valid_from date, confidence double, drawer_id string"))
    assert p.entity("app", "2021-01-01").first()["predicate"] == "depends_on"


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [{"wing": "w", "room": "r", "content": c, "mined_at": "2024-01-01T00:00:00"} for c in ("one", "two", "one")]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, lines)))
    store = S.Store(spark, str(tmp_path / "s"))
    for _ in range(2):
        rows = SI.stream_json(spark, str(tmp_path / "in"), "wing string, room string, content string, mined_at timestamp")
        SI.ingest_into(store, "drawers", rows, str(tmp_path / "cp")).awaitTermination(120)
    assert store.read("drawers").count() == 2


def test_seams():
    assert seams.extract_json('x ```json\n{"a": [1]}\n``` y') == {"a": [1]}
    assert seams.extract_json("so [1, 2] it is") == [1, 2] and seams.extract_json("none") is None
    assert seams.apply_edits("a\nb", [{"op": "DELETE", "old": "a"}, {"op": "ADD", "new": "c"}, {"op": "REPLACE", "old": "b", "new": "d"}]) == "d\nc"
