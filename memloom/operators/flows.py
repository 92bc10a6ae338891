"""Flows that ask a language model (``seams.Llm``). What they show it is bounded by a limit; replies are checked before use.

A reply that is empty or no JSON changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions import text as T
from memloom.operators import lookups as L
from memloom.operators import memory as M
from memloom.seams import Embedder, Llm, extract_json


def _shown(df: DataFrame, limit: int) -> list:
    """At most ``limit`` rows, for a prompt."""
    return df.limit(limit).collect()


def _cosine(a: Sequence[float], b: Sequence[float]) -> float:
    lengths = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    return sum(x * y for x, y in zip(a, b)) / lengths if lengths else 0.0


def duplicate_question(question: str, vec, earlier: list[str], earlier_vecs: list, accepted_vecs: list, threshold: float = 0.90) -> str | None:
    """Why a question repeats another one; None if it does not."""
    plain = question.strip().casefold()
    if any(e.strip().casefold() == plain for e in earlier):
        return "identical to earlier draft"
    for reason, vectors in (("close to earlier draft", earlier_vecs), ("close to another question", accepted_vecs)):
        if vec is not None and any(_cosine(vec, v) >= threshold for v in vectors):
            return reason
    return None


def rescored(drawers: DataFrame, llm: Llm, limit: int = 200, batch: int = 20) -> DataFrame:
    """``drawers`` with the greater of the heuristic and the model's importance, for the ``limit`` newest rows."""
    rows = _shown(drawers.orderBy(F.desc("mined_at"), "id").select("id", "content"), limit)
    scores: dict[str, float] = {}
    for i in range(0, len(rows), batch):
        part = rows[i : i + batch]
        reply = extract_json(llm.complete("Rate importance 0..1 as JSON {id: score}:\n" + "\n".join(f"{r['id']}: {r['content'][:500]}" for r in part)))
        known = {r["id"] for r in part}
        if isinstance(reply, dict):
            scores |= {k: min(1.0, max(0.0, float(v))) for k, v in reply.items() if k in known and isinstance(v, int | float)}
    found = drawers.sparkSession.createDataFrame(list(scores.items()), "id string, lk_score double")
    heuristic = T.importance(F.col("content"))
    out = drawers.join(F.broadcast(found), "id", "left")
    return out.withColumn("importance", F.when(F.col("lk_score").isNotNull(), F.greatest(heuristic, "lk_score")).otherwise(F.col("importance"))).select(*drawers.columns)


def confirmed_aliases(spark: SparkSession, groups: list[list[tuple[str, str, int]]], llm: Llm | None, kind: str = "entity", vocabulary: Sequence[str] = ()) -> DataFrame:
    """(alias, canonical) ids of candidate groups of (id, name, mentions).

    The model names the canonical form and its aliases; only names of the group count. Without a model the
    name of most mentions stands for all, the longest and then the first of equals.
    """
    out = []
    for group in groups:
        ids = {name: i for i, name, _ in group}
        if llm is None:
            best = min(group, key=lambda g: (-g[2], -len(g[1]), g[1]))[1]
            chosen, aliases = best, [n for n in ids if n != best]
        else:
            hint = f" Prefer one of: {', '.join(vocabulary)}." if vocabulary else ""
            reply = extract_json(llm.complete(f"Which of these {kind} names mean the same? Reply as JSON with canonical and aliases.{hint}\n{json.dumps(list(ids))}"))
            reply = reply if isinstance(reply, dict) else {}
            chosen, aliases = reply.get("canonical"), reply.get("aliases") or []
        out += [(ids[a], ids[chosen]) for a in aliases if chosen in ids and a in ids and a != chosen]
    return spark.createDataFrame(out, "alias string, canonical string")


def evaluate_calls(calls: DataFrame, tool: str, llm: Llm, wing: str | None = None, limit: int = 100) -> DataFrame:
    """``calls`` with the model's verdicts on those not summarised yet."""
    verdicts = []
    for r in _shown(L.unsummarized(calls, tool, wing), limit):
        reply = extract_json(llm.complete(f"Judge this call of {tool} as JSON with score and summary.\n{r['input_json']}\n{r['output_json']}"))
        if isinstance(reply, dict) and isinstance(reply.get("score"), int | float):
            verdicts.append((r["id"], float(reply["score"]), str(reply.get("summary") or "")))
    return L.evaluated(calls, calls.sparkSession.createDataFrame(verdicts, "id string, score double, summary string"))


def summarize_tool(calls: DataFrame, tool: str, llm: Llm, wing: str | None = None, latest: int = 20, least: int = 3) -> tuple[str | None, DataFrame]:
    """(guidelines, calls): guidelines from the latest calls of a tool, ``least`` at least; those calls count as summarised then."""
    calls = evaluate_calls(calls, tool, llm, wing)
    recent = L.newest(calls, latest, "called_at", wing=wing, tool_name=tool)
    rows = _shown(recent, latest)
    if len(rows) < least:
        return None, calls
    s = M.tool_statistics(recent, None).first()
    history = "\n".join(f"- {r['input_json']} -> {r['summary'] or r['output_json']}" for r in rows)
    text = llm.complete(f"Write guidelines for {tool}: {s['rate']:.0%} of {s['total']} calls succeed, {s['avg_seconds']:.2f} s, {s['avg_tokens']} tokens.\n{history}").strip()
    if not text:
        return None, calls
    ids = calls.sparkSession.createDataFrame([(r["id"],) for r in rows], "id string")
    return text, L.summarized(calls, ids)


def reflect(drawers: DataFrame, drafts: DataFrame, search, embedder: Embedder, llm: Llm, wing: str, lookback: int = 30, earlier: int = 50) -> DataFrame:
    """New drafts (rows of ``drafts``) on up to three questions about the latest rows of a wing.

    ``search(question)`` gives evidence rows (id, content), of which eight are shown. Questions that repeat earlier ones
    are left out. Citations must be among the rows shown; without a valid one the first five stand.
    """
    spark = drawers.sparkSession
    rows = _shown(drawers.where("drawer_type = 'source'").orderBy(F.desc("mined_at"), "id").select("id", "content"), lookback)
    none = spark.createDataFrame([], drafts.schema)
    if len(rows) < 5:
        return none
    listed = "\n".join(f"{i}. [{r['id'][:8]}] {r['content'][:200]}" for i, r in enumerate(rows, 1))
    reply = extract_json(llm.complete(f'Ask the three most telling questions about these observations of {wing}, as JSON {{"questions": [...]}}.\n{listed}'))
    questions = [str(q) for q in (reply.get("questions") if isinstance(reply, dict) else None) or [] if str(q).strip()][:3]
    before = [r["question"] for r in _shown(L.newest(drafts, earlier, "created_at", wing=wing).select("question"), earlier)]
    before_vecs, accepted, out = embedder.embed(before) if before else [], [], []
    for q, vec in zip(questions, embedder.embed(questions) if questions else []):
        if duplicate_question(q, vec, before, before_vecs, accepted):
            continue
        accepted.append(vec)
        shown = _shown(search(q).select("id", "content"), 8)
        answer = extract_json(llm.complete(f"Answer from the evidence as JSON with answer and citations.\n{q}\n" + "\n".join(f"[{r['id']}] {r['content'][:500]}" for r in shown)))
        if not isinstance(answer, dict) or not str(answer.get("answer") or "").strip():
            continue
        ids = [r["id"] for r in shown]
        cited = [c for c in answer.get("citations") or [] if c in ids] or ids[:5]
        out.append((wing, q, str(answer["answer"]), cited))
    if not out:
        return none
    new = spark.createDataFrame(out, "wing string, question string, answer string, cited array<string>")
    fields = {"id": T.short_hash(F.col("wing"), F.col("question")), "citations": F.array_join("cited", ","), "status": F.lit("pending"), "created_at": F.current_timestamp()}
    return new.select(*[fields.get(f.name, F.col(f.name) if f.name in new.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in drafts.schema])


def accepted_draft(drafts: DataFrame, draft_id: str, llm: Llm) -> tuple[DataFrame, DataFrame]:
    """(drafts, triples): the draft's status becomes accepted, and plausible triples are drawn from its answer."""
    spark, row = drafts.sparkSession, L.by_key(drafts, draft_id).first()
    none = spark.createDataFrame([], "subject string, predicate string, object string")
    if row is None:
        return drafts, none
    reply = extract_json(llm.complete(f"List facts as JSON [[subject, predicate, object], ...].\n{row['answer']}"))
    facts = [tuple(map(str, f)) for f in reply if isinstance(f, list) and len(f) == 3] if isinstance(reply, list) else []
    change = spark.createDataFrame([(draft_id, "accepted")], "id string, status string")
    from memloom.operators.graph import plausible

    return L.changed(drafts, change, "status"), plausible(spark.createDataFrame(facts, none.schema))


def distilled(trajectories: DataFrame, llm: Llm, wing: str, least: float = 0.5, limit: int = 50) -> DataFrame:
    """Validated task memories from trajectories (query, id, score, success, steps).

    Three lessons are asked for: of successes, of failures, and of the best against the worst run of one query.
    """
    spark, asked = trajectories.sparkSession, []
    for ok, word in ((True, "succeeded"), (False, "failed")):
        asked += [f"What should be kept of this run that {word}?\n{r['query']}\n{r['steps']}" for r in _shown(trajectories.where(F.col("success") == ok).orderBy("query", "id"), limit)]
    pairs = M.best_and_worst(trajectories, "query", "score", "id")
    steps = trajectories.select("id", "steps")
    both = pairs.join(steps.toDF("best", "good"), "best").join(steps.toDF("worst", "bad"), "worst").orderBy("query")
    asked += [f"Why was the first run better?\n{r['query']}\n{r['good']}\n{r['bad']}" for r in _shown(both, limit)]
    drafts = []
    for prompt in asked:
        reply = extract_json(llm.complete(prompt))
        for m in reply if isinstance(reply, list) else [reply] if isinstance(reply, dict) else []:
            if isinstance(m, dict) and m.get("when_to_use") and m.get("content"):
                score = float(m.get("score") or 0)
                drafts.append((str(m["when_to_use"]), str(m["content"]), score, float(m.get("judge_score") or score), bool(m.get("valid", True))))
    found = spark.createDataFrame(drafts, "when_to_use string, content string, score double, judge_score double, valid boolean")
    good = M.validated(found, least).where("passed")
    rows = good.select(T.short_hash(F.col("when_to_use"), F.col("content")).alias("id"), F.lit(wing).alias("wing"), "when_to_use", "content", "score")
    return rows.groupBy("id").agg(*[F.first(c).alias(c) for c in ("wing", "when_to_use", "content")], F.max("score").alias("score"))


def refined(failed: str, retry: str | None, llm: Llm) -> list[dict]:
    """Lessons of a failed run, only where a later try succeeded."""
    if retry is None:
        return []
    reply = extract_json(llm.complete(f"What did the retry change?\n{failed}\n{retry}"))
    return [m for m in (reply if isinstance(reply, list) else [reply]) if isinstance(m, dict) and m.get("content")]


def optimized_skill(skill: str, train: Sequence, held: Sequence, precision, llm: Llm, epochs: int = 3, budget: int = 4) -> str:
    """A skill text after rounds of edits proposed from training questions; an edit stays only if precision on held ones rises.

    ``precision(text, questions)`` measures a text. At most ``budget`` edits a round.
    """
    from memloom.seams import apply_edits

    best = precision(skill, held)
    for _ in range(epochs):
        edits = extract_json(llm.complete(f"Improve this text by edits as JSON [{{op, old, new}}]; it scores {precision(skill, train):.2f}.\n{skill}"))
        tried = apply_edits(skill, [e for e in edits if isinstance(e, dict)][:budget]) if isinstance(edits, list) else skill
        score = precision(tried, held)
        if score > best:
            skill, best = tried, score
    return skill
