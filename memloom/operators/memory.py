"""Task memories, tool calls, episodes, skills and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions import text as T
from memloom.operators.retrieval import vector_topk


def recall(memories: DataFrame, query_vec, k: int = 5) -> DataFrame:
    """The k nearest of the 3 k fetched."""
    return vector_topk(memories, query_vec, 3 * k).orderBy(F.desc("score"), "id").limit(k)


def reranked(candidates: DataFrame, k: int, sim: str = "similarity", worth: str = "worth", age: str = "age_days") -> DataFrame:
    """0.6 similarity + 0.3 worth + 0.1 recency."""
    score = 0.6 * F.col(sim) + 0.3 * F.col(worth) + 0.1 * F.exp(-F.col(age) / 30.0)
    return candidates.withColumn("score", score).orderBy(F.desc("score"), "id").limit(k)


def find_episodes(episodes: DataFrame, query_vec, k: int = 5, floor: float = 0.55, bonus: float = 0.05) -> DataFrame:
    """Nearest k, then those at the floor or above; failures gain a bonus without another sort."""
    near = vector_topk(episodes, query_vec, k).where(F.col("score") >= floor)
    return near.withColumn("score", F.col("score") + F.when(F.col("outcome") == "failure", bonus).otherwise(0.0))


def find_skills(skills: DataFrame, query_vec, k: int = 5, floor: float = 0.50, weight: float = 0.10) -> DataFrame:
    """Nearest k at the floor or above, raised by their Laplace success rate and sorted again."""
    near = vector_topk(skills, query_vec, k).where(F.col("score") >= floor)
    rate = T.laplace(F.col("success_count"), F.col("fail_count"))
    return near.withColumn("score", F.col("score") + weight * rate).orderBy(F.desc("score"), "id")


def prunable(memories: DataFrame, least: int = 5, share: float = 0.5):
    return (F.col("retrieval_count") >= least) & (F.col("utility_count") / F.col("retrieval_count") < share)


def pruned(memories: DataFrame, least: int = 5, share: float = 0.5) -> DataFrame:
    return memories.where(~F.when(F.col("retrieval_count") > 0, prunable(memories, least, share)).otherwise(False))


def counters(events: DataFrame, id_col: str, kinds: dict[str, str], kind_col: str) -> DataFrame:
    """Counts by id of event kinds; ``kinds`` maps new columns to values."""
    return events.groupBy(id_col).agg(*[F.count_if(F.col(kind_col) == v).alias(c) for c, v in kinds.items()])


def tool_statistics(calls: DataFrame, latest: int | None, tool: str = "tool_name", time: str = "called_at", tie: str = "id") -> DataFrame:
    """Per tool over its latest calls: total, successes, Laplace rate, mean score, seconds and (whole) tokens; null counts as 0."""
    if latest is not None:
        w = Window.partitionBy(tool).orderBy(F.desc(time), F.desc(tie))
        calls = calls.withColumn("mm_n", F.row_number().over(w)).where(F.col("mm_n") <= latest)
    ok = F.count_if("success")
    return calls.groupBy(tool).agg(
        F.count(F.lit(1)).alias("total"),
        ok.alias("successes"),
        ((ok + 1) / (F.count(F.lit(1)) + 2)).alias("rate"),
        F.avg(F.coalesce("score", F.lit(0.0))).alias("avg_score"),
        F.avg(F.coalesce("time_seconds", F.lit(0.0))).alias("avg_seconds"),
        F.floor(F.avg(F.coalesce("token_cost", F.lit(0)).cast("double"))).cast("int").alias("avg_tokens"),
    )


def commonest(df: DataFrame, by: str, *cols: str) -> DataFrame:
    """Most frequent value of each column by group, the least of equals."""
    return df.groupBy(by).agg(*[F.expr(f"mode() WITHIN GROUP (ORDER BY {c})").alias(c) for c in cols])


def recent_distinct(df: DataFrame, col: str, time: str, n: int) -> DataFrame:
    return df.groupBy(col).agg(F.max(time).alias("latest")).orderBy(F.desc("latest"), col).limit(n)


def best_and_worst(df: DataFrame, by: str, score: str, item: str) -> DataFrame:
    """Per group of two or more with unequal scores: best and worst item, least id of equals."""
    best = F.max_by(item, F.struct(F.col(score), -F.col(item)))
    worst = F.min_by(item, F.struct(F.col(score), F.col(item)))
    out = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.max(score).alias("hi"), F.min(score).alias("lo"), best.alias("best"), worst.alias("worst"))
    return out.where("n >= 2 and hi > lo")


def surviving_vocabulary(memories: DataFrame, latest: int = 50, utility: int = 2) -> DataFrame:
    """Distinct lower-case keywords of the latest memories that were useful often enough."""
    rows = memories.orderBy(F.desc("time_created"), "id").limit(latest).where(F.col("utility_count") >= utility)
    return rows.select(F.explode("keywords").alias("k")).select(F.lower("k").alias("keyword")).distinct()


def validated(drafts: DataFrame, least: float = 0.5) -> DataFrame:
    score = (F.col("score") + F.col("judge_score")) / 2
    return drafts.withColumn("score", score).withColumn("passed", F.col("valid") & (score >= least))


def skill_counts(episodes: DataFrame) -> DataFrame:
    """Successes (partial ones too) and failures by skill from comma-joined references."""
    s = episodes.select("outcome", F.explode(F.split("skill_refs", ",")).alias("skill")).where("trim(skill) <> ''")
    return s.groupBy(F.trim("skill").alias("skill")).agg(F.count_if(F.col("outcome").isin("success", "partial")).alias("success_count"), F.count_if(F.col("outcome") == "failure").alias("fail_count"))
