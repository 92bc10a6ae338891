"""Keyword, vector and hybrid retrieval."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions import text as T
from memloom.functions import vec as V
from memloom.sources.store import written


def active(df: DataFrame) -> DataFrame:
    """Rows neither expired nor retired."""
    return df.where(F.col("valid_to").isNull() & F.col("is_representative"))


# Keyword search ---------------------------------------------------------------------------------


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Inverted index (term, id, tf, len): one aggregation over the terms of all texts."""
    terms = T.tokens(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), terms.alias("terms")).select("id", F.size("terms").alias("len"), F.explode("terms").alias("term"))
    return rows.groupBy("term", "id", "len").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(docs: DataFrame, text_col: str) -> DataFrame:
    """One row: n documents and their mean length in terms."""
    return docs.select(F.size(T.tokens(F.col(text_col))).alias("len")).agg(F.count("len").alias("n"), F.avg("len").alias("avg_len"))


def bm25(
    docs: DataFrame, query: str | list[str], k: int | None = 200, id_col: str = "id", text_col: str = "text", k1: float = 1.2, b: float = 0.75
) -> DataFrame:
    """(id, score) of documents that hold any term, best first, ties by id.

    Only postings of the query's terms are built: terms filter before they are exploded.
    """
    terms = sorted({t for t in (query if isinstance(query, list) else query.lower().split())})
    low, mark = F.lower(F.col(text_col)), T.TERM_LETTERS
    hit = f"(?<!{mark})(?:{'|'.join(re.escape(t) for t in sorted(terms, key=len, reverse=True)) or '(?!)'})(?!{mark})"
    # Texts are read once: what the query needs of them is small, and stored.
    base = written(
        docs.select(
            F.col(id_col).alias("id"), F.coalesce(F.regexp_count(low, F.lit(mark + "+")), F.lit(0)).alias("len"), F.regexp_extract_all(low, F.lit(hit), 0).alias("hits")
        )
    )
    return scored_terms(base.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len")), base.select("id", "len", F.explode("hits").alias("term")).groupBy("id", "len", "term").agg(F.count(F.lit(1)).alias("tf")), k, k1, b)


def indexed(postings_: DataFrame, stats: DataFrame, query: str | list[str], k: int | None = 200, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``bm25`` from stored postings (term, id, tf, len) and their ``corpus_stats``: only the query's terms are read."""
    terms = sorted({t for t in (query if isinstance(query, list) else query.lower().split())})
    return scored_terms(stats, postings_.where(F.col("term").isin(terms)).select("id", "len", "term", "tf"), k, k1, b)


def scored_terms(stats: DataFrame, tf: DataFrame, k: int | None, k1: float, b: float) -> DataFrame:
    """(id, score) from one row of statistics and counts of the query's terms (id, len, term, tf)."""
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # df has a row a query term, stats one row: both sides are bounded by the query.
    scored = tf.join(F.broadcast(df), "term").join(F.broadcast(stats))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    out = scored.groupBy("id").agg(F.sum(idf * weight).alias("score"))
    return out if k is None else out.orderBy(F.desc("score"), "id").limit(k)


def substring_search(docs: DataFrame, terms: list[str], id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, score): share of the terms that the text contains, for rows not yet indexed."""
    low = F.lower(F.col(text_col))
    hits = sum((low.contains(t.lower()).cast("int") for t in terms), F.lit(0))
    return docs.select(F.col(id_col).alias("id"), (hits / len(terms)).alias("score")).where("score > 0")


def append_unseen(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of the second list whose id the first lacks, after those of the first."""
    return first.unionByName(second.join(first.select("id"), "id", "left_anti"))


def grep_exact(docs: DataFrame, pattern: str, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Rows that match a regular expression anywhere, with a snippet."""
    hit = docs.where(F.col(text_col).rlike(pattern))
    return hit.withColumn("snippet", T.snippet(F.col(text_col), pattern))


# Vector search ----------------------------------------------------------------------------------


def cosine_scores(vectors: DataFrame, query, vec_col: str = "embedding") -> DataFrame:
    """``vectors`` with column score; ``query`` is a list of numbers, or a column of the same table."""
    q = query if isinstance(query, Column) else V.literal(query)
    return vectors.withColumn("score", V.cosine(F.col(vec_col), q))


def vector_topk(vectors: DataFrame, query, k: int, id_col: str = "id", vec_col: str = "embedding", exclude: DataFrame | None = None) -> DataFrame:
    """The k rows of highest cosine, ties by id; rows of ``exclude`` (id) take no part."""
    if exclude is not None:
        vectors = vectors.join(exclude, id_col, "left_anti")
    return cosine_scores(vectors, query, vec_col).orderBy(F.desc("score"), id_col).limit(k)


def above(vectors: DataFrame, query, threshold: float, vec_col: str = "embedding") -> DataFrame:
    return cosine_scores(vectors, query, vec_col).where(F.col("score") >= threshold)


# Fusion and boosts ------------------------------------------------------------------------------


def ranked(channel: DataFrame, name: str) -> DataFrame:
    """(channel, id, rank) with ranks from 0; channels are short lists (a limit came before)."""
    w = Window.orderBy(F.desc("score"), "id")
    return channel.select(F.lit(name).alias("channel"), "id", (F.row_number().over(w) - 1).alias("rank"))


def rrf(channels: list[DataFrame], k: int = 60) -> DataFrame:
    """(id, score): sum over channels of 1 / (k + rank + 1)."""
    every = channels[0]
    for c in channels[1:]:
        every = every.unionByName(c)
    return every.groupBy("id").agg(F.sum(1.0 / (k + F.col("rank") + 1)).alias("score"))


def min_max(df: DataFrame, col: str = "score") -> DataFrame:
    """Scores scaled to 0..1; unchanged for one row or a range under 1e-8."""
    low, high, n = (f(c).over(Window.partitionBy()) for f, c in ((F.min, col), (F.max, col), (F.count, col)))
    return df.withColumn(col, F.when((n > 1) & (high - low >= 1e-8), (F.col(col) - low) / (high - low)).otherwise(F.col(col)))


def decay_boost(score: Column, days: Column, accesses: Column) -> Column:
    """Ages fade, uses strengthen; a row never used does not fade."""
    return score / (1 + 0.002 * F.coalesce(days, F.lit(0))) * (1 + 0.1 * F.log10(1 + F.coalesce(accesses, F.lit(0)).cast("double")))


def salience_boost(score: Column, importance: Column, weight: float = 0.10) -> Column:
    return F.when((importance > 0) & (importance != 1), score + weight * importance).otherwise(score)


def backlink_boost(score: Column, backlinks: Column, weight: float = 0.12, cap: float = 0.25) -> Column:
    return score + F.least(F.lit(cap), weight * F.log1p(F.coalesce(backlinks, F.lit(0)).cast("double")))


def recency_boost(score: Column, age_days: Column, used_days: Column, accesses: Column, half_life: float = 14, stale: float = 30, most: float = 0.2) -> Column:
    """Rows never used lose after ``stale`` days; used rows gain by use and recency."""
    fading = F.when(age_days > stale, F.least(F.lit(most), (age_days - stale) / stale * 0.1)).otherwise(0.0)
    gain = F.least(F.lit(0.15), 0.02 * accesses) + 0.15 * F.exp(-used_days / half_life)
    return score + F.when(accesses == 0, -fading).otherwise(gain)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def side_index_boost(docs: DataFrame, query_tokens: Column, tokens_col: str, weight: float = 0.15) -> Column:
    return weight * jaccard(query_tokens, F.col(tokens_col))


def governed(df: DataFrame, k: int, group: str = "cluster_id", aggressive: bool = False) -> DataFrame:
    """The k best rows with slots per cluster; unfilled places go to the best of the rest."""
    # Callers pass a short candidate list, so one partition sees few rows.
    groups = F.size(F.collect_set(F.coalesce(group, F.lit(-1))).over(Window.partitionBy()))
    slots = F.greatest(F.lit(1), F.floor(k / groups) if aggressive else F.ceil(k / groups))
    place = F.row_number().over(Window.partitionBy(F.coalesce(group, F.lit(-1))).orderBy(F.desc("score"), "id"))
    first = df.withColumn("in_slot", place <= slots)
    order = F.row_number().over(Window.orderBy(F.desc("in_slot"), F.desc("score"), "id"))
    return first.withColumn("n", order).where(F.col("n") <= k).drop("n")


def mmr(candidates: DataFrame, k: int, weight: float = 0.5, query_col: str | None = None, id_col: str = "id", vec_col: str = "embedding", schema: str | None = None) -> DataFrame:
    """Maximal marginal relevance: (query, id, score, position), greedy within each query's short candidate list."""
    import numpy as np
    import pandas as pd

    if query_col is None:
        candidates, query_col = candidates.withColumn("mmr_query", F.lit(0)), "mmr_query"
    types = dict(candidates.dtypes)
    out = schema or f"{query_col} {types[query_col]}, {id_col} {types[id_col]}, score double, position int"

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", id_col], ascending=[False, True], kind="stable").reset_index(drop=True)
        n = len(pdf)
        if n > k:
            size = max((len(v) for v in pdf[vec_col] if v is not None), default=1)
            x = np.array([np.zeros(size) if v is None else np.asarray(v, float) for v in pdf[vec_col]])
            length = np.linalg.norm(x, axis=1)
            unit = np.where(length[:, None] > 1e-9, x / np.maximum(length[:, None], 1e-9), 0)
            taken, near = [0], np.maximum(0, unit @ unit[0])
            while len(taken) < k:
                value = weight * pdf["score"].to_numpy() - (1 - weight) * near
                value[taken] = -np.inf
                best = int(np.argmax(value))
                taken.append(best)
                near = np.maximum(near, unit @ unit[best])
            pdf = pdf.iloc[taken].reset_index(drop=True)
        pdf["position"] = range(1, len(pdf) + 1)
        return pdf[[query_col, id_col, "score", "position"]]

    return candidates.select(query_col, id_col, "score", vec_col).groupBy(query_col).applyInPandas(pick, out)


def packed(df: DataFrame, budget: int, order: list, text_col: str = "text", partition: list[str] | None = None) -> DataFrame:
    """The longest prefix, in order, whose lengths sum to ``budget`` at most, with the running sum.

    Of rows that are not empty a prefix holds ``budget`` at most: the first so many are cut in each task, before
    anything is summed in one place. Empty rows cost nothing and join where they stand.
    """
    keys = partition or []
    size = F.coalesce(F.length(text_col), F.lit(0))
    sized = df.withColumn("pk_size", size)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    solid = sized.where("pk_size > 0").withColumn("pk_n", place).where(F.col("pk_n") <= budget + 1).drop("pk_n")
    every = solid.unionByName(sized.where("pk_size = 0"))
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return every.withColumn("used", F.sum("pk_size").over(w)).where(F.col("used") <= budget).drop("pk_size")


def around(df: DataFrame, anchor_id, n: int, time_col: str, id_col: str = "id") -> DataFrame:
    """n rows before an anchor row by time, the anchor, and n after; part is -1, 0 or 1."""
    # One row by id.
    at = F.broadcast(df.where(F.col(id_col) == anchor_id).select(F.col(time_col).alias("at_time")).limit(1))
    rest = df.where(F.col(id_col) != anchor_id).join(at)
    before = rest.where(F.col(time_col) <= F.col("at_time")).orderBy(F.desc(time_col), F.desc(id_col)).limit(n)
    after = rest.where(F.col(time_col) > F.col("at_time")).orderBy(time_col, id_col).limit(n)
    middle = df.where(F.col(id_col) == anchor_id).withColumn("part", F.lit(0))
    return before.drop("at_time").withColumn("part", F.lit(-1)).unionByName(middle).unionByName(after.drop("at_time").withColumn("part", F.lit(1)))


def confidence_level(score: Column, high: float = 0.80, medium: float = 0.60, proceed: float = 0.40) -> Column:
    return F.when(score > high, "high").when(score > medium, "medium").when(score > proceed, "proceed").otherwise("low")


def seed_guidance(has_seed: Column, score: Column, survivors: Column, least: float = 0.25, enough: float = 0.40) -> Column:
    """What an agent should do after a wake-up: go on, ask the user, or verify."""
    return F.when(~has_seed | ((score >= enough) & (survivors >= 1)), "proceed").when(score >= least, "ask_user").otherwise("verify")


def evidence_gate(results: DataFrame, least: float) -> DataFrame:
    """One row: whether any result reaches the least score."""
    return results.agg(F.coalesce(F.max("score") >= least, F.lit(False)).alias("sufficient"), F.count(F.lit(1)).alias("n_results"))


def merged_variants(variants: list[DataFrame], k: int) -> DataFrame:
    """Best score of each id over several query variants."""
    every = variants[0]
    for v in variants[1:]:
        every = every.unionByName(v)
    return every.groupBy("id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "id").limit(k)


def hybrid(
    docs: DataFrame, query: str, query_vec, k: int = 10, fetch: int = 200, weight: float = 0.5, kg: DataFrame | None = None, as_of=None, words: DataFrame | None = None
) -> DataFrame:
    """Keyword and vector channels fused, boosted and diversified: (id, score, position).

    ``docs``: id, text, embedding and, if present, importance, last_accessed_at, access_count. ``kg``: (id,
    confidence) from the graph channel; ``words``: the keyword channel (id, score), if an index gave it. Only short lists (``fetch`` rows a channel) are ranked and fused.
    """
    words = bm25(docs, [t for t in query.lower().split() if t], fetch) if words is None else words
    near = vector_topk(docs.where("embedding is not null").select("id", "embedding"), query_vec, fetch).select("id", "score")
    channels = [ranked(words, "bm25"), ranked(near, "cosine")]
    fused = rrf(channels)
    if kg is not None:
        rank = F.row_number().over(Window.orderBy(F.desc("confidence"), "id")) - 1
        bonus = kg.select("id", (F.col("confidence") / (60 + rank + 1)).alias("bonus"))
        fused = fused.join(bonus, "id", "full").select("id", (F.coalesce("score", F.lit(0.0)) + F.coalesce("bonus", F.lit(0.0))).alias("score"))
    rows = docs.join(F.broadcast(fused), "id")  # 2 x fetch rows and the graph's
    now = F.lit(as_of).cast("timestamp") if as_of is not None else F.current_timestamp()
    score = F.col("score")
    if "last_accessed_at" in docs.columns:
        score = decay_boost(score, F.datediff(now, F.col("last_accessed_at")), F.col("access_count"))
    rows = min_max(rows.withColumn("score", score))
    if "importance" in docs.columns:
        rows = rows.withColumn("score", salience_boost(F.col("score"), F.col("importance")))
    return mmr(rows, k, weight).drop("mmr_query")
