"""Lists and point lookups over the engine's tables, status changes, and the export of the graph.

Filters and column choices reach the scan; every list has a total order and a limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matching(df: DataFrame, **equal) -> DataFrame:
    """Rows whose columns equal the given values; None leaves a column free."""
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def by_key(df: DataFrame, value, *columns: str) -> DataFrame:
    """At most one row that holds ``value`` in the first column, or else in the next ones."""
    columns = columns or ("id",)
    rank = F.lit(len(columns))
    for i, c in reversed(list(enumerate(columns))):
        rank = F.when(F.col(c) == value, i).otherwise(rank)
    return df.withColumn("lk_rank", rank).where(F.col("lk_rank") < len(columns)).orderBy("lk_rank", *columns).limit(1).drop("lk_rank")


def newest(df: DataFrame, n: int, time: str, tie: str = "id", **equal) -> DataFrame:
    return matching(df, **equal).orderBy(F.desc(time), F.desc(tie)).limit(n)


def attempts(drawers: DataFrame, n: int = 3, wing: str | None = None) -> DataFrame:
    """The latest rows of the room ``attempts``."""
    return newest(drawers, n, "mined_at", room="attempts", wing=wing)


def page_index(pages: DataFrame, wing: str | None = None, n: int = 100) -> DataFrame:
    """(path, title, n_citations, updated_at) of the pages changed last."""
    rows = matching(pages, wing=wing).select("path", "title", F.coalesce(F.size("citations"), F.lit(0)).alias("n_citations"), "updated_at")
    return rows.orderBy(F.desc("updated_at"), "path").limit(n)


def open_reviews(queue: DataFrame, wing: str | None = None, page_path: str | None = None, n: int = 50) -> DataFrame:
    """Unresolved entries of the review queue, the most similar first."""
    return matching(queue.where("resolved_at is null"), wing=wing, page_path=page_path).orderBy(F.desc("similarity"), "id").limit(n)


def unsummarized(calls: DataFrame, tool: str, wing: str | None = None) -> DataFrame:
    """Calls of a tool that no summary covers, in order of time."""
    return matching(calls, wing=wing, tool_name=tool).where(~F.col("is_summarized")).orderBy("called_at", "id")


def by_topic(tunnels: DataFrame, topic: str) -> DataFrame:
    return matching(tunnels, topic=topic).orderBy("end_a", "end_b")


def counted(df: DataFrame, wing: str | None = None) -> DataFrame:
    return matching(df, wing=wing).agg(F.count(F.lit(1)).alias("n"))


def confidence_range(triples: DataFrame) -> DataFrame:
    """One row: least and greatest confidence of open triples."""
    return triples.where("valid_to is null").agg(F.min("confidence").alias("least"), F.max("confidence").alias("greatest"))


def changed(df: DataFrame, changes: DataFrame, *columns: str, key: str = "id") -> DataFrame:
    """``df`` where rows named by ``changes`` (one row a key) take its columns."""
    new = changes.select(key, *[F.col(c).alias(f"lk_{c}") for c in columns], F.lit(True).alias("lk_hit"))
    out = df.join(new, key, "left")
    hit = F.coalesce("lk_hit", F.lit(False))
    return out.select(*[F.when(hit, F.col(f"lk_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def evaluated(calls: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Calls with the verdicts (id, score, summary): a score counts as one from a half on, else as zero."""
    binary = F.when(F.col("score") >= 0.5, 1.0).otherwise(0.0)
    return changed(calls, verdicts.withColumn("score", binary), "score", "summary")


def summarized(calls: DataFrame, ids: DataFrame) -> DataFrame:
    return changed(calls, ids.select("id").distinct().withColumn("is_summarized", F.lit(True)), "is_summarized")


def synced(registry: DataFrame, found: DataFrame, key: str = "folder_path", time: str = "skill_md_mtime") -> DataFrame:
    """(key, action) of a registry against what was found on disk: added, updated, removed or same."""
    a = registry.select(F.col(key), F.col(time).alias("lk_old"), F.lit(True).alias("lk_have"))
    b = found.select(F.col(key), F.col(time).alias("lk_new"), F.lit(True).alias("lk_found"))
    action = F.when(F.col("lk_have").isNull(), "added").when(F.col("lk_found").isNull(), "removed").when(~F.col("lk_old").eqNullSafe(F.col("lk_new")), "updated")
    return a.join(b, key, "full").select(key, action.otherwise("same").alias("action"))


def contains_answer(content: Column, answer: Column) -> Column:
    return F.contains(F.lower(content), F.lower(answer))


def answer_precision(results: DataFrame) -> DataFrame:
    """One row from (question, id, content, answer, source): questions, and the share whose results hold the answer or the source."""
    hit = contains_answer(F.col("content"), F.col("answer")) | (F.lower("id") == F.lower("source"))
    per = results.groupBy("question").agg(F.max(F.coalesce(hit, F.lit(False))).alias("hit"))
    return per.agg(F.count(F.lit(1)).alias("n_questions"), F.avg(F.col("hit").cast("double")).alias("precision"))


def graph_export(parts: dict[str, tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label, kind) and links (source, target, kind) of all parts; of equal links the first part's stays.

    ``parts``: by kind, in order, nodes (id, label) and links (source, target). Links of unknown ends are dropped.
    """
    nodes, links = None, None
    for i, (kind, (n, e)) in enumerate(parts.items()):
        n = n.select(F.col("id").cast("string").alias("id"), "label", F.lit(kind).alias("kind"), F.lit(i).alias("lk_i"))
        e = e.select(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"), F.lit(kind).alias("kind"), F.lit(i).alias("lk_i"))
        nodes, links = n if nodes is None else nodes.unionByName(n), e if links is None else links.unionByName(e)
    one = nodes.groupBy("id").agg(F.min(F.struct("lk_i", "label", "kind")).alias("f")).select("id", "f.label", "f.kind")
    first = links.groupBy("source", "target").agg(F.min(F.struct("lk_i", "kind")).alias("f")).select("source", "target", "f.kind")
    known = one.select("id")
    first = first.join(known.withColumnRenamed("id", "source"), "source", "left_semi").join(known.withColumnRenamed("id", "target"), "target", "left_semi")
    return one, first.select("source", "target", "kind")
