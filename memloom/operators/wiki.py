"""Synthesis pages: links, search, review queue and lint rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.functions import text as T
from memloom.functions import vec as V
from memloom.operators.cluster import similarity_join
from memloom.operators.retrieval import bm25


def links(pages: DataFrame) -> DataFrame:
    """(source, target) of wikilinks, without loops."""
    out = pages.select(F.col("path").alias("source"), F.explode(F.array_distinct(T.wikilinks(F.col("content")))).alias("target"))
    return out.where("source <> target")


def backlinks(edges: DataFrame) -> DataFrame:
    """(path, n_backlinks, sources) of linked pages."""
    return edges.groupBy(F.col("target").alias("path")).agg(
        F.countDistinct("source").alias("n_backlinks"), F.sort_array(F.collect_set("source")).alias("sources")
    )


def citation_backlinks(pages: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, backlinks): the most backlinks of any page that cites an id."""
    cited = pages.select(F.explode("citations").alias("id"), F.size("backlinks").alias("n"))
    return cited.join(ids.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.max("n").alias("backlinks"))


def search(pages: DataFrame, query: str, query_vec, edges: DataFrame, k: int = 10, log_base: float = 10.0) -> DataFrame:
    """0.40 keyword + 0.40 cosine + 0.20 log of inbound links, for keyword hits and cosines over 0.3."""
    words = bm25(pages, query, None, "path", "content").select(F.col("id").alias("path"), (F.col("score") / F.log(F.lit(log_base))).alias("words"))
    inbound = edges.groupBy(F.col("target").alias("path")).agg(F.count(F.lit(1)).alias("inbound"))
    out = pages.withColumn("cos", V.cosine(F.col("embedding"), V.literal(query_vec))).join(words, "path", "left").join(inbound, "path", "left")
    score = 0.40 * F.coalesce("words", F.lit(0.0)) + 0.40 * F.col("cos") + 0.20 * F.log10(1 + F.coalesce("inbound", F.lit(0)).cast("double"))
    return out.where(F.col("words").isNotNull() | (F.col("cos") > 0.3)).select("path", score.alias("score")).orderBy(F.desc("score"), "path").limit(k)


def pending(drawers: DataFrame, pages: DataFrame, queue: DataFrame | None = None, threshold: float = 0.55) -> DataFrame:
    """New (id, page_path, drawer_id, similarity) of rows near a page that the queue does not hold."""
    pairs = similarity_join(drawers.select("id", "embedding"), pages.select(F.col("path").alias("id"), "embedding"), threshold)
    out = pairs.select(T.short_hash(F.concat_ws("|", "b", F.col("a").cast("string"))).alias("id"), F.col("b").alias("page_path"), F.col("a").alias("drawer_id"), F.col("score").alias("similarity"))
    return out if queue is None else out.join(queue.select("id"), "id", "left_anti")


def resolve(queue: DataFrame, ids: DataFrame, resolution: str, at, only_open: bool = False) -> DataFrame:
    hit = queue.join(ids.select("id").distinct().withColumn("wk_hit", F.lit(True)), "id", "left")
    change = F.col("wk_hit").isNotNull() & (F.col("resolved_at").isNull() if only_open else F.lit(True))
    return (
        hit.withColumn("resolution", F.when(change, F.lit(resolution)).otherwise(F.col("resolution")))
        .withColumn("resolved_at", F.when(change, F.lit(at).cast("timestamp")).otherwise(F.col("resolved_at")))
        .select(*queue.columns)
    )


def pending_summary(queue: DataFrame) -> DataFrame:
    return queue.where("resolved_at is null").groupBy("page_path").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "page_path")


def _finding(df: DataFrame, rule: str, severity: str, detail) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.col("path"), detail.cast("string").alias("detail"))


def lint(pages: DataFrame, drawers: DataFrame, queue: DataFrame, entities: DataFrame | None = None, triples: DataFrame | None = None, low: float = 0.5, many: int = 3) -> DataFrame:
    """(rule, severity, path, detail) of all rules that the given tables allow."""
    live = drawers.where("valid_to is null and is_representative").select(F.col("id").alias("wk_id"))
    cited = pages.select("path", F.explode("citations").alias("wk_id"))
    edges = links(pages)
    linked = edges.select(F.col("source").alias("path")).unionByName(edges.select(F.col("target").alias("path")))
    with_state = cited.join(live.withColumn("wk_live", F.lit(True)), "wk_id", "left")
    stale = with_state.groupBy("path").agg(F.count("wk_live").alias("n_live")).where("n_live = 0")
    a, b = pages.select("path", "title", F.lower("content").alias("wk_low")), pages.select(F.col("path").alias("wk_to"), F.lower("title").alias("wk_title"))
    # Titles against contents: pages are written by hand or model, one side is checked by size before a broadcast.
    mention = a.join(b, (F.col("path") != F.col("wk_to")) & (F.length("wk_title") > 2) & F.col("wk_low").contains(F.col("wk_title")))
    missing = mention.join(edges, (F.col("path") == F.col("source")) & (F.col("wk_to") == F.col("target")), "left_anti")
    waiting = queue.where("resolved_at is null").groupBy(F.col("page_path").alias("path")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= many)
    rules = [
        _finding(cited.join(live, "wk_id", "left_anti"), "BrokenCitation", "error", F.col("wk_id")),
        _finding(pages.join(linked, "path", "left_anti"), "OrphanPage", "warn", F.col("title")),
        _finding(stale, "StalePage", "warn", F.col("n_live")),
        _finding(missing, "MissingCrossLink", "info", F.col("wk_to")),
        _finding(waiting, "PendingUpdates", "info", F.col("n")),
        _finding(pages.where(F.col("quality_score") < low), "LowQuality", "warn", F.round("quality_score", 6)),
    ]
    if entities is not None and triples is not None:
        from memloom.operators.graph import gap_candidates

        gaps = gap_candidates(entities, triples, pages)
        rules.append(_finding(gaps.withColumn("path", F.lit(None).cast("string")), "GapCandidate", "info", F.col("name")))
        rules.append(contradictions(pages, triples, queue))
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out


def contradictions(pages: DataFrame, triples: DataFrame, queue: DataFrame, threshold: float = 0.55) -> DataFrame:
    """Pages whose cited facts and a waiting drawer's facts give a subject and predicate other objects, one numeric."""
    from pyspark.sql import Window

    mine = pages.select("path", F.explode("citations").alias("drawer_id")).join(triples.select("drawer_id", "subject", "predicate", "object"), "drawer_id").drop("drawer_id")
    near = queue.where(F.col("resolved_at").isNull() & (F.col("similarity") >= threshold)).select(F.col("page_path").alias("path"), "drawer_id")
    theirs = near.join(triples.select("drawer_id", "subject", "predicate", F.col("object").alias("wk_other")), "drawer_id").drop("drawer_id")
    both = mine.join(theirs, ["path", "subject", "predicate"]).where(
        (F.lower("object") != F.lower("wk_other")) & (T.is_numeric(F.col("object")) | T.is_numeric(F.col("wk_other")))
    )
    first = F.row_number().over(Window.partitionBy("path").orderBy("subject", "predicate", "object", "wk_other"))
    one = both.withColumn("wk_n", first).where("wk_n = 1")
    return _finding(one, "ContradictionCandidate", "warn", F.concat_ws(" | ", "subject", "predicate", "object", "wk_other"))


def broken_citations(pages: DataFrame, ids: DataFrame) -> DataFrame:
    """(path, id) of citations that are not 16 hex digits or not there."""
    cited = pages.select("path", F.explode("citations").alias("id"))
    good = F.col("id").rlike("^[0-9a-f]{16}$")
    return cited.where(~good).unionByName(cited.where(good).join(ids.select("id"), "id", "left_anti").select("path", "id"))


def lint_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"))
