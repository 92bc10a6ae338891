"""Calibration of scores against relevance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reliability(df: DataFrame, score: str = "score", label: str = "relevant", bins: int = 10) -> DataFrame:
    """(bin, n, mean_score, share) of equal-width bins."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("share"))


def ece(df: DataFrame, score: str = "score", label: str = "relevant", bins: int = 10) -> DataFrame:
    """One row: expected calibration error."""
    r = reliability(df, score, label, bins)
    return r.agg((F.sum(F.abs(F.col("mean_score") - F.col("share")) * F.col("n")) / F.sum("n")).alias("ece"))


def brier(df: DataFrame, score: str = "score", label: str = "relevant") -> DataFrame:
    d = F.col(score) - F.col(label).cast("double")
    return df.agg(F.avg(d * d).alias("brier"))


def precision_thresholds(df: DataFrame, targets=(0.90, 0.70, 0.50), score: str = "score", label: str = "relevant", tie: str = "id") -> DataFrame:
    """(target, threshold): score of the first row after the first, by falling score, where precision so far reaches it.

    Rows of equal score are folded. Running sums go within ranges of scores, on top of the totals of the
    ranges above, which are 4097 rows at most: no window holds all scores.
    """
    by_score = df.groupBy(score).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("hits"))
    by_score = by_score.withColumn("ev_range", F.least(F.greatest(F.floor(F.col(score) * 4096), F.lit(0)), F.lit(4096)).cast("int"))
    above = Window.orderBy(F.desc("ev_range")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = by_score.groupBy("ev_range").agg(F.sum("n").alias("ev_n"), F.sum("hits").alias("ev_h"))
    ranges = ranges.select("ev_range", F.coalesce(F.sum("ev_n").over(above), F.lit(0)).alias("ev_n"), F.coalesce(F.sum("ev_h").over(above), F.lit(0)).alias("ev_h"))
    w = Window.partitionBy("ev_range").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    run = by_score.join(F.broadcast(ranges), "ev_range").withColumn("rows", F.col("ev_n") + F.sum("n").over(w))
    run = run.withColumn("precision", (F.col("ev_h") + F.sum("hits").over(w)) / F.col("rows")).where("rows > 1")
    t = df.sparkSession.createDataFrame([(float(x),) for x in targets], "target double")
    hit = run.join(F.broadcast(t), F.col("precision") >= F.col("target"))
    return hit.groupBy("target").agg(F.max(score).alias("threshold"))


def agreement(df: DataFrame, signals: list[str], label: str = "relevant") -> DataFrame:
    """(agreement, n, share): rows by the number of signals that hold."""
    k = sum((F.col(s).cast("int") for s in signals), F.lit(0))
    return df.groupBy(k.alias("agreement")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("share"))
