"""Connected components of an edge table, by alternating large and small stars.

Each round replaces an edge list by another with the same components that is closer to a forest of
stars; it ends when a round changes nothing, which takes about the logarithm of the longest path. Rounds
are written to the shared folder, so the lineage stays short and a lost executor repeats at most one
round. The driver sees one count and one checksum a round. A node of very many edges is a hot key: its
edges meet their least neighbour by a broadcast of bounded size (``skew.with_groups``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.operators.skew import with_groups
from memloom.sources.store import settled, written

#: Far beyond the logarithm of any path; reaching it is an error.
MOST_ROUNDS = 200


def _mark(edges: DataFrame):
    """Count and order-free checksum."""
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
    return row["n"], row["s"]


def _round(edges: DataFrame, n: int) -> DataFrame:
    """Edges a > b in, edges a > b out."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("co_n"))
    large = written(
        with_groups(both, least, ["a"], "co_n", 2 * n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    )
    down = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("co_n"))
    low = with_groups(large, down, ["a"], "co_n", 2 * n).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return low.unionByName(down.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge: root is the least node of its component.

    Loops and edges with a null end are dropped; repeated and reversed edges count once.
    """
    now = written(
        edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull())
        .where("a > b")
        .distinct()
    )
    mark = _mark(now)
    for _ in range(MOST_ROUNDS):
        if not mark[0]:
            break
        then, now = mark, settled(edges.sparkSession, lambda: _round(now, mark[0]))
        mark = _mark(now)
        if mark == then:
            break
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
