"""Approximate nearest neighbours by largest inner product: one small-world graph per shard.

Vectors go to the nearest of as many centroids as there are shards of about ``SHARD`` distinct vectors; a
centroid that draws more is split into shards by hash. The centroids come from a bounded sample (``SAMPLE``
rows, ``SAMPLE_BYTES``), on which it is also measured how many centroids a query must visit to meet
``COVERED`` of its nearest rows: vectors without clusters make it all of them. A shard's index has levels
of fewer and fewer nodes (one in ``SPARSER`` goes up); on each level every node has a row of at most
``degree`` neighbours in one flat array. Inner products become distances by one more coordinate,
sqrt(longest^2 - length^2), which queries lack. Rows are chosen from the nearest of the level
(blocks of a matrix product, as a shard is bounded) by the usual rule: take a candidate only if it is
nearer to the node than to all taken before; links then run both ways. Search goes down the levels
with a beam of ``beam`` entries, for blocks of queries at once. Shard results are merged by score.

Equal vectors are one node that carries its least ``k + 1`` ids, which are all that a result can show. Graphs
work on single precision, scaled; scores are taken from the original doubles.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.llm.common import hash_sample, materialize, prepared

SHARD = 12_000
SPARSER = 16
DEGREE = 32
POOL = 96
BEAM = 200
QUERY_BLOCK = 8_192
#: Bytes of a shard's vectors, rows and bytes of the sample, and most centroids.
SHARD_BYTES = 64_000_000
SAMPLE, SAMPLE_BYTES, CENTROIDS = 20_000, 64_000_000, 1024
#: Share of a sampled row's nearest rows that must lie with the centroids that it visits.
COVERED = 0.99


def scaled(x: np.ndarray) -> np.ndarray:
    """In single precision, with a greatest component of one; inner products keep their order."""
    return (x / max(np.abs(x).max(initial=0), np.finfo(np.float64).tiny)).astype(np.float32)


def _nearest_centroid(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centroids.T - (centroids * centroids).sum(1) / 2, axis=1)


def coarse(x: np.ndarray, clusters: int, rounds: int = 8) -> np.ndarray:
    """Centroids by Lloyd's algorithm, from the first rows of a sample in hash order."""
    c = x[:clusters].astype(np.float64)
    for _ in range(rounds if len(c) > 1 else 0):
        near = _nearest_centroid(x, c)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def visits(x: np.ndarray, centroids: np.ndarray, k: int, covered: float = COVERED, asked: int = 500) -> int:
    """How many centroids, by falling inner product, hold that share of the k nearest sampled rows of sampled queries."""
    near = _nearest_centroid(x, centroids)
    q = x[:asked]
    score = q @ x.T
    score[np.arange(len(q)), np.arange(len(q))] = -np.inf
    best = np.argpartition(-score, min(k, len(x) - 1), axis=1)[:, :k]
    rank = np.argsort(np.argsort(-(q @ centroids.T), axis=1), axis=1)
    ranks = np.sort(np.take_along_axis(rank, near[best], 1).ravel())
    return int(ranks[math.ceil(covered * len(ranks)) - 1]) + 1 if len(ranks) else 1


def extended(x: np.ndarray) -> np.ndarray:
    """One more coordinate, so that equal lengths make inner product and distance agree."""
    x = x.astype(np.float32)
    squared = (x.astype(np.float64) ** 2).sum(1)
    return np.column_stack([x, np.sqrt(np.maximum(squared.max(initial=0) - squared, 0)).astype(np.float32)])


def _pick(e: np.ndarray, nodes: np.ndarray, pool: np.ndarray, degree: int) -> np.ndarray:
    """Diverse neighbours, as places in ``e``, -1 for none; pool has candidates by rising distance."""
    out = np.full((len(nodes), degree), -1, np.int32)
    c = e[pool]
    to_node = ((c - e[nodes][:, None]) ** 2).sum(2)
    between = np.einsum("nid,njd->nij", c, c)
    length = (c * c).sum(2)
    between = length[:, :, None] + length[:, None, :] - 2 * between
    taken = np.zeros(pool.shape, bool)
    for j in range(pool.shape[1]):
        close = np.where(taken, between[:, :, j], np.inf).min(1)
        taken[:, j] = (to_node[:, j] < close) & (taken.sum(1) < degree)
    for fill in (taken, ~taken):  # diverse ones first, then the nearest of the rest
        for j in range(pool.shape[1]):
            have = (out >= 0).sum(1)
            use = np.flatnonzero(fill[:, j] & (have < degree))
            out[use, have[use]] = pool[use, j]
    return out


def build_level(e: np.ndarray, members: np.ndarray, degree: int, pool: int) -> np.ndarray:
    """Flat neighbour rows (members x degree) of one level."""
    x = e[members]
    n, size = len(members), min(pool, len(members) - 1)
    half = max(1, degree // 2)
    rows = np.full((n, degree), -1, np.int32)
    if size <= 0:
        return rows
    length = (x * x).sum(1)
    forward = np.full((n, half), -1, np.int32)
    for i in range(0, n, 256):
        d = length[None, :] - 2 * (x[i : i + 256] @ x.T)
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        near = np.argpartition(d, size - 1, axis=1)[:, :size]
        near = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1)
        forward[i : i + 256] = _pick(x, np.arange(i, i + len(d)), near, half)
    rows[:, :half] = forward
    # Reverse links, in order of the linking node, while room is left.
    a, b = np.repeat(np.arange(n), half), forward.ravel()
    a, b = a[b >= 0], b[b >= 0]
    order = np.argsort(b, kind="stable")
    a, b = a[order], b[order]
    rank = np.arange(len(b)) - np.searchsorted(b, b)
    room = rank < degree - half
    rows[b[room], half + rank[room]] = a[room]
    return np.where(rows >= 0, members[np.maximum(rows, 0)], -1).astype(np.int32)


def build_index(x: np.ndarray, degree: int = DEGREE, pool: int = POOL) -> dict:
    """Levels as (place of each node or -1, neighbour rows), the lowest first, and the entry node."""
    e = extended(x)
    n = len(x)
    height = np.floor(-np.log(1 - np.random.default_rng(n).random(n)) / math.log(SPARSER)).astype(int)
    levels = []
    for level in range(int(height.max(initial=0)) + 1):
        members = np.flatnonzero(height >= level)
        if level and len(members) < 4:
            break
        place = np.full(n, -1, np.int32)
        place[members] = np.arange(len(members))
        levels.append((place, build_level(e, members, degree, pool)))
    top = np.flatnonzero(levels[-1][0] >= 0)
    return {"levels": levels, "entry": int(top[0]) if len(top) else -1}


def _beam(x, place, rows, q, start, beam, step=4):
    """Places (queries x beam) by falling inner product, -1 for none."""
    nq, n = len(q), len(x)
    seen = np.zeros((nq, n), bool)
    ids = np.full((nq, beam), -1, np.int64)
    score = np.full((nq, beam), -np.inf, np.float32)
    done = np.ones((nq, beam), bool)
    line = np.arange(nq)[:, None]
    ids[:, : start.shape[1]] = start
    ok = start >= 0
    score[:, : start.shape[1]] = np.where(ok, np.einsum("qkd,qd->qk", x[np.maximum(start, 0)], q), -np.inf)
    done[:, : start.shape[1]] = ~ok
    np.logical_or.at(seen, (np.broadcast_to(line, start.shape), np.maximum(start, 0)), ok)
    live = np.arange(nq)
    while len(live):
        s = np.where(done[live], -np.inf, score[live])
        pick = np.argpartition(-s, min(step, beam) - 1, axis=1)[:, : min(step, beam)]
        row = np.arange(len(live))[:, None]
        good = np.isfinite(s[row, pick])
        live_rows = good.any(1)
        live, pick, good = live[live_rows], pick[live_rows], good[live_rows]
        if not len(live):
            break
        at = live[:, None]
        node = np.where(good, ids[at, pick], 0)
        done[at, pick] = True
        near = np.where(good[:, :, None], rows[place[node]], -1).reshape(len(live), -1)
        near = np.sort(near, axis=1)
        fresh = near >= 0
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        safe = np.maximum(near, 0)
        fresh &= ~seen[at, safe]
        seen[np.broadcast_to(at, near.shape)[fresh], near[fresh]] = True
        got = np.where(fresh, np.einsum("qkd,qd->qk", x[safe], q[live]), -np.inf).astype(np.float32)
        all_score = np.concatenate([score[live], got], axis=1)
        all_ids = np.concatenate([ids[live], near], axis=1)
        all_done = np.concatenate([done[live], ~fresh], axis=1)
        best = np.argpartition(-all_score, beam - 1, axis=1)[:, :beam]
        row = np.arange(len(live))[:, None]
        score[live], ids[live], done[live] = all_score[row, best], all_ids[row, best], all_done[row, best]
    order = np.argsort(-score, axis=1, kind="stable")
    ids, score = np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)
    return np.where(np.isfinite(score), ids, -1)


def search_index(x: np.ndarray, index: dict, q: np.ndarray, beam: int = BEAM, block: int = 256) -> np.ndarray:
    """Places of the nearest nodes of each query, -1 for none; a shard no larger than the beam is all in it."""
    if len(x) <= beam:
        return np.tile(np.arange(len(x)), (len(q), 1))
    out = []
    for i in range(0, len(q), block):
        part = q[i : i + block]
        start = np.full((len(part), 1), index["entry"], np.int64)
        for place, rows in reversed(index["levels"][1:]):
            start = _beam(x, place, rows, part, start, 8, 2)
        place, rows = index["levels"][0]
        out.append(_beam(x, place, rows, part, start, max(beam, 8)))
    return np.concatenate(out) if out else np.zeros((0, beam), np.int64)


STORED = (
    "an_cluster int, an_part int, an_vectors binary, an_ids array<long>, an_ends array<long>, an_places array<binary>, an_rows array<binary>, an_entry int"
)


def _build(dim: int, degree: int, pool: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("an_lead").combine_chunks()
        x = table.column("an_vec").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        index = build_index(scaled(x), degree, pool)
        ids = table.column("an_ids").combine_chunks()
        ends = np.cumsum([len(i) for i in ids])
        return pa.table(
            {
                "an_cluster": pa.array(table.column("an_cluster").to_pylist()[:1], pa.int32()),
                "an_part": pa.array(table.column("an_part").to_pylist()[:1], pa.int32()),
                "an_vectors": pa.array([x.tobytes()]),
                "an_ids": pa.array([ids.flatten().to_numpy()], pa.list_(pa.int64())),
                "an_ends": pa.array([ends], pa.list_(pa.int64())),
                "an_places": pa.array([[p.tobytes() for p, _ in index["levels"]]], pa.list_(pa.binary())),
                "an_rows": pa.array([[r.tobytes() for _, r in index["levels"]]], pa.list_(pa.binary())),
                "an_entry": pa.array([index["entry"]], pa.int32()),
            }
        )

    return run


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


def _placed(dim: int, centroids: np.ndarray, unit: float, visited: int = 0, members: np.ndarray | None = None, least: int = 0):
    """Rows with the nearest centroid, or with those that a query visits: the first ``visited`` by inner product, and more until they have ``least`` members."""

    def run(batches):
        for batch in batches:
            x = batch.column("an_vec").flatten().to_numpy().reshape(-1, dim) / unit
            if members is None:
                to = list(_nearest_centroid(x, centroids)[:, None].astype(np.int32))
            else:
                order = np.argsort(-(x @ centroids.T), axis=1, kind="stable").astype(np.int32)
                before = np.cumsum(members[order], axis=1) - members[order]
                to = [o[: max(visited, int((b < least).sum()))] for o, b in zip(order, before)]
            arrays = [*batch.columns, pa.array(to, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "an_clusters"])

    return run


FOUND = "query_id long, vec_id long, score double"


def _search(dim: int, degree: int, beam: int, k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        got = left.to_pylist()[0]
        x = np.frombuffer(got["an_vectors"], np.float64).reshape(-1, dim)
        index = {
            "levels": [(np.frombuffer(p, np.int32), np.frombuffer(r, np.int32).reshape(-1, degree)) for p, r in zip(got["an_places"], got["an_rows"])],
            "entry": got["an_entry"],
        }
        ids, ends = np.array(got["an_ids"], np.int64), np.array(got["an_ends"], np.int64)
        starts = np.append(0, ends[:-1])
        own = right.column("an_query").to_numpy()
        q = right.column("an_vec").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        small = (q / np.abs(q).max(1, keepdims=True)).astype(np.float32)
        wide = max(beam, 2 * k)
        found = search_index(scaled(x), index, small, wide)
        out = []
        for i, row in enumerate(found):
            row = row[row >= 0]
            row = row if len(x) <= wide else row[: k + 8]
            score = (x[row] * q[i]).sum(1)
            cand, exact = ids[np.concatenate([np.arange(starts[j], ends[j]) for j in row] or [np.zeros(0, int)])], np.repeat(score, ends[row] - starts[row])
            cand, exact = cand[cand != own[i]], exact[cand != own[i]]
            best = np.lexsort([cand, -exact])[:k]
            out.append((np.full(len(best), own[i]), cand[best], exact[best]))
        return pa.table([np.concatenate(c) for c in zip(*out)], schema=schema)

    return run


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
    shard: int = SHARD, degree: int = DEGREE, pool: int = POOL, beam: int = BEAM,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found of each query row, by inner product, ties to lesser ids.

    Vectors (and queries) that are null, zero, or hold null or non-finite components take no part, nor
    do those of another length than most have, nor rows of null id. Rows of the query's own id are not
    its candidates. Repeated rows count once; an empty table gives no rows. Scores are in double
    precision on the original vectors.
    """
    v = F.col("an_vec")

    def clean(d: DataFrame) -> DataFrame:
        return (
            prepared(d, id_col, vec_col)
            .select(F.col(id_col).cast("long").alias("an_id"), F.col(vec_col).cast("array<double>").alias("an_vec"))
            .where(
                F.col("an_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)
                & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
            )
            .distinct()
        )

    spark = vectors.sparkSession
    rows = clean(vectors)
    lengths = rows.groupBy(F.size(v).alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = lengths["dim"]
    # Row numbers under a limit are cut in each task before the shuffle, so a common vector costs k + 1 rows a task.
    first = rows.where(F.size(v) == dim).withColumn("an_n", F.row_number().over(Window.partitionBy("an_vec").orderBy("an_id"))).where(F.col("an_n") <= k + 1)
    nodes = materialize(first.groupBy("an_vec").agg(F.sort_array(F.collect_list("an_id")).alias("an_ids"), F.min("an_id").alias("an_lead")))
    total = nodes.count()
    size = max(1, min(shard, SHARD_BYTES // (8 * dim)))
    sampled = hash_sample(nodes.select("an_lead", "an_vec"), ["an_lead"], total, max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))).toArrow()
    sample = sampled.column("an_vec").combine_chunks().flatten().to_numpy().reshape(-1, dim)
    unit = max(np.abs(sample).max(initial=0), np.finfo(np.float64).tiny)
    centroids = coarse(sample / unit, min(CENTROIDS, math.ceil(total / size)))
    probes = visits(sample / unit, centroids, k)
    placed = nodes.mapInArrow(_placed(dim, centroids, unit), f"{_ddl(nodes)}, an_clusters array<int>").withColumn("an_cluster", F.col("an_clusters")[0])
    members = {r["an_cluster"]: r["count"] for r in placed.groupBy("an_cluster").count().collect()}  # CENTROIDS rows at most
    parts = F.create_map(*[F.lit(int(x)) for c, n in members.items() for x in (c, math.ceil(n / size))])
    shard_key = ["an_cluster", "an_part"]
    index = materialize(
        placed.withColumn("an_part", F.pmod(F.xxhash64("an_lead"), parts[F.col("an_cluster")]).cast("int"))
        .groupBy(*shard_key)
        .applyInArrow(_build(dim, degree, pool), STORED)
    )
    asked = clean(queries).where(F.size(v) == dim).withColumnRenamed("an_id", "an_query")
    counts = np.array([members.get(c, 0) for c in range(len(centroids))])
    routed = asked.mapInArrow(_placed(dim, centroids, unit, probes, counts, 10 * k), f"{_ddl(asked)}, an_clusters array<int>").withColumn("an_cluster", F.explode("an_clusters"))
    visitors = {r["an_cluster"]: r["count"] for r in routed.groupBy("an_cluster").count().collect() if r["an_cluster"] in members}  # likewise
    if not visitors:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    blocks = F.create_map(*[F.lit(int(x)) for c, n in visitors.items() for x in (c, math.ceil(n / QUERY_BLOCK))])[F.col("an_cluster")]
    dealt = (
        routed.where(parts[F.col("an_cluster")].isNotNull())
        .withColumn("an_block", F.pmod(F.xxhash64("an_query"), blocks).cast("int"))
        .withColumn("an_part", F.explode(F.sequence(F.lit(0), parts[F.col("an_cluster")] - 1)))
        .select("an_query", "an_vec", "an_block", *shard_key)
    )
    copies = index.where(blocks.isNotNull()).withColumn("an_block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    found = copies.groupBy(*shard_key, "an_block").cogroup(dealt.groupBy(*shard_key, "an_block")).applyInArrow(_search(dim, degree, beam, k), FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
