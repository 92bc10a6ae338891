"""SimHash near-dedup by pigeonhole blocks.

Fingerprints are cut into ``blocks`` blocks. Two that differ in at most ``radius`` bits agree on at
least ``blocks - radius`` whole blocks, so they share a bucket of at least one of the
C(blocks, radius) tables keyed by that many blocks. Buckets are verified by Hamming distance and
give a spanning set of links instead of all pairs; components follow from those.

Sizes. Equal fingerprints are one node. Buckets of one fingerprint end at a count. Buckets up to
``bucket_limit`` are compared as blocks of numpy words inside a task. Larger ones are never
gathered: their fingerprints meet at mid points (one differs from x in at most radius // 2 bits,
the other in at most the rest), which is linear in the bucket and finds exactly the same links.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import batches_of, longs, materialize, prepared, raw_texts
from memloom.operators.components import components
from memloom.llm.simhash_kernel import fingerprint

BITS = 64
PRINTS = pa.schema([("sh_id", pa.int64()), ("sh_print", pa.int64())])
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _fingerprints(width: int, seed: int):
    def run(batches):
        for batch in batches:
            prints = np.fromiter((fingerprint(x, width, seed) for x in raw_texts(batch, "sh_text")), np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("sh_id"), pa.array(longs(prints))], schema=PRINTS)

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(id, sh_print long) of each row; see ``simhash_kernel.fingerprint``."""
    base = prepared(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("sh_id"), F.col(text_col).alias("sh_text"))
    return base.mapInArrow(_fingerprints(width, seed), "sh_id long, sh_print long")


def block_masks(blocks: int, radius: int) -> list[int]:
    """The bits that each table is keyed by."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    block = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [sum(block[i] for i in keep) for keep in itertools.combinations(range(blocks), blocks - radius)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def spanning_links(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect exactly what links of at most ``radius`` bits connect, one per joined node."""
    n = len(prints)
    if n == 2:
        return [(0, 1)] if int(prints[0] ^ prints[1]).bit_count() <= radius else []
    label = np.arange(n)
    near = np.concatenate(
        [np.bitwise_count(prints[i : i + 256, None] ^ prints[None, :]) <= radius for i in range(0, n, 256)]
    )
    while True:
        least = np.concatenate([np.where(near[i : i + 256], label, n).min(1) for i in range(0, n, 256)])
        least = least[least]
        if (least == label).all():
            return [(int(label[i]), i) for i in range(n) if label[i] != i]
        label = least


def _verify(radius: int):
    def run(batches):
        for batch in batches:
            a, b = [], []
            for bucket in batch.column("sh_bucket"):
                prints = np.unique(bucket.values.to_numpy().view(np.uint64))
                for i, j in spanning_links(prints, radius) if len(prints) > 1 else ():
                    a.append(prints[i])
                    b.append(prints[j])
            if a:
                yield from batches_of(LINKS, [longs(np.array(a, np.uint64)), longs(np.array(b, np.uint64))])

    return run


def _flips(most: int) -> list[int]:
    return [signed(sum(1 << i for i in bits)) for k in range(most + 1) for bits in itertools.combinations(range(BITS), k)]


def near_links(prints: DataFrame, radius: int = 3, blocks: int = 6, bucket_limit: int = 2000) -> DataFrame:
    """Links (a, b) between distinct ``sh_print`` values that connect all within ``radius`` bits."""
    tables = F.array(
        *[
            F.struct(F.lit(i).alias("t"), F.col("sh_print").bitwiseAND(F.lit(signed(m))).alias("k"))
            for i, m in enumerate(block_masks(blocks, radius))
        ]
    )
    keyed = prints.select("sh_print", F.explode(tables).alias("sh_key")).select("sh_key.t", "sh_key.k", "sh_print")
    sizes = keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = keyed.join(sizes, ["t", "k"])
    small = (
        shared.where(F.col("n") <= bucket_limit)
        .groupBy("t", "k")
        .agg(F.collect_list("sh_print").alias("sh_bucket"))
        .select("sh_bucket")
        .mapInArrow(_verify(radius), "a long, b long")
    )
    crowded = shared.where(F.col("n") > bucket_limit).select("sh_print").distinct()

    def around(most: int) -> DataFrame:
        flips = F.explode(F.array(*[F.lit(x) for x in _flips(most)]))
        return crowded.select("sh_print", flips.alias("f")).select("sh_print", F.col("sh_print").bitwiseXOR(F.col("f")).alias("x"))

    hubs = around(radius // 2).groupBy("x").agg(F.min("sh_print").alias("a"))
    met = around(radius - radius // 2).join(hubs, "x").select("a", F.col("sh_print").alias("b")).where("a <> b")
    return small.unionByName(met.distinct())


def simhash_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, blocks: int = 6, width: int = 3
) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (least id reachable).

    Null and blank texts have fingerprint zero and link like any other. Repeated rows give repeated
    rows. A null id takes the component of its fingerprint's links (null if no id is there). An empty
    table gives no rows; other columns are not read.
    """
    found = materialize(fingerprints(docs, id_col, text_col, width))
    nodes = found.groupBy("sh_print").agg(F.min("sh_id").alias("least"))
    linked = components(near_links(nodes.select("sh_print"), radius, blocks))
    rooted = nodes.join(linked.withColumnRenamed("node", "sh_print"), "sh_print", "left").withColumn(
        "root", F.coalesce("root", "sh_print")
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("sh_print", "component_id")
    return found.join(named, "sh_print").select(
        F.col("sh_id").alias(id_col), F.lower(F.lpad(F.hex("sh_print"), 16, "0")).alias("fingerprint"), "component_id"
    )
