"""Benchmark decontamination in DataFrame functions only.

Texts are words of letters and digits (lower case) and hashed shingles of five words. For each item
of m shingles, windows of m shingles of the documents get SimHash fingerprints. Fingerprints of
windows and items are cut into ``radius + 1`` blocks; two within ``radius`` bits agree on at least
one whole block, so a join on blocks finds every such pair. Pairs are then verified by the exact
weighted Jaccard similarity of their shingle multisets.

Which windows are fingerprinted: a window of m shingles can only have similarity s to an item of that size if it
holds at least 2 m s / (1 + s) shingles of such items. Places of item shingles come from a join of all shingles of all
documents with those of the benchmark; from the sorted places of a document follow, in linear time, all windows
that hold enough of them. This drops no window that could pass the verification, whatever the order of its words,
and leaves the block join few windows besides the contaminated ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import materialize

WIDTH = 5
RADIUS = 16
SIMILARITY = 0.8
#: Benchmarks of more shingles than this are joined by shuffle instead of broadcast (about 40 bytes each).
BROADCAST_SHINGLES = 2_000_000
#: Three counters of 21 bits fit a long: one sum counts three bits of many hashes.
LANE, LANES = 21, 3
SUMS = (64 + LANES - 1) // LANES
WORD_BREAK = r"[^a-z0-9\x{80}-\x{10FFFF}]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), WORD_BREAK), lambda x: x != "")


def shingles(text: Column) -> Column:
    """Hashes of all runs of five words of a text; the whole sequence if shorter, none if there are no words.

    The words are bound to a lambda variable: as a column of an inner projection, the optimizer would
    inline their split into the inner function and repeat it for every word.
    """

    def of(t: Column) -> Column:
        runs = F.transform(
            F.slice(t, F.lit(1), F.greatest(F.size(t) - (WIDTH - 1), F.lit(0))),
            lambda x, i: F.xxhash64(x, *[F.get(t, i + k) for k in range(1, WIDTH)]),
        )
        whole = F.array(F.xxhash64(F.array_join(t, " ")))
        return F.when(F.size(t) >= WIDTH, runs).when(F.size(t) > 0, whole).otherwise(F.array().cast("array<bigint>"))

    return F.get(F.transform(F.array(words(text)), of), F.lit(0))


def _lanes(h: Column) -> list[Column]:
    """Sums over the hashes of a group; lane j of sum i counts bit i + SUMS * j."""

    def bit(i):
        return F.shiftrightunsigned(h, i).bitwiseAND(F.lit(1).cast("long"))

    out = []
    for i in range(SUMS):
        x = bit(i)
        for j in range(1, LANES):
            if i + SUMS * j < 64:
                x = x.bitwiseOR(F.shiftleft(bit(i + SUMS * j), LANE * j))
        out.append(F.sum(x).alias(f"dc_s{i}"))
    return out


def _fingerprint(count: Column) -> Column:
    """Bits set in over half of ``count`` hashes."""
    out = F.lit(0).cast("long")
    for b in range(64):
        lane = F.shiftrightunsigned(F.col(f"dc_s{b % SUMS}"), LANE * (b // SUMS)).bitwiseAND(F.lit((1 << LANE) - 1).cast("long"))
        mask = 1 << b if b < 63 else -(1 << 63)
        out = out.bitwiseOR(F.when(2 * lane > count, F.lit(mask).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def _blocks(fingerprint: str, radius: int) -> Column:
    """(block number, block value) of radius + 1 blocks."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("no"),
                F.shiftrightunsigned(F.col(fingerprint), a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long")).alias("value"),
            )
            for i, (a, b) in enumerate(zip(edges, edges[1:]))
        ]
    )


def _windows(places: Column, m: Column, similarity: float) -> Column:
    """(first, place, alignment) of the windows of m shingles with enough known places; ``places``: sorted (pos, a)."""
    need = F.greatest(F.ceil(2 * m * similarity / (1 + similarity) - 1e-9), F.lit(1)).cast("int")

    def starts(p, i):
        last = F.get(places, i + need - 1)["pos"]  # the window must reach this one
        low = F.greatest(F.coalesce(F.get(places, i - 1)["pos"] + 1, F.lit(0)), last - m + 1, F.lit(0))
        return F.when(
            last.isNotNull() & (low <= p["pos"]),
            F.transform(F.sequence(low, p["pos"]), lambda x: F.struct(x.alias("first"), p["pos"].alias("pos"), p["a"].alias("a"))),
        )

    return F.flatten(F.filter(F.transform(places, starts), lambda x: x.isNotNull()))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    radius: int = RADIUS,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """(id, item, similarity, first_word) of the best window of each document and item at ``similarity`` or more.

    Null texts, and items or documents without words, match nothing. An item of fewer than five words
    matches only a document that is those words and nothing else. Repeated rows (equal id and text) are searched
    once; a null id is an id like others. Different texts of one id are each searched, and the best place of all
    of them is told, the first of equals. Rows of one item id with different texts are items of their own; the
    same item row twice counts once. Empty tables give no rows; other columns are not read.
    """
    items = (
        benchmark.select(F.col(item_col).alias("dc_item"), shingles(F.col(item_text)).alias("dc_own"))
        .where(F.size("dc_own") > 0)
        .withColumn("dc_m", F.size("dc_own"))
        .withColumn("dc_key", F.xxhash64("dc_item", F.col("dc_item").isNull(), "dc_own"))
    )
    items = materialize(items.dropDuplicates())
    n_shingles = items.agg(F.coalesce(F.sum("dc_m"), F.lit(0))).first()[0]
    small = n_shingles <= BROADCAST_SHINGLES
    sized = (lambda d: F.broadcast(d)) if small else (lambda d: d)

    known = items.select("dc_m", F.posexplode("dc_own").alias("dc_ipos", "dc_h")).distinct()
    of_docs = docs.select(F.col(id_col).alias("dc_id"), F.xxhash64(F.col(text_col)).alias("dc_text"), shingles(F.col(text_col)).alias("dc_all"))
    # Alignment a: where the item would begin. Windows with a place of this alignment begin at a - m + 1 .. a + m - 1.
    a, m = F.col("dc_pos") - F.col("dc_ipos"), F.col("dc_m")
    low = F.greatest(F.col("dc_a") - m + 1, F.lit(0))
    around = F.slice("dc_all", low + 1, F.col("dc_a") + 2 * m - low - 1)
    key = ["dc_id", "dc_text", "dc_m", "dc_a"]
    places = of_docs.select("dc_id", "dc_text", *(["dc_all"] if small else []), F.posexplode("dc_all").alias("dc_pos", "dc_h"))
    hits = places.join(sized(known), "dc_h").withColumn("dc_a", a)
    found = F.collect_set("dc_pos").alias("dc_found")
    if small:
        aligned = hits.select(*key, "dc_pos", around.alias("dc_ctx")).groupBy(*key).agg(found, F.max("dc_ctx").alias("dc_ctx"))
    else:  # places are shuffled alone; the surroundings of those that hit are fetched from the documents
        met = hits.groupBy(*key).agg(found)
        texts = of_docs.dropDuplicates(["dc_id", "dc_text"])
        same = met["dc_id"].eqNullSafe(texts["dc_id"]) & (met["dc_text"] == texts["dc_text"])
        aligned = met.join(texts, same).select(*[met[c] for c in key], "dc_found", around.alias("dc_ctx"))
    aligned = materialize(aligned.withColumn("dc_low", low).withColumn("dc_row", F.xxhash64(*key, F.col("dc_id").isNull())))
    sorted_places = (
        aligned.select("dc_id", "dc_text", "dc_m", "dc_a", F.explode("dc_found").alias("dc_pos"))
        .groupBy("dc_id", "dc_text", "dc_m", "dc_pos").agg(F.min("dc_a").alias("dc_a"))
        .groupBy("dc_id", "dc_text", "dc_m").agg(F.array_sort(F.collect_list(F.struct(F.col("dc_pos").alias("pos"), F.col("dc_a").alias("a")))).alias("dc_places"))
    )
    begun = sorted_places.select("dc_id", "dc_text", "dc_m", F.explode(_windows(F.col("dc_places"), m, similarity)).alias("w"))
    windows = materialize(
        begun.select(F.xxhash64("dc_id", "dc_text", "dc_m", "w.a", F.col("dc_id").isNull()).alias("dc_row"), F.col("w.first").alias("dc_first"))
        .join(aligned, "dc_row")
        .select("dc_row", "dc_id", "dc_m", "dc_first", F.slice("dc_ctx", F.col("dc_first") - F.col("dc_low") + 1, m).alias("dc_own"))
        .where(F.size("dc_own") == m)  # not beyond the end of the text
    )
    prints = (
        windows.select("dc_row", "dc_m", "dc_first", F.explode("dc_own").alias("dc_h"))
        .groupBy("dc_row", "dc_m", "dc_first")
        .agg(*_lanes(F.col("dc_h")))
        .select("dc_row", "dc_m", "dc_first", _fingerprint(F.col("dc_m")).alias("dc_print"))
    )
    item_prints = (
        items.select("dc_key", "dc_m", F.explode("dc_own").alias("dc_h"))
        .groupBy("dc_key", "dc_m")
        .agg(*_lanes(F.col("dc_h")))
        .select("dc_key", "dc_m", _fingerprint(F.col("dc_m")).alias("dc_iprint"))
    )
    item_blocks = item_prints.select("dc_key", "dc_m", "dc_iprint", F.explode(_blocks("dc_iprint", radius)).alias("dc_b"))
    near = (
        prints.select("dc_row", "dc_m", "dc_first", "dc_print", F.explode(_blocks("dc_print", radius)).alias("dc_b"))
        .join(sized(item_blocks), ["dc_m", "dc_b"])
        .where(F.bit_count(F.col("dc_print").bitwiseXOR(F.col("dc_iprint"))) <= radius)
        .select("dc_row", "dc_m", "dc_first", "dc_key")
        .distinct()
    )
    # Weighted similarity: the sum of the least over the sum of the greatest multiplicities, by counts of equal shingles.
    pair = ["dc_row", "dc_first", "dc_key"]
    counts = (
        near.join(windows.select("dc_row", "dc_first", "dc_own"), ["dc_row", "dc_first"])
        .select(*pair, "dc_m", F.explode("dc_own").alias("dc_h"))
        .groupBy(*pair, "dc_m", "dc_h").agg(F.count(F.lit(1)).alias("dc_n"))
    )
    item_counts = items.select("dc_key", F.explode("dc_own").alias("dc_h")).groupBy("dc_key", "dc_h").agg(F.count(F.lit(1)).alias("dc_in"))
    shared = F.sum(F.least("dc_n", "dc_in"))
    score = counts.join(sized(item_counts), ["dc_key", "dc_h"]).groupBy(*pair, "dc_m").agg((shared / (2 * F.col("dc_m") - shared)).alias("similarity"))
    return (
        score.where(F.col("similarity") >= similarity)
        .join(windows.select("dc_row", "dc_first", "dc_id"), ["dc_row", "dc_first"])
        .join(sized(items.select("dc_key", "dc_item")), "dc_key")
        .groupBy("dc_id", "dc_item")
        .agg(F.max("similarity").alias("similarity"), F.expr("min_by(dc_first, struct(-similarity, dc_first))").alias("first_word"))
        .select(F.col("dc_id").alias(id_col), F.col("dc_item").alias(item_col), "similarity", F.col("first_word").cast("long").alias("first_word"))
    )
