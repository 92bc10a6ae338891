"""Near copies by SimHash blocks and the exact Jaccard similarity of their sets of word shingles.

First the SimHash operator's own search (``simhash.near_links``: pigeonhole blocks, verified by Hamming distance)
links fingerprints of the sets within ``RADIUS`` bits, and these links are verified on the whole sets. At a similarity of
0.8, however, fingerprints of 64 bits differ in ten bits on average, and blocks that guarantee ten or more bits are
too short to tell documents apart. What SimHash leaves apart therefore meets once more, by an exact way: order the
shingles of each set by the number of sets that hold them, rarest first. Two sets of n and m shingles that are similar
share at least 0.8 of the larger one, so the first shingle that they share is among the first n - ceil(0.8 n) + 1 of the one and
the first m - ceil(0.8 m) + 1 of the other. Sets that share such a shingle (a bucket) and are in different components
are all compared, in integers; no bucket is cut. Most shingles are in one set only and come first, so most sets have no
bucket at all. Most of those are found from the shingles of hash below ``SOME`` alone: a set that has a similar one lacks at most
n - ceil(0.8 n) of its shingles there, so a set of which more are nowhere else has none. Only the others are counted whole, among themselves.

Sizes. Texts of equal sets are one node. Each node has a home, a part of bounded size of its largest bucket. In a bucket all nodes
but those of its most frequent component visit the bucket's homes, so a group that is linked already costs one
visit for each text that is not in it; a home meets its visitors one by one and gives links that join components, no more than it has rows.
If visits would be many, one member of each component of a bucket first meets one other member, in rounds that are
linear in the bucket, for as long as that saves visits; they save work only, the result is the same without them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import longs, materialize, prepared, raw_texts, row_key
from memloom.llm.simhash import near_links
from memloom.operators.components import components
from memloom.operators.skew import with_groups
from memloom.sources.store import settled
from memloom.llm.simhash_kernel import LOWER
from memloom.llm.textcore import MULT_A, WordCache, mix, split_words, word_hash

#: Differing bits of fingerprints that the blocks guarantee to find.
RADIUS = 3
#: Part of all shingles that is counted for all sets.
SOME = 0.3
#: Shingles of a home, and visitors that it meets in one place, on average.
HOME_SHINGLES, HOME_VISITS = 32_768, 128
#: Visits for each row of a bucket from which rounds go first.
MANY_VISITS = 4
#: Rows up to which a narrow table is broadcast.
BROADCAST_ROWS = 500_000
#: Words whose hashes a task keeps, and shingles that it gathers before it sends them on.
WORDS, HELD = 60_000, 250_000
FOUND = pa.schema([
    ("jc_row", pa.int64()), ("jc_id", pa.int64()), ("jc_node", pa.int64()), ("jc_size", pa.int64()), ("jc_some", pa.list_(pa.int64())),
])
SETS = pa.schema([("jc_node", pa.int64()), ("jc_size", pa.int64()), ("jc_print", pa.int64()), ("jc_set", pa.list_(pa.int64()))])
MET = pa.schema([("x", pa.int64()), ("y", pa.int64())])


def shingle_set(raw: bytes | None, width: int, hashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``width`` words (A-Z lower-cased); the whole text if shorter."""
    words = split_words(raw.translate(LOWER)) if raw else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter((hashes[w] for w in words), np.uint64, len(words))
    size = min(width, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = mix(out * np.uint64(MULT_A) + h[i : i + n])
    return np.unique(out)


def set_print(s: np.ndarray) -> np.uint64:
    """64-bit SimHash of a set of hashes: bits set in over half of them."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(s), 4096):
        counts += np.unpackbits(np.ascontiguousarray(s[i : i + 4096]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * counts > len(s), bitorder="little").view(np.uint64)[0]


def _by_text(schema: pa.Schema, width: int, columns):
    """Batches of bounded size of the columns that ``columns`` makes of a batch's rows and their sets."""

    def run(batches):
        hashes = WordCache(word_hash, WORDS)
        for batch in batches:
            start, held, sets = 0, 0, []
            for i, raw in enumerate(raw_texts(batch, "jc_text")):
                sets.append(shingle_set(raw, width, hashes))
                held += len(sets[-1])
                if held > HELD or i + 1 == batch.num_rows:
                    made = columns(batch.slice(start, i + 1 - start), sets)
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(made, schema)], schema=schema)
                    start, held, sets = i + 1, 0, []

    return run


def _look(width: int):
    """Node (a hash of the set), size and shingles of low hash of each text."""
    limit = np.uint64(int(SOME * (1 << 64)))

    def columns(batch, sets):
        nodes = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64)
        some = [longs(s[: np.searchsorted(s, limit)]) for s in sets]
        return batch.column("jc_row"), batch.column("jc_id"), longs(nodes), [len(s) for s in sets], some

    return _by_text(FOUND, width, columns)


def _whole(width: int):
    """Size, fingerprint and set of each text."""

    def columns(batch, sets):
        prints = np.array([set_print(s) for s in sets], np.uint64)
        return batch.column("jc_node"), [len(s) for s in sets], longs(prints), [longs(s) for s in sets]

    return _by_text(SETS, width, columns)


def _narrow(df: DataFrame) -> DataFrame:
    """A stored narrow table, broadcast if its checked size allows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _once(found: DataFrame) -> DataFrame:
    """One row of each node."""
    rows = found.select("jc_node", "jc_pos")
    many = rows.groupBy("jc_node").agg(F.min("jc_pos").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = materialize(with_groups(rows, many, ["jc_node"], "n", found.count()).where("jc_pos <> first").select("jc_pos"))
    return found.join(_narrow(again), "jc_pos", "left_anti")


def _least(percent: int):
    """Shingles of a set that a similar one holds at least."""
    return F.expr(f"int(({percent} * jc_size + 99) div 100)")


def _able(once: DataFrame, percent: int) -> DataFrame:
    """(jc_row, jc_node) of all sets that can have a similar one, by the shingles in ``jc_some``."""
    held = once.select("jc_pos", F.explode("jc_some").alias("k"))
    total = once.agg(F.sum(F.size("jc_some"))).first()[0] or 0
    counts = materialize(held.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    shared = with_groups(held, counts, ["k"], "n", total).groupBy("jc_pos").agg(F.count(F.lit(1)).alias("shared"))
    sizes = once.select("jc_pos", "jc_row", "jc_node", "jc_size", F.size("jc_some").alias("some")).join(shared, "jc_pos", "left")
    lacks = F.col("some") - F.coalesce("shared", F.lit(0))
    return sizes.where((F.col("jc_size") > 0) & (lacks <= F.col("jc_size") - _least(percent))).select("jc_row", "jc_node")


def _buckets(sets: DataFrame, percent: int) -> DataFrame:
    """(k, jc_node, jc_size, home) of all buckets of two or more nodes; see the module's first lines."""
    held = sets.select("jc_node", "jc_size", F.explode("jc_set").alias("k"))
    total = sets.agg(F.sum("jc_size")).first()[0] or 0
    counts = materialize(held.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    shared = with_groups(held, counts, ["k"], "n", total)
    # Shingles of one set only come first; what they leave of the first shingles goes by number and hash.
    ordered = shared.groupBy("jc_node", "jc_size").agg(F.sort_array(F.collect_list(F.struct("n", "k"))).alias("l"))
    left = F.size("l") - _least(percent) + 1
    first = ordered.where(left > 0).select("jc_node", "jc_size", F.explode(F.slice("l", F.lit(1), left)).alias("e"))
    rows = materialize(first.select("jc_node", "jc_size", F.col("e.k").alias("k")))
    sizes = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("jc_size").alias("all")).where("n > 1")
    sized = materialize(with_groups(rows, sizes, ["k"], "n", rows.count()))
    # Similar texts have their largest bucket in common most often.
    largest = sized.groupBy("jc_node").agg(F.max(F.struct("n", "k", "all")).alias("m"))
    part = F.pmod(F.xxhash64("jc_node"), F.ceil(F.col("m.all") / HOME_SHINGLES))
    homes = largest.select("jc_node", F.xxhash64("m.k", part).alias("home"))
    return sized.select("k", "jc_node", "jc_size").join(homes, "jc_node").select("k", "jc_node", "jc_size", "home")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have that similarity or more."""
    s, t = (sets.select(F.col("jc_node").alias(x), F.col("jc_set").alias(y)) for x, y in (("a", "s"), ("b", "t")))
    shared = F.size(F.array_intersect("s", "t"))
    return pairs.join(s, "a").join(t, "b").where((100 + percent) * shared >= percent * (F.size("s") + F.size("t"))).select("a", "b")


def _ends(links: DataFrame, roots: DataFrame) -> DataFrame:
    """The components (x, y) of linked nodes (a, b)."""
    return links.join(roots.toDF("a", "x"), "a").join(roots.toDF("b", "y"), "b").where("x <> y").select("x", "y").distinct()


def _merged(roots: DataFrame, ends: DataFrame) -> DataFrame:
    """``roots`` (jc_node, root) after the linked components (x, y) are joined."""
    moved = materialize(components(ends, "x", "y").toDF("root", "to"))
    # A component may hold very many nodes, which then need not meet in one task.
    return roots.join(_narrow(moved), "root", "left").select("jc_node", F.coalesce("to", "root").alias("root"))


def _close(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that connect all whose fingerprints are within ``RADIUS`` bits."""
    by_print = sets.select("jc_node", F.col("jc_print").alias("sh_print"))
    lead = by_print.groupBy("sh_print").agg(F.min("jc_node").alias("lead"), F.count(F.lit(1)).alias("n"))
    same = with_groups(by_print, lead.where("n > 1"), ["sh_print"], "n", by_print.count()).where("jc_node <> lead").select(F.col("lead").alias("x"), F.col("jc_node").alias("y"))
    near = near_links(lead.select("sh_print"), RADIUS)
    leads = lead.select("sh_print", "lead")
    across = near.join(leads.toDF("a", "x"), "a").join(leads.toDF("b", "y"), "b").select("x", "y")
    return same.unionByName(across).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _met(buckets: DataFrame, roots: DataFrame, number: int, percent: int) -> DataFrame:
    """Pairs (a, b) of one member of each component of a bucket with one of another, others for each number."""
    order = F.xxhash64(F.lit(number), "jc_node")
    one = buckets.join(roots, "jc_node").groupBy("k", "root").agg(F.min_by(F.struct(F.col("jc_node").alias("node"), F.col("jc_size").alias("size")), order).alias("m"))
    one = materialize(one)
    whole = F.struct("root", "m")
    centres = one.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min_by(whole, F.xxhash64(F.lit(number), F.col("m.node"))).alias("centre")).where("n > 1")
    few, many = F.least("m.size", "centre.m.size"), F.greatest("m.size", "centre.m.size")
    return (
        with_groups(one, centres, ["k"], "n", one.count()).where("root <> centre.root")
        # Similarity is at most the ratio of the sizes.
        .where(100 * few >= percent * many)
        .select(F.least("m.node", "centre.m.node").alias("a"), F.greatest("m.node", "centre.m.node").alias("b"))
        .distinct()
    )


def _mixed(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """(k, n, major, minor, homes) of buckets of several components: rows, most frequent component, rows of others, homes."""
    placed = buckets.join(roots, "jc_node")
    by_root = placed.groupBy("k", "root").agg(F.count(F.lit(1)).alias("n"))
    whole = by_root.groupBy("k").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("m")).where("n > m.n")
    homes = buckets.groupBy("k").agg(F.collect_set("home").alias("homes"))
    return whole.join(homes, "k").select("k", "n", F.col("m.root").alias("major"), (F.col("n") - F.col("m.n")).alias("minor"), "homes")


def _visits(buckets: DataFrame, roots: DataFrame, mixed: DataFrame) -> DataFrame:
    """(jc_node, home): of nodes of different components in a bucket one visits the other's home at least."""
    placed = materialize(buckets.join(roots, "jc_node").select("k", "jc_node", "root"))
    others = with_groups(placed, mixed, ["k"], "n", placed.count()).where("root <> major")
    return others.select("jc_node", F.explode("homes").alias("home")).distinct()


def _meet(percent: int):
    """Links that connect all similar sets of a home and its visitors; rows come by home, those who live there first."""

    def run(batches):
        home, index = None, None
        for batch in batches:
            x, y = [], []
            columns = (batch.column(c) for c in ("home", "slot", "guest", "root", "jc_set"))
            for place, slot, guest, root, s in zip(*columns):
                at, root, s = (place.as_py(), slot.as_py()), root.as_py(), s.values.to_numpy()
                if at != home:
                    home, index, lives, sets, joined = at, None, [], [], {}
                if not guest.as_py():
                    lives.append(root)
                    sets.append(s)
                    continue
                if index is None:
                    tokens, sizes, there = np.concatenate(sets), np.array([len(t) for t in sets]), np.array(lives, np.int64)
                    order = np.argsort(tokens)
                    index, who, sets = tokens[order], np.repeat(np.arange(len(sizes)), sizes)[order], []
                low, high = np.searchsorted(index, s, "left"), np.searchsorted(index, s, "right")
                n = high - low
                places = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
                shared = np.bincount(who[places], minlength=len(sizes))
                for other in np.unique(there[(100 + percent) * shared >= percent * (sizes + len(s))]).tolist():
                    a, b = _top(joined, root), _top(joined, other)
                    if a != b:
                        joined[max(a, b)] = min(a, b)
                        x.append(root)
                        y.append(other)
            if x:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], schema=MET)

    return run


def _top(joined: dict[int, int], x: int) -> int:
    while x in joined:
        if joined[x] in joined:
            joined[x] = joined[joined[x]]
        x = joined[x]
    return x


def _rest(buckets: DataFrame, sets: DataFrame, roots: DataFrame, mixed: DataFrame, percent: int) -> DataFrame:
    """Components (x, y) that hold similar sets, so that all similar sets of buckets are connected."""
    visits = materialize(_visits(buckets, roots, mixed))
    known = sets.select("jc_node", "home", "jc_set").join(roots, "jc_node")
    slots = visits.groupBy("home").agg(F.count(F.lit(1)).alias("n")).withColumn("slots", F.ceil(F.col("n") / HOME_VISITS))
    slots = materialize(slots)
    # A home of many visitors is copied, and each copy meets a part of them.
    own = known.join(slots, "home").select("home", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), F.lit(False).alias("guest"), "root", "jc_set")
    placed = with_groups(visits, slots, ["home"], "n", visits.count()).withColumn("slot", F.pmod(F.xxhash64("jc_node"), F.col("slots")))
    guests = placed.select("jc_node", "home", "slot").join(known.drop("home"), "jc_node").select("home", "slot", F.lit(True).alias("guest"), "root", "jc_set")
    by_home = own.unionByName(guests).repartition("home", "slot").sortWithinPartitions("home", "slot", "guest")
    return by_home.mapInArrow(_meet(percent), "x long, y long").distinct()


def _connected(sets: DataFrame, percent: int) -> DataFrame:
    """(jc_node, root) of the nodes of ``sets`` that are in a bucket."""
    spark = sets.sparkSession
    buckets = settled(spark, lambda: _buckets(sets, percent))
    homes = materialize(buckets.select("jc_node", "home").distinct())
    sets = settled(spark, lambda: sets.join(_narrow(homes), "jc_node"))
    roots = sets.select("jc_node", F.col("jc_node").alias("root"))
    if sets.isEmpty():
        return roots
    close = settled(spark, lambda: _verified(_close(sets), sets, percent))
    roots = settled(spark, lambda: _merged(roots, _ends(close, roots)))
    rows, number, before = buckets.count(), 0, float("inf")
    while True:
        mixed = settled(spark, lambda: _mixed(buckets, roots))
        visits = mixed.agg(F.sum(F.col("minor") * F.size("homes"))).first()[0] or 0
        if visits <= MANY_VISITS * rows or visits > 0.75 * before:
            break
        links = settled(spark, lambda: _verified(_met(buckets, roots, number, percent), sets, percent))
        roots, number, before = settled(spark, lambda: _merged(roots, _ends(links, roots))), number + 1, visits
    return settled(spark, lambda: _merged(roots, _rest(buckets, sets, roots, mixed, percent))) if visits else roots


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, width: int = 5) -> DataFrame:
    """(jc_row, jc_id, jc_root) of each row: the row key of ``common.row_key``, the id and the component of near copies.

    Two texts are linked if the Jaccard similarity of their sets of ``width``-word shingles is ``percent`` / 100 or
    more; texts without words (and null) are equal. Repeated rows give repeated rows; an empty table gives none.
    ``docs`` is read once and again for the sets of texts that may be similar, so it should be a stored table.
    """
    spark = docs.sparkSession
    base = prepared(docs, id_col, text_col).select(
        row_key(id_col, text_col).alias("jc_row"), F.col(id_col).cast("long").alias("jc_id"), F.col(text_col).alias("jc_text")
    )

    def looked() -> DataFrame:
        shape = "jc_row long, jc_id long, jc_node long, jc_size long, jc_some array<long>"
        return base.mapInArrow(_look(width), shape).withColumn("jc_pos", F.monotonically_increasing_id())

    def sets_of(able: DataFrame) -> DataFrame:
        texts = base.join(_narrow(able), "jc_row").select("jc_node", "jc_text")
        return texts.mapInArrow(_whole(width), "jc_node long, jc_size long, jc_print long, jc_set array<long>").dropDuplicates(["jc_node"])

    def whole() -> DataFrame:
        found = materialize(looked())
        able = settled(spark, lambda: _able(_once(found), percent))
        sets = materialize(sets_of(able))
        moved = settled(spark, lambda: _connected(sets, percent).where("root <> jc_node"))
        return found.join(_narrow(moved), "jc_node", "left").select("jc_row", "jc_id", F.coalesce("root", "jc_node").alias("jc_root"))

    return settled(spark, whole)
