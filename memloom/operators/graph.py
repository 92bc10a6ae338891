"""Temporal knowledge graph over entity and triple tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom.functions import fixed
from memloom.functions import text as T


def predicate_aliases(spark: SparkSession) -> DataFrame:
    """(alias, canonical, swap): under 200 fixed rows."""
    rows = [(a, c, False) for c, names in fixed.PREDICATE_ALIASES.items() for a in names]
    rows += [(a, c, True) for c, names in fixed.INVERSE_PREDICATE_ALIASES.items() for a in names]
    return spark.createDataFrame(rows, "alias string, canonical string, swap boolean")


def canonical_triples(triples: DataFrame) -> DataFrame:
    """Predicates in canonical form; inverse aliases swap subject and object."""
    a = F.broadcast(predicate_aliases(triples.sparkSession))
    key = T.normal_predicate(F.col("predicate"))
    out = triples.withColumn("gr_key", key).join(a, F.col("gr_key") == F.col("alias"), "left")
    swap = F.coalesce("swap", F.lit(False))
    return (
        out.withColumn("gr_s", F.when(swap, F.col("object")).otherwise(F.col("subject")))
        .withColumn("object", F.when(swap, F.col("subject")).otherwise(F.col("object")))
        .withColumn("subject", F.col("gr_s"))
        .withColumn("predicate", F.coalesce("canonical", "gr_key"))
        .select(*triples.columns)
    )


def entity_id(canonical, kind):
    return T.short_hash(F.concat_ws("|", canonical, F.lower(kind)))


def upsert_entities(mentions: DataFrame, order: str) -> DataFrame:
    """One entity per canonical name: the last name, the first type, from (name, type, ``order``)."""
    c = T.canonical_name(F.col("name"))
    out = mentions.withColumn("canonical_name", c).groupBy("canonical_name").agg(
        F.max_by("name", order).alias("name"), F.min_by("type", order).alias("type"), F.count(F.lit(1)).alias("mentions")
    )
    return out.select(entity_id(F.col("canonical_name"), F.col("type")).alias("id"), "name", "canonical_name", "type", "mentions")


def with_triple_ids(triples: DataFrame) -> DataFrame:
    return triples.withColumn("id", T.short_hash(F.concat_ws("|", "subject", "predicate", "object", F.date_format("valid_from", "yyyy-MM-dd"))))


def as_of(triples: DataFrame, day) -> DataFrame:
    """Triples valid on a day: from inclusive, to exclusive, open ends."""
    d = F.lit(day).cast("date")
    return triples.where((F.col("valid_from").isNull() | (F.col("valid_from") <= d)) & (F.col("valid_to").isNull() | (F.col("valid_to") > d)))


def neighbourhood(triples: DataFrame, entity: str, day, direction: str = "both") -> DataFrame:
    valid = as_of(triples, day)
    out, into = F.col("subject") == entity, F.col("object") == entity
    return valid.where({"out": out, "in": into, "both": out | into}[direction])


def invalidate(triples: DataFrame, ended: DataFrame) -> DataFrame:
    """Open triples that ``ended`` names (subject, predicate, object, ended) get their end."""
    e = canonical_triples(ended.select("subject", "predicate", "object", "ended")).groupBy("subject", "predicate", "object").agg(F.min("ended").alias("gr_end"))
    out = triples.join(e, ["subject", "predicate", "object"], "left")
    return out.withColumn("valid_to", F.coalesce("valid_to", "gr_end")).select(*triples.columns)


def touching(entities: DataFrame, triples: DataFrame) -> DataFrame:
    """(entity id, triple) by subject or object, as two equi-joins; a loop counts once."""
    e = entities.select(F.col("id").alias("entity"))
    out = triples.join(e, F.col("subject") == F.col("entity"))
    into = triples.where("subject <> object").join(e, F.col("object") == F.col("entity"))
    return out.unionByName(into)


def two_hop(entities: DataFrame, triples: DataFrame, tokens: list[str]) -> DataFrame:
    """(drawer_id, confidence): best confidence over triples one or two hops from entities named by a token."""
    name = T.strip_accents(F.col("name"))
    hit = None
    for t in tokens:
        hit = name.contains(t) if hit is None else hit | name.contains(t)
    start = entities.where(hit if hit is not None else F.lit(False)).select("id")
    first = touching(start, triples)
    near = first.select(F.when(F.col("subject") == F.col("entity"), F.col("object")).otherwise(F.col("subject")).alias("gr_n")).distinct()
    second = triples.join(near, F.col("subject") == F.col("gr_n"))
    both = first.select("drawer_id", "confidence").unionByName(second.select("drawer_id", "confidence"))
    return both.where("drawer_id is not null").groupBy("drawer_id").agg(F.max("confidence").alias("confidence"))


def conflicts(triples: DataFrame) -> DataFrame:
    """Open triples with exactly one other open object of the same subject and predicate."""
    live = triples.where("valid_to is null").select("subject", "predicate", "object").distinct()
    n = F.count(F.lit(1)).over(Window.partitionBy("subject", "predicate"))
    low, high = (f("object").over(Window.partitionBy("subject", "predicate")) for f in (F.min, F.max))
    out = live.withColumn("n", n).withColumn("other", F.when(F.col("object") == low, high).otherwise(low))
    return out.where("n = 2").select("subject", "predicate", "object", "other")


def gap_candidates(entities: DataFrame, triples: DataFrame, pages: DataFrame, least: int = 5, most: int = 50) -> DataFrame:
    """Entities of ``least`` triples or more that no page path names, most connected first."""
    counted = touching(entities, triples).groupBy("entity").agg(F.count(F.lit(1)).alias("n_triples")).where(F.col("n_triples") >= least)
    named = counted.join(entities.select(F.col("id").alias("entity"), "name", T.slug(F.col("name")).alias("gr_slug")), "entity")
    top = named.orderBy(F.desc("n_triples"), "entity").limit(most)
    return top.join(pages.select("path"), F.col("path").contains(F.col("gr_slug")), "left_anti").select("entity", "name", "n_triples")


def mention_counts(entities: DataFrame, triples: DataFrame) -> DataFrame:
    return touching(entities, triples).groupBy("entity").agg(F.countDistinct("drawer_id").alias("mentions"))


def updated_confidence(triples: DataFrame, mentions: DataFrame, day) -> DataFrame:
    """Open triples: base from mentions, fading with age; the better of the two ends' bases counts."""
    base = mentions.select(F.col("entity").alias("gr_e"), F.least(F.lit(1.0), 0.5 + 0.075 * (F.col("mentions") - 1)).alias("gr_b"))
    s = base.select(F.col("gr_e").alias("subject"), F.col("gr_b").alias("gr_bs"))
    o = base.select(F.col("gr_e").alias("object"), F.col("gr_b").alias("gr_bo"))
    joined = triples.join(s, "subject", "left").join(o, "object", "left")
    b = F.greatest(F.coalesce("gr_bs", F.lit(0.5)), F.coalesce("gr_bo", F.lit(0.5)))
    days = F.datediff(F.lit(day).cast("date"), F.col("valid_from"))
    fresh = F.greatest(F.lit(0.05), F.least(F.lit(1.0), b * F.exp(-days / 180.0)))
    return joined.withColumn("confidence", F.when(F.col("valid_to").isNull() & F.col("valid_from").isNotNull(), fresh).otherwise(F.col("confidence"))).select(*triples.columns)


def graph_stats(entities: DataFrame, triples: DataFrame) -> DataFrame:
    """One row of three counts."""
    e = entities.agg(F.count(F.lit(1)).alias("n_entities"))
    return e.join(triples.agg(F.count(F.lit(1)).alias("n_triples"), F.count_if(F.col("valid_to").isNull()).alias("n_open")))


def named_triples(triples: DataFrame, entities: DataFrame, n: int) -> DataFrame:
    """Distinct open triples with names, by confidence and date."""
    names = entities.select("id", "name")
    s = names.select(F.col("id").alias("subject"), F.col("name").alias("gr_s"))
    o = names.select(F.col("id").alias("object"), F.col("name").alias("gr_o"))
    out = triples.where("valid_to is null").join(s, "subject", "left").join(o, "object", "left")
    rows = out.groupBy(F.coalesce("gr_s", "subject").alias("subject_name"), "predicate", F.coalesce("gr_o", "object").alias("object_name")).agg(
        F.max("confidence").alias("confidence"), F.max("valid_from").alias("valid_from")
    )
    return rows.orderBy(F.desc("confidence"), F.desc("valid_from"), "subject_name", "predicate", "object_name").limit(n)


def newest_per_entity(entities: DataFrame, triples: DataFrame, n: int = 10) -> DataFrame:
    w = Window.partitionBy("entity").orderBy(F.desc("valid_from"), "subject", "predicate", "object")
    open_ = touching(entities, triples.where("valid_to is null"))
    return open_.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def match_entities(entities: DataFrame, text: str, n: int = 5) -> DataFrame:
    """Entities whose whole name, or an alias in their JSON properties, is a word of the text; longest first."""
    terms = F.filter(F.split(T.strip_accents(F.lit(text)), " "), lambda t: F.length(t) >= 3)
    aliases = F.from_json("properties", "aliases array<string>")["aliases"]
    hit = F.array_contains(terms, T.strip_accents(F.col("name"))) | F.coalesce(
        F.arrays_overlap(F.transform(aliases, lambda a: T.strip_accents(a)), terms), F.lit(False)
    )
    return entities.where(hit).orderBy(F.desc(F.length("name")), "id").limit(n)


def tunnel_ids(tunnels: DataFrame) -> DataFrame:
    """Undirected links: ends in order, so both directions have one id."""
    a, b = F.concat_ws("/", "wing_a", "room_a"), F.concat_ws("/", "wing_b", "room_b")
    low, high = F.least(a, b), F.greatest(a, b)
    return tunnels.select("topic", low.alias("end_a"), high.alias("end_b"), T.short_hash(F.concat_ws("|", "topic", low, high)).alias("id")).distinct()


def other_end(tunnels: DataFrame, end: str) -> DataFrame:
    return tunnels.where((F.col("end_a") == end) | (F.col("end_b") == end)).select(
        "topic", F.when(F.col("end_a") == end, F.col("end_b")).otherwise(F.col("end_a")).alias("other")
    )


def merge_entities(entities: DataFrame, triples: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Redirect triples from aliases to canonical ids (``mapping``: alias, canonical), drop aliases, note them as JSON."""
    m = mapping.where("alias <> canonical")
    s = m.select(F.col("alias").alias("subject"), F.col("canonical").alias("gr_s"))
    o = m.select(F.col("alias").alias("object"), F.col("canonical").alias("gr_o"))
    moved = triples.join(s, "subject", "left").join(o, "object", "left")
    moved = moved.withColumn("subject", F.coalesce("gr_s", "subject")).withColumn("object", F.coalesce("gr_o", "object")).select(*triples.columns)
    names = m.join(entities.select(F.col("id").alias("alias"), "name"), "alias").groupBy(F.col("canonical").alias("id")).agg(F.sort_array(F.collect_set("name")).alias("gr_a"))
    kept = entities.join(m.select(F.col("alias").alias("id")), "id", "left_anti").join(names, "id", "left")
    kept = kept.withColumn("properties", F.when(F.col("gr_a").isNotNull(), F.to_json(F.struct(F.col("gr_a").alias("aliases")))).otherwise(F.col("properties")))
    return kept.select(*entities.columns), moved


def rename_predicates(triples: DataFrame, mapping: DataFrame) -> DataFrame:
    m = mapping.select(F.col("alias").alias("predicate"), F.col("canonical").alias("gr_c"))
    return triples.join(m, "predicate", "left").withColumn("predicate", F.coalesce("gr_c", "predicate")).select(*triples.columns)


def plausible(triples: DataFrame, most: int = 200) -> DataFrame:
    return triples.where((F.col("subject") != F.col("object")) & F.length("subject").between(1, most) & F.length("predicate").between(1, most) & F.length("object").between(1, most))


def fact_paths(triples: DataFrame) -> DataFrame:
    """Two-hop paths: a triple and one that starts where it ends."""
    a = triples.select(F.col("subject").alias("s"), F.col("predicate").alias("p1"), F.col("object").alias("via"))
    b = triples.select(F.col("subject").alias("via"), F.col("predicate").alias("p2"), F.col("object").alias("o"))
    return a.join(b, "via").where("s <> o").select("s", "p1", "via", "p2", "o")


def predicate_boost(docs: DataFrame, patterns: DataFrame, weight: float = 0.1, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, boost): 0.1 for each pattern (s, p, o) whose parts follow each other in the text. Patterns are a query's few."""
    low = F.lower(F.col(text_col))
    s, p, o = (F.lower(c) for c in ("s", "p", "o"))
    at_s = F.instr(low, s)
    rest = F.expr(f"substring(lower({text_col}), instr(lower({text_col}), lower(s)) + length(s))")
    after = F.when(F.instr(rest, p) > 0, F.substring(rest, F.instr(rest, p) + F.length(p), F.length(rest)))
    hit = (at_s > 0) & (F.instr(after, o) > 0)
    return docs.join(F.broadcast(patterns), hit).groupBy(id_col).agg((weight * F.count(F.lit(1))).alias("boost"))
