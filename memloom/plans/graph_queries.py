"""Queries of the knowledge graph, memories, activity and calibration over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from memloom.operators import evaluation as E
from memloom.operators import graph as G
from memloom.operators import memory as M
from memloom.operators import wiki as W
from memloom.plans.registry import query
from memloom.plans.text_queries import table
from memloom.sources import store as S

# The star schema as a temporal graph: order placed_by customer, customer located_in nation, nation part_of region.
_TRIPLES = """t AS (
  SELECT 'o' || o_orderkey AS subject, 'placed_by' AS predicate, 'c' || o_custkey AS object, o_orderdate::DATE AS valid_from,
         CASE WHEN o_orderstatus = 'F' THEN o_orderdate::DATE + 90 END AS valid_to, 0.9 AS confidence, 'd' || (o_orderkey % 500) AS drawer_id FROM orders
  UNION ALL SELECT 'c' || c_custkey, 'located_in', 'n' || c_nationkey, DATE '1992-01-01', NULL, 0.8, 'd' || (c_custkey % 500) FROM customer
  UNION ALL SELECT 'n' || n_nationkey, 'part_of', 'r' || n_regionkey, DATE '1992-01-01', NULL, 1.0, 'd' || n_nationkey FROM nation),
 e AS (SELECT 'c' || c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'n' || n_nationkey, n_name FROM nation UNION ALL SELECT 'r' || r_regionkey, r_name FROM region)"""


def triples(spark, d):
    def key(prefix, col):
        return F.concat(F.lit(prefix), F.col(col).cast("string"))

    o = table(spark, d, "orders").select(
        key("o", "o_orderkey").alias("subject"), F.lit("placed_by").alias("predicate"), key("c", "o_custkey").alias("object"),
        F.to_date("o_orderdate").alias("valid_from"), F.when(F.col("o_orderstatus") == "F", F.date_add(F.to_date("o_orderdate"), 90)).alias("valid_to"),
        F.lit(0.9).alias("confidence"), F.concat(F.lit("d"), (F.col("o_orderkey") % 500).cast("string")).alias("drawer_id"),
    )
    first, never = F.lit("1992-01-01").cast("date"), F.lit(None).cast("date")
    c = table(spark, d, "customer").select(
        key("c", "c_custkey").alias("subject"), F.lit("located_in").alias("predicate"), key("n", "c_nationkey").alias("object"), first.alias("valid_from"),
        never.alias("valid_to"), F.lit(0.8).alias("confidence"), F.concat(F.lit("d"), (F.col("c_custkey") % 500).cast("string")).alias("drawer_id"),
    )
    n = table(spark, d, "nation").select(
        key("n", "n_nationkey").alias("subject"), F.lit("part_of").alias("predicate"), key("r", "n_regionkey").alias("object"), first.alias("valid_from"),
        never.alias("valid_to"), F.lit(1.0).alias("confidence"), key("d", "n_nationkey").alias("drawer_id"),
    )
    return o.unionByName(c).unionByName(n)


def entities(spark, d):
    parts = [("customer", "c", "c_custkey", "c_name"), ("nation", "n", "n_nationkey", "n_name"), ("region", "r", "r_regionkey", "r_name")]
    rows = [table(spark, d, t).select(F.concat(F.lit(p), F.col(k).cast("string")).alias("id"), F.col(v).alias("name")) for t, p, k, v in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("triple_ids", f"WITH {_TRIPLES} SELECT DISTINCT left(sha256(subject || '|' || predicate || '|' || object || '|' || strftime(valid_from, '%Y-%m-%d')), 16) AS id, subject, object FROM t")
def triple_ids(spark, d):
    return G.with_triple_ids(triples(spark, d)).select("id", "subject", "object").distinct()


@query("graph_as_of", f"WITH {_TRIPLES} SELECT subject, predicate, object FROM t WHERE valid_from <= DATE '1996-06-01' AND (valid_to IS NULL OR valid_to > DATE '1996-06-01') AND (subject = 'c1' OR object = 'c1')")
def graph_as_of(spark, d):
    return G.neighbourhood(triples(spark, d), "c1", "1996-06-01").select("subject", "predicate", "object")


@query(
    "graph_two_hop",
    f"""WITH {_TRIPLES}, s AS (SELECT id FROM e WHERE lower(name) LIKE '%africa%' OR lower(name) LIKE '%asia%' OR lower(name) LIKE '%nation_1%' OR lower(name) LIKE '%region_1%'),
    h AS (SELECT t.*, s.id AS en FROM t JOIN s ON t.subject = s.id UNION ALL SELECT t.*, s.id FROM t JOIN s ON t.object = s.id WHERE subject <> object),
    n AS (SELECT DISTINCT CASE WHEN subject = en THEN object ELSE subject END AS nb FROM h)
    SELECT drawer_id, max(confidence)::DOUBLE AS confidence FROM (SELECT drawer_id, confidence FROM h UNION ALL SELECT drawer_id, confidence FROM t JOIN n ON t.subject = nb) GROUP BY 1""",
)
def graph_two_hop(spark, d):
    return G.two_hop(entities(spark, d), triples(spark, d), ["africa", "asia", "nation_1", "region_1"])


@query(
    "graph_conflicts",
    """WITH l AS (SELECT DISTINCT l_partkey AS s, l_suppkey AS o FROM lineitem WHERE l_returnflag = 'R'), n AS (SELECT s, min(o) AS lo, max(o) AS hi FROM l GROUP BY 1 HAVING count(*) = 2)
    SELECT s::VARCHAR AS subject, o::VARCHAR AS object, CASE WHEN o = lo THEN hi ELSE lo END::VARCHAR AS other FROM l JOIN n USING (s)""",
)
def graph_conflicts(spark, d):
    """Parts with exactly two suppliers of returned lines."""
    li = table(spark, d, "lineitem").where("l_returnflag = 'R'")
    t = li.select(F.col("l_partkey").cast("string").alias("subject"), F.lit("supplied_by").alias("predicate"), F.col("l_suppkey").cast("string").alias("object"), F.lit(None).cast("date").alias("valid_to"))
    return G.conflicts(t).select("subject", "object", "other")


_TOUCH = "x AS (SELECT id AS entity, t.* FROM t JOIN e ON subject = id UNION ALL SELECT id, t.* FROM t JOIN e ON object = id WHERE subject <> object)"


@query("gap_candidates", f"WITH {_TRIPLES}, {_TOUCH} SELECT entity, any_value(name) AS name, count(*) AS n_triples FROM x JOIN e ON entity = e.id GROUP BY 1 HAVING count(*) >= 5 ORDER BY n_triples DESC, entity LIMIT 50")
def gap_candidates(spark, d):
    pages = table(spark, d, "pages").select(F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("path"))
    return G.gap_candidates(entities(spark, d), triples(spark, d), pages)


@query("mention_counts", f"WITH {_TRIPLES}, {_TOUCH} SELECT entity, count(DISTINCT drawer_id) AS mentions FROM x GROUP BY 1")
def mention_counts(spark, d):
    return G.mention_counts(entities(spark, d), triples(spark, d))


@query(
    "confidence_update",
    f"""WITH {_TRIPLES}, {_TOUCH}, m AS (SELECT entity, least(1.0, 0.5 + 0.075 * (count(DISTINCT drawer_id) - 1)) AS b FROM x GROUP BY 1)
    SELECT subject, object, round(CASE WHEN valid_to IS NULL THEN greatest(0.05, least(1.0, greatest(coalesce(s.b, 0.5), coalesce(o.b, 0.5)) * exp(-date_diff('day', valid_from, DATE '1998-12-01') / 180.0)))
      ELSE confidence END, 6)::DOUBLE AS confidence FROM t LEFT JOIN m s ON subject = s.entity LEFT JOIN m o ON object = o.entity""",
)
def confidence_update(spark, d):
    t = triples(spark, d)
    out = G.updated_confidence(t, G.mention_counts(entities(spark, d), t), "1998-12-01")
    return out.select("subject", "object", F.round("confidence", 6).alias("confidence"))


@query("graph_stats", f"WITH {_TRIPLES} SELECT (SELECT count(*) FROM e) AS n_entities, count(*) AS n_triples, count(*) FILTER (WHERE valid_to IS NULL) AS n_open FROM t")
def graph_stats(spark, d):
    return G.graph_stats(entities(spark, d), triples(spark, d))


@query(
    "active_triples",
    f"""WITH {_TRIPLES} SELECT coalesce(s.name, subject) AS subject_name, predicate, coalesce(o.name, object) AS object_name, max(confidence)::DOUBLE AS confidence, max(valid_from) AS valid_from
    FROM t LEFT JOIN e s ON subject = s.id LEFT JOIN e o ON object = o.id WHERE valid_to IS NULL GROUP BY 1, 2, 3 ORDER BY confidence DESC, valid_from DESC, 1, 2, 3 LIMIT 40""",
)
def active_triples(spark, d):
    return G.named_triples(triples(spark, d), entities(spark, d), 40)


@query("newest_triples", f"WITH {_TRIPLES}, {_TOUCH} SELECT entity, subject, object FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY valid_from DESC, subject, predicate, object) AS r FROM x WHERE valid_to IS NULL) WHERE r <= 10")
def newest_triples(spark, d):
    return G.newest_per_entity(entities(spark, d), triples(spark, d)).select("entity", "subject", "object")


@query("tunnels", """SELECT DISTINCT 'shared' AS topic, least(a, b) AS end_a, greatest(a, b) AS end_b, left(sha256('shared|' || least(a, b) || '|' || greatest(a, b)), 16) AS id
    FROM (SELECT lang || '/' || source AS a, 'en/' || source AS b FROM documents)""")  # fmt: skip
def tunnels(spark, d):
    t = table(spark, d, "documents").select(F.lit("shared").alias("topic"), F.col("lang").alias("wing_a"), F.col("source").alias("room_a"), F.lit("en").alias("wing_b"), F.col("source").alias("room_b"))
    return G.tunnel_ids(t)


@query(
    "predicate_aliases",
    "SELECT * FROM (VALUES ('c1', 'owns', 'o1'), ('o2', 'depends_on', 'o1'), ('o1', 'depends_on', 'o2'), ('a', 'created_by', 'b'), ('x', 'likes_to', 'y')) v(subject, predicate, object)",
)
def predicate_aliases(spark, d):
    rows = [("o1", "Owned By", "c1"), ("o2", "requires", "o1"), ("o2", "required-by", "o1"), ("b", "skapade", "a"), ("x", "likes  to", "y")]
    return G.canonical_triples(spark.createDataFrame(rows, "subject string, predicate string, object string"))


@query("invalidated", f"WITH {_TRIPLES} SELECT subject, coalesce(valid_to, CASE WHEN object = 'c2' THEN DATE '1999-01-01' END) AS valid_to FROM t WHERE predicate = 'placed_by'")
def invalidated(spark, d):
    t = triples(spark, d).where("predicate = 'placed_by'").withColumn("predicate", F.lit("owned_by"))
    t = G.canonical_triples(t)
    ended = t.where("subject = 'c2'").select("subject", "predicate", "object", F.lit("1999-01-01").cast("date").alias("ended"))
    return G.invalidate(t, ended).select(F.col("object").alias("subject"), "valid_to")


@query("merged_entities", f"WITH {_TRIPLES} SELECT CASE WHEN object IN ('n1', 'n2') THEN 'n0' ELSE object END AS object, count(*) AS n FROM t WHERE predicate = 'located_in' GROUP BY 1")
def merged_entities(spark, d):
    m = spark.createDataFrame([("n1", "n0"), ("n2", "n0")], "alias string, canonical string")
    e = entities(spark, d).withColumn("properties", F.lit("{}"))
    _, t = G.merge_entities(e, triples(spark, d), m)
    return t.where("predicate = 'located_in'").groupBy("object").agg(F.count(F.lit(1)).alias("n"))


@query("fact_paths", f"WITH {_TRIPLES} SELECT a.subject AS s, a.object AS via, b.object AS o FROM t a JOIN t b ON a.object = b.subject WHERE a.subject <> b.object AND a.predicate = 'located_in'")
def fact_paths(spark, d):
    return G.fact_paths(triples(spark, d)).where("p1 = 'located_in'").select("s", "via", "o")


@query("entity_upsert", "SELECT lower(replace(event_type, '_', '')) AS canonical_name, max_by(event_type, event_id) AS name, count(*) AS mentions FROM events GROUP BY 1")
def entity_upsert(spark, d):
    m = table(spark, d, "events").select(F.col("event_type").alias("name"), F.lit("concept").alias("type"), "event_id")
    return G.upsert_entities(m, "event_id").select("canonical_name", "name", "mentions")


# Memories, tools and activity -------------------------------------------------------------------


def calls(spark, d):
    ev = table(spark, d, "events")
    return ev.select(
        F.col("event_id").alias("id"), F.col("event_type").alias("tool_name"), (F.col("event_id") % 4 != 0).alias("success"), F.col("value").alias("score"),
        F.col("value").alias("time_seconds"), (F.col("event_id") % 100).cast("int").alias("token_cost"), F.col("ts").alias("called_at"),
    )


@query(
    "tool_statistics",
    """SELECT event_type AS tool_name, count(*) AS total, count(*) FILTER (WHERE event_id % 4 <> 0) AS successes, round((count(*) FILTER (WHERE event_id % 4 <> 0) + 1) / (count(*) + 2), 6) AS rate,
       round(avg(coalesce(value, 0)), 6) AS avg_score, floor(avg(event_id % 100))::INT AS avg_tokens
    FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 150) GROUP BY 1""",
)
def tool_statistics(spark, d):
    s = M.tool_statistics(calls(spark, d), 150)
    return s.select("tool_name", "total", "successes", F.round("rate", 6).alias("rate"), F.round("avg_score", 6).alias("avg_score"), "avg_tokens")


@query("recent_activity", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 25")
def recent_activity(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(25).select("event_id", "event_type")


@query("commonest_values", "SELECT user_id % 50 AS grp, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id % 50 ORDER BY c DESC, event_type) AS r FROM (SELECT user_id % 50 AS user_id, event_type, count(*) AS c FROM events GROUP BY ALL)) WHERE r = 1")
def commonest_values(spark, d):
    ev = table(spark, d, "events").withColumn("grp", F.col("user_id") % 50)
    return M.commonest(ev, "grp", "event_type")


@query("recent_users", "SELECT user_id, max(ts) AS latest FROM events GROUP BY 1 ORDER BY latest DESC, user_id LIMIT 30")
def recent_users(spark, d):
    return M.recent_distinct(table(spark, d, "events"), "user_id", "ts", 30)


@query("best_and_worst", "SELECT user_id, max_by(event_id, (value, -event_id)) AS best, min_by(event_id, (value, event_id)) AS worst FROM events WHERE value IS NOT NULL GROUP BY 1 HAVING count(*) >= 2 AND max(value) > min(value)")
def best_and_worst(spark, d):
    ev = table(spark, d, "events").where("value is not null")
    return M.best_and_worst(ev, "user_id", "value", "event_id").select("user_id", "best", "worst")


@query("task_rerank", "SELECT doc_id AS id, round(0.6 * (n_chars % 97) / 97.0 + 0.3 * (doc_id % 10) / 10.0 + 0.1 * exp(-(n_chars % 60) / 30.0), 6) AS score FROM documents ORDER BY score DESC, id LIMIT 20")
def task_rerank(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), ((F.col("n_chars") % 97) / 97.0).alias("similarity"), ((F.col("doc_id") % 10) / 10.0).alias("worth"), (F.col("n_chars") % 60).alias("age_days"))
    out = M.reranked(rows, 10**6)
    return out.select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(20)


@query("utility_pruning", "SELECT user_id, count(*) AS retrieval_count, count(*) FILTER (WHERE event_type = 'purchase') AS utility_count FROM events GROUP BY 1 HAVING NOT (count(*) >= 5 AND count(*) FILTER (WHERE event_type = 'purchase') / count(*) < 0.5)")
def utility_pruning(spark, d):
    ev = table(spark, d, "events")
    c = ev.groupBy("user_id").agg(F.count(F.lit(1)).alias("retrieval_count"), F.count_if(F.col("event_type") == "purchase").alias("utility_count"))
    return M.pruned(c)


@query("event_counters", "SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS views, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1")
def event_counters(spark, d):
    return M.counters(table(spark, d, "events"), "user_id", {"views": "view", "errors": "error"}, "event_type")


@query("distinct_rooms", "SELECT lang, count(DISTINCT source) AS rooms, count(*) AS n FROM documents GROUP BY 1")
def distinct_rooms(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.countDistinct("source").alias("rooms"), F.count(F.lit(1)).alias("n"))


@query("table_counts", "SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'embeddings', count(*) FROM embeddings")
def table_counts(spark, d):
    out = None
    for t in ("documents", "pages", "events", "embeddings"):
        one = table(spark, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("activity_rollup", "SELECT event_type, date_trunc('month', ts)::DATE AS month, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ROLLUP (event_type, date_trunc('month', ts)::DATE)")
def activity_rollup(spark, d):
    ev = table(spark, d, "events").withColumn("month", F.to_date(F.date_trunc("month", "ts")))
    return ev.rollup("event_type", "month").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("upserted_rows", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'changed' ELSE c_mktsegment END AS segment, c_nationkey AS nation FROM customer UNION ALL SELECT c_custkey + 10000000, 'changed', c_nationkey FROM customer WHERE c_custkey % 3 = 0")
def upserted_rows(spark, d):
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    some = t.where("id % 3 = 0").withColumn("segment", F.lit("changed"))
    new = some.withColumn("nation", F.col("nation")).unionByName(some.withColumn("id", F.col("id") + 10000000))
    return S.upsert(t, new, "id", ["segment"])


@query("inserted_absent", "SELECT c_custkey AS id FROM customer UNION SELECT c_custkey + 5 FROM customer")
def inserted_absent(spark, d):
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return S.insert_absent(t, t.withColumn("id", F.col("id") + 5))


# Pages ------------------------------------------------------------------------------------------


def wiki(spark, d):
    """Pages as synthesis pages: neighbours are linked, documents cited."""
    p = table(spark, d, "pages")
    i = F.col("page_id")

    def page(x):
        return F.concat(F.lit("topic/page-"), x.cast("string"))

    links = F.concat(F.lit("[["), page(i - i % 5), F.lit("]] and [["), page(i + 1), F.lit("]]"))
    return p.select(
        page(i).alias("path"), F.concat(F.lit("Title "), i.cast("string")).alias("title"), F.concat(links, F.lit(" ## "), "html").alias("content"),
        F.array(i.cast("string"), (i + 900).cast("string")).alias("citations"), (i % 10 / 10.0).alias("quality_score"),
    )


_WIKI = """p AS (SELECT page_id AS i, 'topic/page-' || page_id AS path FROM pages),
 l AS (SELECT DISTINCT path AS source, unnest(['topic/page-' || (i - i % 5), 'topic/page-' || (i + 1)]) AS target FROM p), k AS (SELECT * FROM l WHERE source <> target)"""


@query("wiki_backlinks", f"WITH {_WIKI} SELECT target AS path, count(DISTINCT source) AS n_backlinks FROM k GROUP BY 1")
def wiki_backlinks(spark, d):
    return W.backlinks(W.links(wiki(spark, d))).select("path", "n_backlinks")


@query("wiki_lint_counts", f"""WITH {_WIKI}, dr AS (SELECT doc_id::VARCHAR AS id FROM documents WHERE doc_id % 7 <> 0), c AS (SELECT path, unnest([i::VARCHAR, (i + 900)::VARCHAR]) AS id FROM p)
    SELECT 'BrokenCitation' AS rule, 'error' AS severity, count(*) AS n FROM c ANTI JOIN dr USING (id) HAVING count(*) > 0
    UNION ALL SELECT 'StalePage', 'warn', count(*) FROM (SELECT path FROM c LEFT JOIN dr ON c.id = dr.id GROUP BY 1 HAVING count(dr.id) = 0) HAVING count(*) > 0
    UNION ALL SELECT 'LowQuality', 'warn', count(*) FROM p WHERE i % 10 / 10.0 < 0.5 HAVING count(*) > 0""")  # fmt: skip
def wiki_lint_counts(spark, d):
    live = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.lit(None).cast("timestamp").alias("valid_to"), (F.col("doc_id") % 7 != 0).alias("is_representative"))
    queue = spark.createDataFrame([], "id string, page_path string, drawer_id string, similarity double, resolved_at timestamp, resolution string")
    found = W.lint(wiki(spark, d), live, queue).where(F.col("rule").isin("BrokenCitation", "StalePage", "LowQuality"))
    return W.lint_counts(found)


@query(
    "pending_updates",
    """WITH u AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings),
    x AS (SELECT label, generate_subscripts(u, 1) AS i, unnest(u) AS x FROM u), m AS (SELECT label, list(m ORDER BY i) AS m FROM (SELECT label, i, avg(x) AS m FROM x GROUP BY ALL) GROUP BY 1),
    s AS (SELECT u.label, vec_id, u, round(list_dot_product(u, m) / sqrt(list_dot_product(m, m)), 9) AS s FROM u JOIN m ON u.label = m.label),
    p AS (SELECT vec_id, u FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) = 1)
    SELECT left(sha256('topic/page-' || p.vec_id || '|' || a.vec_id), 16) AS id, 'topic/page-' || p.vec_id AS page_path, a.vec_id::VARCHAR AS drawer_id, round(list_dot_product(a.u, p.u), 6) AS similarity
    FROM u a JOIN p ON list_dot_product(a.u, p.u) >= 0.3 WHERE a.vec_id NOT IN (SELECT vec_id FROM p)""",
)
def pending_updates(spark, d):
    """Review queue: embeddings near a page's vector; the medoid of each label stands for a page."""
    from memloom.operators.cluster import medoids
    from memloom.sources.store import written

    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("cluster_id"))
    # Written once: the join reads the choice several times, and a page is one row, however many rows share its id.
    chosen = written(medoids(e, keep=("embedding",)))
    pages = chosen.select(F.concat(F.lit("topic/page-"), F.col("id").cast("string")).alias("path"), "embedding")
    return W.pending(e.join(chosen.select("id"), "id", "left_anti").select(F.col("id").cast("string").alias("id"), "embedding"), pages, threshold=0.3).withColumn("similarity", F.round("similarity", 6))


# Calibration ------------------------------------------------------------------------------------

_SCORED = "s AS (SELECT doc_id AS id, (n_chars % 1000) / 1000.0 AS score, quality AS relevant, lang = 'en' AS a, doc_id % 3 = 0 AS b, n_chars > 1000 AS c FROM documents JOIN labels USING (doc_id))"


def scored(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return docs.select(
        F.col("doc_id").alias("id"), ((F.col("n_chars") % 1000) / 1000.0).alias("score"), F.col("quality").alias("relevant"),
        (F.col("lang") == "en").alias("a"), (F.col("doc_id") % 3 == 0).alias("b"), (F.col("n_chars") > 1000).alias("c"),
    )


@query("calibration_bins", f"WITH {_SCORED} SELECT least(floor(score * 10), 9)::INT AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(relevant), 6) AS share FROM s GROUP BY 1")
def calibration_bins(spark, d):
    r = E.reliability(scored(spark, d))
    return r.select("bin", "n", F.round("mean_score", 6).alias("mean_score"), F.round("share", 6).alias("share"))


@query("calibration_ece", f"WITH {_SCORED}, b AS (SELECT least(floor(score * 10), 9) AS bin, count(*) AS n, avg(score) AS m, avg(relevant) AS f FROM s GROUP BY 1) SELECT round(sum(abs(m - f) * n) / sum(n), 6) AS ece FROM b")
def calibration_ece(spark, d):
    return E.ece(scored(spark, d)).select(F.round("ece", 6).alias("ece"))


@query("calibration_brier", f"WITH {_SCORED} SELECT round(avg((score - relevant) ** 2), 6) AS brier FROM s")
def calibration_brier(spark, d):
    return E.brier(scored(spark, d)).select(F.round("brier", 6).alias("brier"))


@query(
    "precision_thresholds",
    f"""WITH {_SCORED}, g AS (SELECT score, count(*) AS n, sum(relevant) AS h FROM s GROUP BY 1),
    r AS (SELECT score, sum(n) OVER w AS rows, sum(h) OVER w / sum(n) OVER w AS p FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
    SELECT t AS target, max(score) AS threshold FROM r, (VALUES (0.9::DOUBLE), (0.7), (0.5)) v(t) WHERE rows > 1 AND p >= t GROUP BY 1""",
)
def precision_thresholds(spark, d):
    return E.precision_thresholds(scored(spark, d))


@query("signal_agreement", f"WITH {_SCORED} SELECT (a::INT + b::INT + c::INT) AS agreement, count(*) AS n, round(avg(relevant), 6) AS share FROM s GROUP BY 1")
def signal_agreement(spark, d):
    return E.agreement(scored(spark, d), ["a", "b", "c"]).select("agreement", "n", F.round("share", 6).alias("share"))
