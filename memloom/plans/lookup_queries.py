"""Queries of lists, lookups, status changes and the graph export over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from memloom.operators import lookups as L
from memloom.plans.graph_queries import _TRIPLES, entities, triples
from memloom.plans.registry import query
from memloom.plans.text_queries import table


def _calls(spark, d):
    """Events as tool calls: the type is the tool, the third user's are summarised."""
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("tool_name"), (F.col("user_id") % 3 == 0).alias("is_summarized"), F.col("ts").alias("called_at"),
        F.col("value").alias("score"), F.lit(None).cast("string").alias("summary"),
    )


@query("row_by_id", "SELECT doc_id, lang, source FROM documents WHERE doc_id = 7 LIMIT 1")
def row_by_id(spark, d):
    return L.by_key(table(spark, d, "documents").select("doc_id", "lang", "source"), 7, "doc_id")


@query("recent_attempts", "SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 3")
def recent_attempts(spark, d):
    """Error events stand for the room of attempts."""
    rooms = F.when(F.col("event_type") == "error", "attempts").otherwise(F.col("event_type"))
    ev = table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", rooms.alias("room"), F.col("ts").alias("mined_at"))
    return L.attempts(ev).select(F.col("id").alias("event_id"), "user_id")


@query("page_list", "SELECT url AS path, 'page ' || page_id AS title, len(string_split(url, '/'))::INT AS n_citations, page_id AS updated_at FROM pages ORDER BY page_id DESC, url LIMIT 100")
def page_list(spark, d):
    pages = table(spark, d, "pages").select(
        F.col("url").alias("path"), F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("title"), F.split("url", "/").alias("citations"), F.col("page_id").alias("updated_at")
    )
    return L.page_index(pages)


@query("page_read", "SELECT page_id, url, length(html)::BIGINT AS size FROM pages WHERE page_id = 11 LIMIT 1")
def page_read(spark, d):
    return L.by_key(table(spark, d, "pages"), 11, "page_id").select("page_id", "url", F.length("html").cast("long").alias("size"))


@query("page_log", "SELECT event_id, ts FROM events WHERE event_type = 'view' ORDER BY ts DESC, event_id DESC LIMIT 40")
def page_log(spark, d):
    return L.newest(table(spark, d, "events"), 40, "ts", "event_id", event_type="view").select("event_id", "ts")


@query(
    "open_review_list",
    "SELECT doc_id AS id, 'topic/' || source AS page_path, (n_chars % 1000) / 1000.0 AS similarity FROM documents JOIN labels USING (doc_id) WHERE toxic = 0 AND source = 'src1' ORDER BY similarity DESC, id LIMIT 50",
)
def open_review_list(spark, d):
    """The review queue of one page; toxic rows stand for resolved entries."""
    q = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(
        F.col("doc_id").alias("id"), F.concat(F.lit("topic/"), "source").alias("page_path"), (F.col("n_chars") % 1000 / 1000.0).alias("similarity"),
        F.when(F.col("toxic") == 1, F.current_timestamp()).alias("resolved_at"),
    )
    return L.open_reviews(q, page_path="topic/src1").drop("resolved_at")


@query("episode_list", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def episode_list(spark, d):
    return L.newest(table(spark, d, "orders"), 20, "o_orderdate", "o_orderkey", o_orderstatus="F").select("o_orderkey", "o_orderstatus")


@query("skill_by_id_or_name", "SELECT n_nationkey::VARCHAR AS id, n_name AS name FROM nation WHERE n_nationkey = 4")
def skill_by_id_or_name(spark, d):
    """A name is found where no id equals it."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"))
    name = n.where("id = '4'").first()["name"]
    return L.by_key(n, name, "id", "name")


@query("draft_status", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN 'accepted' ELSE o_orderstatus END AS status FROM orders")
def draft_status(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return L.changed(o, o.where("id % 10 = 0").select("id", F.lit("accepted").alias("status")), "status")


@query("drafts_pending", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 30")
def drafts_pending(spark, d):
    return L.newest(table(spark, d, "orders"), 30, "o_orderdate", "o_orderkey", o_orderstatus="O").select("o_orderkey", "o_orderpriority")


@query("memories_by_wing", "SELECT doc_id, n_chars FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id DESC LIMIT 50")
def memories_by_wing(spark, d):
    return L.newest(table(spark, d, "documents"), 50, "n_chars", "doc_id", lang="en").select("doc_id", "n_chars")


@query("memory_count", "SELECT count(*) AS n FROM documents WHERE lang = 'en'")
def memory_count(spark, d):
    return L.counted(table(spark, d, "documents").withColumnRenamed("lang", "wing"), "en")


@query("recent_calls", "SELECT event_id AS id, ts AS called_at FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 20")
def recent_calls(spark, d):
    return L.newest(_calls(spark, d), 20, "called_at", tool_name="click").select("id", "called_at")


@query("unsummarized_calls", "SELECT event_id AS id, ts AS called_at FROM events WHERE event_type = 'click' AND user_id % 3 <> 0")
def unsummarized_calls(spark, d):
    return L.unsummarized(_calls(spark, d), "click").select("id", "called_at")


@query("call_verdicts", "SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN CASE WHEN value >= 0.5 THEN 1.0 ELSE 0.0 END ELSE value END::DOUBLE AS score, CASE WHEN event_id % 5 = 0 THEN 'judged' END AS summary, event_id % 5 = 0 OR user_id % 3 = 0 AS is_summarized FROM events")
def call_verdicts(spark, d):
    calls = _calls(spark, d)
    some = calls.where("id % 5 = 0")
    out = L.summarized(L.evaluated(calls, some.select("id", "score", F.lit("judged").alias("summary"))), some)
    return out.select("id", "score", "summary", "is_summarized")


@query("tunnels_by_topic", "SELECT DISTINCT least(c_nationkey, c_custkey % 25) AS end_a, greatest(c_nationkey, c_custkey % 25) AS end_b FROM customer WHERE c_mktsegment = 'FURNITURE'")
def tunnels_by_topic(spark, d):
    a, b = F.col("c_nationkey").cast("long"), F.col("c_custkey") % 25
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("topic"), F.least(a, b).alias("end_a"), F.greatest(a, b).alias("end_b")).distinct()
    return L.by_topic(c, "FURNITURE").select("end_a", "end_b")


@query("confidence_range", f"WITH {_TRIPLES} SELECT min(confidence)::DOUBLE AS least, max(confidence)::DOUBLE AS greatest FROM t WHERE valid_to IS NULL")
def confidence_range(spark, d):
    return L.confidence_range(triples(spark, d))


@query(
    "skill_sync",
    """SELECT folder_path, CASE WHEN a.t IS NULL THEN 'added' WHEN b.t IS NULL THEN 'removed' WHEN a.t <> b.t THEN 'updated' ELSE 'same' END AS action
    FROM (SELECT o_custkey AS folder_path, max(o_orderkey) AS t FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1) a
    FULL JOIN (SELECT o_custkey AS folder_path, max(o_orderkey) AS t FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1) b USING (folder_path)""",
)
def skill_sync(spark, d):
    """Three-way sync of a registry with what is on disk."""
    o = table(spark, d, "orders")

    def side(but):
        return o.where(F.col("o_orderstatus") != but).groupBy(F.col("o_custkey").alias("folder_path")).agg(F.max("o_orderkey").alias("skill_md_mtime"))

    return L.synced(side("F"), side("O"))


@query(
    "graph_export_links",
    f"""WITH {_TRIPLES}, l AS (SELECT subject AS source, object AS target, 'fact' AS kind, 0 AS i FROM t
      UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'membership', 1 FROM customer UNION ALL SELECT 'n' || n_nationkey, 'n' || (n_nationkey + 1), 'next', 2 FROM nation)
    SELECT source, target, min_by(kind, i) AS kind FROM l WHERE source IN (SELECT id FROM e) AND target IN (SELECT id FROM e) GROUP BY 1, 2""",
)
def graph_export_links(spark, d):
    """Links of the exported graph: one a pair of known ends, of the first kind that has it."""
    e = entities(spark, d).select("id", F.col("name").alias("label"))
    none = e.where("false")

    def key(prefix, col):
        return F.concat(F.lit(prefix), F.col(col).cast("string"))

    members = table(spark, d, "customer").select(key("c", "c_custkey").alias("source"), key("n", "c_nationkey").alias("target"))
    following = table(spark, d, "nation").select(key("n", "n_nationkey").alias("source"), F.concat(F.lit("n"), (F.col("n_nationkey") + 1).cast("string")).alias("target"))
    facts = triples(spark, d).select(F.col("subject").alias("source"), F.col("object").alias("target"))
    return L.graph_export({"fact": (e, facts), "membership": (none, members), "next": (none, following)})[1]


@query(
    "answer_precision",
    """SELECT count(*) AS n_questions, avg(hit::INT)::DOUBLE AS precision FROM (SELECT item_id, max(contains(lower(d.text), lower(left(b.text, 12))) OR d.doc_id = b.item_id) AS hit
    FROM benchmark b JOIN documents d ON d.doc_id % 40 = b.item_id % 40 GROUP BY 1)""",
)
def answer_precision(spark, d):
    """Questions answered by their results: the answer's text or its source is among them."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("question"), F.left("text", F.lit(12)).alias("answer"), (F.col("item_id") % 40).alias("g"))
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"), (F.col("doc_id") % 40).alias("g"))
    return L.answer_precision(b.join(docs, "g").withColumn("source", F.col("question").cast("string")))
