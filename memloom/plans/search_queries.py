"""Queries of retrieval, clusters and fusion over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from memloom.functions import text as T
from memloom.functions import vec as V
from memloom.operators import cluster as C
from memloom.operators import retrieval as R
from memloom.plans.registry import query
from memloom.plans.text_queries import table, texts

_COS = "round(list_dot_product(a.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 6)"
_QUERY = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"


def _with_query(spark, d):
    """``embeddings`` beside one query vector (one row, by id)."""
    e = table(spark, d, "embeddings")
    return e, e.where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)


def _scored(spark, d, where="vec_id <> 0"):
    e, q = _with_query(spark, d)
    return e.where(where).join(F.broadcast(q)).withColumn("score", F.round(V.cosine(F.col("embedding"), F.col("q")), 6))


@query("vector_topk", f"SELECT vec_id, {_COS} AS score FROM embeddings a, {_QUERY} q WHERE vec_id <> 0 ORDER BY score DESC, vec_id LIMIT 30")
def vector_topk(spark, d):
    return _scored(spark, d).orderBy(F.desc("score"), "vec_id").limit(30).select("vec_id", "score")


@query("vector_topk_excluding", f"SELECT vec_id, {_COS} AS score FROM embeddings a, {_QUERY} q WHERE label <> 3 AND vec_id % 7 <> 0 ORDER BY score DESC, vec_id LIMIT 20")
def vector_topk_excluding(spark, d):
    e, _ = _with_query(spark, d)
    out = _scored(spark, d, "label <> 3").join(e.where("vec_id % 7 = 0").select("vec_id"), "vec_id", "left_anti")
    return out.orderBy(F.desc("score"), "vec_id").limit(20).select("vec_id", "score")


@query("vector_threshold", f"SELECT vec_id, score FROM (SELECT vec_id, {_COS} AS score FROM embeddings a, {_QUERY} q) WHERE score >= 0.25")
def vector_threshold(spark, d):
    return _scored(spark, d, "true").where("score >= 0.25").select("vec_id", "score")


_PAIRS = f"SELECT a.vec_id AS a, q.vec_id AS b, {_COS} AS score FROM embeddings a JOIN embeddings q ON a.vec_id < q.vec_id"


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _pairs(spark, d, theta=0.4):
    """Pairs whose rounded score is ``theta`` or more; the join is asked for those that round up too."""
    e = _vectors(spark, d)
    return C.similarity_join(e, e, theta - 1e-6, self_join=True).withColumn("score", F.round("score", 6)).where(F.col("score") >= theta)


@query("similarity_self_join", f"SELECT * FROM ({_PAIRS}) WHERE score >= 0.4")
def similarity_self_join(spark, d):
    return _pairs(spark, d)


_COMPONENTS = f"""RECURSIVE e AS MATERIALIZED (SELECT a, b FROM ({_PAIRS}) WHERE score >= 0.4),
 u AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e), r(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT u.b, r.c FROM r JOIN u ON r.id = u.a),
 l AS (SELECT id, min(c) AS cluster_id FROM r GROUP BY id)"""


@query("similarity_components", f"WITH {_COMPONENTS} SELECT id, cluster_id FROM l")
def similarity_components(spark, d):
    e = _vectors(spark, d)
    # Scores of 0.4 when rounded to six digits; the components need no more of the pairs than a forest.
    return C.connected(C.similarity_join(e, e, 0.4 - 5e-7, self_join=True, forest=True), e.select("id"))


def _by_label(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("cluster_id"))


_UNIT = "list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))"


@query(
    "cluster_geometry",
    f"""WITH e AS (SELECT label, vec_id, {_UNIT} AS u, embedding::DOUBLE[] AS v FROM embeddings),
    p AS (SELECT a.label, avg(1 - list_dot_product(a.u, b.u)) AS d_bar FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1),
    x AS (SELECT label, vec_id, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM e),
    m AS (SELECT label, i, avg(x) AS m FROM x GROUP BY ALL),
    c AS (SELECT x.label, vec_id, list(x - m ORDER BY x.i) AS c FROM x JOIN m ON x.label = m.label AND x.i = m.i GROUP BY ALL),
    g AS (SELECT a.label, sum(CASE WHEN a.vec_id = b.vec_id THEN list_dot_product(a.c, b.c) ELSE 0 END) AS tr, sum(list_dot_product(a.c, b.c) ** 2) AS fro
          FROM c a JOIN c b ON a.label = b.label GROUP BY 1)
    SELECT label AS cluster_id, count(*) AS n, round(any_value(d_bar), 6) AS d_bar, round(any_value(tr * tr / fro), 6) AS d_eff
    FROM embeddings JOIN p USING (label) JOIN g USING (label) GROUP BY 1""",
)
def cluster_geometry(spark, d):
    g = C.geometry(_by_label(spark, d))
    return g.select("cluster_id", "n", F.round("d_bar", 6).alias("d_bar"), F.round("d_eff", 6).alias("d_eff"))


@query(
    "cluster_medoids",
    f"""WITH e AS (SELECT label, vec_id, {_UNIT} AS u FROM embeddings), x AS (SELECT label, generate_subscripts(u, 1) AS i, unnest(u) AS x FROM e),
    m AS (SELECT label, list(m ORDER BY i) AS m FROM (SELECT label, i, avg(x) AS m FROM x GROUP BY ALL) GROUP BY 1),
    s AS (SELECT e.label, vec_id, round(list_dot_product(u, m) / sqrt(list_dot_product(m, m)), 9) AS s FROM e JOIN m ON e.label = m.label)
    SELECT label AS cluster_id, vec_id AS id, round(s, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) = 1""",
)
def cluster_medoids(spark, d):
    return C.medoids(_by_label(spark, d)).select("cluster_id", "id", F.round("score", 6).alias("score"))


@query("cluster_regimes", f"""WITH e AS (SELECT label, vec_id, {_UNIT} AS u FROM embeddings)
    SELECT a.label AS cluster_id, CASE WHEN avg(1 - list_dot_product(a.u, b.u)) < 0.15 THEN 'Tight' ELSE 'Spread' END AS regime,
    least(any_value(n), ceil(avg(1 - list_dot_product(a.u, b.u)) / 0.9))::INT AS wanted
    FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) c ON a.label = c.label GROUP BY 1""")  # fmt: skip
def cluster_regimes(spark, d):
    g = C.geometry(_by_label(spark, d))
    return g.select("cluster_id", C.regime(F.col("d_bar")).alias("regime"), C.representatives_wanted(F.col("n"), F.col("d_bar"), 0.1).alias("wanted"))


@query("prune_report")
def prune_report(spark, d):
    """Clusters, rows kept and retired when components at 0.4 are pruned."""
    m = similarity_components(spark, d).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id").withColumn("access_count", F.col("id").cast("int") % 5)
    out = C.prune(m, C.geometry(m), 0.4)
    return out.agg(F.countDistinct("cluster_id").alias("clusters"), F.count_if("is_representative").alias("kept"), F.count_if(~F.col("is_representative")).alias("retired"))


@query("admission_near_duplicates", f"SELECT a AS kept_id, b AS id FROM ({_PAIRS}) WHERE score >= 0.45 QUALIFY row_number() OVER (PARTITION BY b ORDER BY score DESC, a) = 1")
def admission_near_duplicates(spark, d):
    """For each row the nearest earlier row at 0.45 or more."""
    from pyspark.sql import Window

    w = Window.partitionBy("b").orderBy(F.desc("score"), "a")
    return _pairs(spark, d, 0.45).withColumn("n", F.row_number().over(w)).where("n = 1").select(F.col("a").alias("kept_id"), F.col("b").alias("id"))


@query("anchor_grouping")
def anchor_grouping(spark, d):
    return C.anchor_groups(_vectors(spark, d), 0.35)


@query("mmr_rerank")
def mmr_rerank(spark, d):
    rows = _scored(spark, d).orderBy(F.desc("score"), "vec_id").limit(60).select(F.col("vec_id").alias("id"), "score", "embedding")
    return R.mmr(rows, 10, 0.5).select("id", "score", "position")


@query("mmr_relevance_only", f"SELECT vec_id AS id, {_COS} AS score, row_number() OVER (ORDER BY {_COS} DESC, vec_id)::INT AS position FROM embeddings a, {_QUERY} q WHERE vec_id <> 0 QUALIFY position <= 10")
def mmr_relevance_only(spark, d):
    """With weight 1 diversification is a plain top-k."""
    rows = _scored(spark, d).orderBy(F.desc("score"), "vec_id").limit(60).select(F.col("vec_id").alias("id"), "score", "embedding")
    return R.mmr(rows, 10, 1.0).select("id", "score", "position")


# Keyword channels -------------------------------------------------------------------------------

TERMS = ("thing", "license", "version", "the", "idiot", "public")
_LIST = "[" + ", ".join(f"'{t}'" for t in TERMS) + "]"
_BM25 = f"""k AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9_\\x{{80}}-\\x{{10FFFF}}]+'), lambda t: t <> '') AS ts FROM documents),
 st AS (SELECT count(*) AS n, avg(len(ts)) AS avg_len FROM k),
 tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS len, unnest(list_filter(ts, lambda t: list_contains({_LIST}, t))) AS term FROM k) GROUP BY ALL),
 df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
 bm AS (SELECT doc_id AS id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score FROM tf JOIN df USING (term), st GROUP BY 1)"""


def _bm(spark, d):
    return R.bm25(texts(spark, d, "documents", "doc_id", "text"), list(TERMS), None, "doc_id").withColumn("score", F.round("score", 6))


@query("bm25_topk", f"WITH {_BM25} SELECT id, score FROM bm ORDER BY score DESC, id LIMIT 200")
def bm25_topk(spark, d):
    return _bm(spark, d).orderBy(F.desc("score"), "id").limit(200)


@query("bm25_corpus_stats", f"WITH {_BM25}, x AS (SELECT DISTINCT doc_id, unnest(ts) AS t FROM k) SELECT (SELECT n FROM st) AS n, (SELECT round(avg_len, 6) FROM st) AS avg_len, (SELECT count(*) FROM x) AS n_postings")
def bm25_corpus_stats(spark, d):
    docs = table(spark, d, "documents")
    p = R.postings(docs, "doc_id", "text").agg(F.count(F.lit(1)).alias("n_postings"))
    return R.corpus_stats(docs, "text").select("n", F.round("avg_len", 6).alias("avg_len")).join(F.broadcast(p))


_DELTA = "(" + " + ".join(f"(contains(lower(text), '{t}'))::INT" for t in TERMS) + f") / {len(TERMS)}"


@query("delta_search", f"SELECT doc_id AS id, round({_DELTA}, 6) AS score FROM documents WHERE {_DELTA} > 0")
def delta_search(spark, d):
    return R.substring_search(table(spark, d, "documents"), list(TERMS), "doc_id").select("id", F.round("score", 6).alias("score"))


_VEC = f"v AS (SELECT vec_id AS id, {_COS} AS score FROM embeddings a, {_QUERY} q WHERE vec_id <> 0 ORDER BY score DESC, id LIMIT 200)"
_RRF = f"""{_BM25}, {_VEC}, b AS (SELECT id, score FROM bm ORDER BY score DESC, id LIMIT 200),
 ch AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS r FROM b UNION ALL SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 FROM v),
 fused AS (SELECT id, sum(1.0 / (60 + r + 1)) AS score FROM ch GROUP BY 1)"""


def _fused(spark, d):
    words = bm25_topk(spark, d)
    near = _scored(spark, d).select(F.col("vec_id").alias("id"), "score").orderBy(F.desc("score"), "id").limit(200)
    return R.rrf([R.ranked(words, "bm25"), R.ranked(near, "cosine")])


@query("rrf_fusion", f"WITH {_RRF} SELECT id, round(score, 6) AS score FROM fused")
def rrf_fusion(spark, d):
    return _fused(spark, d).select("id", F.round("score", 6).alias("score"))


@query(
    "boosted_fusion",
    f"""WITH {_RRF}, j AS (SELECT f.id, f.score / (1 + 0.002 * (n_chars % 200)) * (1 + 0.1 * log10(1 + doc_id % 10)) AS s, (n_chars % 100) / 100.0 AS imp
      FROM fused f JOIN documents ON doc_id = id),
    n AS (SELECT id, imp, (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) AS s FROM j)
    SELECT id, round(CASE WHEN imp > 0 AND imp <> 1 THEN s + 0.1 * imp ELSE s END, 6) AS score FROM n""",
)
def boosted_fusion(spark, d):
    """Decay, min-max and salience; lengths and ids stand for ages, uses and importance."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "n_chars").join(F.broadcast(_fused(spark, d)), "id")
    rows = R.min_max(rows.withColumn("score", R.decay_boost(F.col("score"), F.col("n_chars") % 200, F.col("id") % 10)))
    return rows.select("id", F.round(R.salience_boost(F.col("score"), (F.col("n_chars") % 100) / 100.0), 6).alias("score"))


@query("recency_boosts", """SELECT doc_id AS id, round(0.5 + CASE WHEN doc_id % 4 = 0 THEN -CASE WHEN n_chars % 365 > 30 THEN least(0.2, (n_chars % 365 - 30) / 30 * 0.1) ELSE 0 END
      ELSE least(0.15, 0.02 * (doc_id % 4)) + 0.15 * exp(-(n_chars % 90) / 14.0) END, 6) AS score FROM documents""")  # fmt: skip
def recency_boosts(spark, d):
    docs = table(spark, d, "documents")
    score = R.recency_boost(F.lit(0.5), F.col("n_chars") % 365, F.col("n_chars") % 90, F.col("doc_id") % 4)
    return docs.select(F.col("doc_id").alias("id"), F.round(score, 6).alias("score"))


@query(
    "side_index_boost",
    f"""WITH q AS (SELECT list_distinct(ts) AS qs FROM (SELECT list_filter(string_split_regex(lower(text), '[^a-z0-9_\\x{{80}}-\\x{{10FFFF}}]+'), lambda t: t <> '') AS ts FROM benchmark WHERE item_id = 0)),
    t AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9_\\x{{80}}-\\x{{10FFFF}}]+'), lambda t: t <> '')) AS ts FROM documents)
    SELECT doc_id AS id, round(0.15 * len(list_intersect(ts, qs)) / len(list_distinct(ts || qs)), 6) AS boost FROM t, q WHERE len(list_intersect(ts, qs)) > 0""",
)
def side_index_boost(spark, d):
    """Jaccard overlap of documents' words with those of one benchmark item."""
    q = table(spark, d, "benchmark").where("item_id = 0").select(F.array_distinct(T.tokens(F.col("text"))).alias("q")).limit(1)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.array_distinct(T.tokens(F.col("text"))).alias("t")).join(F.broadcast(q))
    return docs.where(F.arrays_overlap("t", "q")).select("id", F.round(R.side_index_boost(docs, F.col("q"), "t"), 6).alias("boost"))


@query(
    "token_overlap",
    """WITH t AS (SELECT DISTINCT conv_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w FROM conversations),
    q AS (SELECT w FROM t WHERE conv_id = (SELECT min(conv_id) FROM conversations))
    SELECT conv_id, count(*) AS n FROM t JOIN q USING (w) GROUP BY 1 ORDER BY n DESC, conv_id LIMIT 20""",
)
def token_overlap(spark, d):
    conv = table(spark, d, "conversations")
    t = conv.select("conv_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), 0)).alias("w")).distinct()
    first = conv.agg(F.min("conv_id").alias("m"))
    q = t.join(F.broadcast(first), F.col("conv_id") == F.col("m")).select("w")
    return t.join(q, "w").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "conv_id").limit(20)


@query(
    "governed_results",
    f"""WITH c AS (SELECT vec_id AS id, label, {_COS} AS score FROM embeddings a, {_QUERY} q WHERE vec_id <> 0 ORDER BY score DESC, id LIMIT 60),
    s AS (SELECT *, ceil(20.0 / (SELECT count(DISTINCT label) FROM c)) AS slots, row_number() OVER (PARTITION BY label ORDER BY score DESC, id) AS p FROM c)
    SELECT id, label AS cluster_id, score FROM (SELECT *, row_number() OVER (ORDER BY p <= slots DESC, score DESC, id) AS n FROM s) WHERE n <= 20""",
)
def governed_results(spark, d):
    rows = _scored(spark, d).select(F.col("vec_id").alias("id"), F.col("label").alias("cluster_id"), "score").orderBy(F.desc("score"), "id").limit(60)
    return R.governed(rows, 20).select("id", "cluster_id", "score")


@query(
    "budget_packing",
    """SELECT doc_id, lang, used FROM (SELECT doc_id, lang, sum(length(text)) OVER (PARTITION BY lang ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM documents)
       WHERE used <= 3200""",
)
def budget_packing(spark, d):
    """The longest prefix of each language's shortest documents within the wake-up budget."""
    return R.packed(table(spark, d, "documents"), 3200, ["n_chars", "doc_id"], partition=["lang"]).select("doc_id", "lang", "used")


@query(
    "context_window",
    """WITH a AS (SELECT ts FROM events WHERE event_id = 50)
    (SELECT event_id, -1 AS part FROM events WHERE event_id <> 50 AND ts <= (SELECT ts FROM a) ORDER BY ts DESC, event_id DESC LIMIT 5) UNION ALL
    (SELECT event_id, 0 FROM events WHERE event_id = 50) UNION ALL
    (SELECT event_id, 1 FROM events WHERE event_id <> 50 AND ts > (SELECT ts FROM a) ORDER BY ts, event_id LIMIT 5)""",
)
def context_window(spark, d):
    return R.around(table(spark, d, "events"), 50, 5, "ts", "event_id").select("event_id", "part")


@query("confidence_levels", f"SELECT level, count(*) AS n FROM (SELECT CASE WHEN s > 0.8 THEN 'high' WHEN s > 0.6 THEN 'medium' WHEN s > 0.4 THEN 'proceed' ELSE 'low' END AS level FROM (SELECT 2 * {_COS} AS s FROM embeddings a, {_QUERY} q)) GROUP BY 1")
def confidence_levels(spark, d):
    s = _scored(spark, d, "true").select(R.confidence_level(2 * F.col("score")).alias("level"))
    return s.groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query("evidence_gate", f"SELECT max(score) >= 0.3 AS sufficient, count(*) AS n_results FROM (SELECT {_COS} AS score FROM embeddings a, {_QUERY} q WHERE vec_id <> 0 ORDER BY score DESC LIMIT 10)")
def evidence_gate(spark, d):
    return R.evidence_gate(_scored(spark, d).orderBy(F.desc("score"), "vec_id").limit(10), 0.3)


@query("expansion_merge", f"""SELECT id, max(score) AS score FROM (SELECT vec_id AS id, {_COS} AS score FROM embeddings a, {_QUERY} q UNION ALL
    SELECT vec_id, {_COS} FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 1) q) GROUP BY 1 ORDER BY score DESC, id LIMIT 20""")  # fmt: skip
def expansion_merge(spark, d):
    e = table(spark, d, "embeddings")
    one = [
        e.join(F.broadcast(e.where(f"vec_id = {i}").select(F.col("embedding").alias("q")).limit(1))).select(F.col("vec_id").alias("id"), F.round(V.cosine(F.col("embedding"), F.col("q")), 6).alias("score"))
        for i in (0, 1)
    ]
    return R.merged_variants(one, 20)


@query("hybrid_search")
def hybrid_search(spark, d):
    """Keyword and vector channels with fusion, salience and diversification over documents with embeddings."""
    e = table(spark, d, "embeddings")
    docs = texts(spark, d, "documents", "doc_id", "text", "n_chars").join(e.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    rows = docs.select(F.col("doc_id").alias("id"), "text", "embedding", F.least(F.lit(1.0), F.col("n_chars") / 10000.0).alias("importance"))
    q = e.where("vec_id = 0").select("embedding").limit(1).first()[0]  # the question's own vector
    return R.hybrid(rows, " ".join(TERMS), q, 10)


@query("random_sample", "SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR || ':7'), doc_id LIMIT 25")
def random_sample(spark, d):
    """A repeatable sample of 25 rows by hash order (a sampling operator)."""
    docs = table(spark, d, "documents").select("doc_id")
    return docs.orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":7"))), "doc_id").limit(25)
