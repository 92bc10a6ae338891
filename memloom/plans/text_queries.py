"""Queries of text functions and sources over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from memloom.functions import fixed
from memloom.functions import text as T
from memloom.plans.registry import query
from memloom.session import ship, spread
from memloom.sources import ingest as I


def table(spark, d, name):
    ship(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def texts(spark, d, name, *columns):
    """The named columns of a table of long texts, dealt out to all cores."""
    return spread(table(spark, d, name).select(*columns))


@query(
    "content_ids",
    """SELECT doc_id, left(sha256(text), 16) AS id, text || ' ' || lang || ' ' || source AS fts_text,
       length(text)::BIGINT AS size FROM documents""",
)
def content_ids(spark, d):
    """Content-addressed ids and the indexed text of every row."""
    return table(spark, d, "documents").select(
        "doc_id", T.short_hash(F.col("text")).alias("id"), F.concat_ws(" ", "text", "lang", "source").alias("fts_text"), F.length("text").cast("long").alias("size")
    )


@query(
    "admission_gates",
    r"""SELECT doc_id, CASE WHEN length(t) < 80 THEN 'content too short'
       WHEN 1 - length(regexp_replace(t, '[^\p{L}\p{N}]', '', 'g')) / length(t) > 0.95 THEN 'mostly symbols' END AS reason
       FROM (SELECT doc_id, trim(text) AS t FROM documents)""",
)
def admission_gates(spark, d):
    from memloom.operators.cluster import admission

    return admission(table(spark, d, "documents")).select("doc_id", "reason")


@query(
    "exact_duplicates",
    "SELECT left(sha256(text), 16) AS id, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1",
)
def exact_duplicates(spark, d):
    docs = table(spark, d, "documents").select(T.short_hash(F.col("text")).alias("id"), "doc_id")
    return docs.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


#: Blanks as chr(2) twice, other marks between chr(1): word ends can be consumed without lookarounds.
_MARKED = r"chr(2) || regexp_replace(regexp_replace(text, '([^\p{L}\p{N}_\s])', chr(1) || '\1' || chr(1), 'g'), '\s+', chr(2) || chr(2), 'g')"
#: Numbers joined by points stay together; they pair up from the left.
_CHAINS = r"' ' || regexp_replace(regexp_replace(regexp_replace(text, '(\d)\.(\d)', '\1' || chr(3) || '\2', 'g'), '(\d)\.(\d)', '\1' || chr(3) || '\2', 'g'), '([^\p{L}\p{N}_\x03])', ' \1 ', 'g') || ' '"
_SPACED = r"' ' || regexp_replace(text, '([^\p{L}\p{N}_])', ' \1 ', 'g') || ' '"


@query(
    "importance_scores",
    rf"""WITH s AS (SELECT doc_id, text, {_SPACED} AS t, {_MARKED} AS m, {_CHAINS} AS c, len(list_filter(string_split(text, ' '), lambda x: x <> '')) AS n FROM documents)
    SELECT doc_id, round(CASE WHEN trim(text) = '' THEN 0.1 ELSE least(1.0,
      least(0.30, len(regexp_extract_all(t, '(?i) ({T.DECISIONS}) ')) * 0.06)
      + CASE WHEN n = 0 THEN 0 ELSE least(0.15, coalesce(list_sum(list_transform(regexp_extract_all(c, ' ([\d\x03]+) ', 1), lambda x: ceil((length(x) - length(replace(x, chr(3), '')) + 1) / 2))), 0) / n * 1.5) END
      + CASE WHEN length(text) < 50 THEN 0.03 WHEN length(text) < 200 THEN 0.08 WHEN length(text) <= 2000 THEN 0.15 WHEN length(text) <= 5000 THEN 0.10 ELSE 0.05 END
      + least(0.20, len(regexp_extract_all(m, '[\x01\x02]({T.RELATIONS})\x02+[^\x02]+')) * 0.07)) END, 6) AS importance FROM s""",
)
def importance_scores(spark, d):
    return texts(spark, d, "documents", "doc_id", "text").select("doc_id", F.round(T.importance(F.col("text")), 6).alias("importance"))


@query("typed_token_index")
def typed_token_index(spark, d):
    """Typed tokens of conversation turns."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.explode(T.typed_tokens(F.col("text"))).alias("tok"))
    return rows.select("conv_id", "turn", F.col("tok.type").alias("token_type"), F.col("tok.value").alias("token_value")).distinct()


@query(
    "typed_tokens_of_parts",
    """SELECT p_partkey, unnest(['qualified', 'hex', 'number', 'arity', 'funcall']) AS token_type,
    unnest(['Stock.Part' || p_partkey, '0x' || format('{:x}', p_partkey), p_size::VARCHAR, p_size::VARCHAR, 'load_' || p_partkey]) AS token_value FROM part""",
)
def typed_tokens_of_parts(spark, d):
    """All five types, from one sentence a part."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    text = F.concat(F.lit("Stock.Part"), key, F.lit(" at 0x"), F.upper(F.hex("p_partkey")), F.lit(" takes "), size, F.lit(" args via load_"), key, F.lit(" (x)."))
    rows = table(spark, d, "part").select("p_partkey", F.explode(T.typed_tokens(text)).alias("tok"))
    return rows.select("p_partkey", F.col("tok.type").alias("token_type"), F.col("tok.value").alias("token_value"))


@query("room_of_path", """SELECT page_id, CASE WHEN lower(url) LIKE '%/controllers/%' OR lower(url) LIKE '%/controller/%' THEN 'controllers'
    WHEN lower(url) LIKE '%/services/%' OR lower(url) LIKE '%/service/%' THEN 'services' WHEN lower(url) LIKE '%/models/%' OR lower(url) LIKE '%/model/%' THEN 'models'
    WHEN lower(url) LIKE '%/migrations/%' OR lower(url) LIKE '%/migration/%' THEN 'migrations' WHEN lower(url) LIKE '%/helpers/%' OR lower(url) LIKE '%/helper/%' THEN 'helpers'
    WHEN lower(url) LIKE '%/repositories/%' OR lower(url) LIKE '%/repository/%' THEN 'repositories' WHEN lower(url) LIKE '%/handlers/%' THEN 'handlers'
    WHEN lower(url) LIKE '%/middleware/%' THEN 'middleware' WHEN lower(url) LIKE '%/tests/%' OR lower(url) LIKE '%.test.%' OR lower(url) LIKE '%.spec.%' OR lower(url) LIKE '%/specs/%' THEN 'tests'
    ELSE 'source' END AS room FROM pages""")  # fmt: skip
def room_of_path(spark, d):
    return table(spark, d, "pages").select("page_id", T.room_of_path(F.col("url")).alias("room"))


def _hall_sql() -> str:
    parts = []
    for hall, words in fixed.HALLS.items():
        hits = []
        for w in dict.fromkeys(words):
            whole, w = (True, w[1:]) if w[0] == "=" else (len(w) <= 3, w)
            hits.append(f"len(regexp_extract_all(t, '[^\\p{{L}}\\p{{N}}]{w}" + ("[^\\p{L}\\p{N}]" if whole else "") + "'))")
        if hits:
            parts.append((hall, " + ".join(hits)))
    cols = ", ".join(f"{e} AS h_{h}" for h, e in parts)
    best = "greatest(" + ", ".join(f"h_{h}" for h, _ in parts) + ")"
    cases = " ".join(f"WHEN h_{h} = b THEN '{h}'" for h, _ in parts)
    spaced = r"' ' || regexp_replace(lower(left(text, 5000)), '([^\p{L}\p{N}])', '\1\1', 'g') || ' '"
    return f"SELECT doc_id, CASE WHEN b = 0 THEN 'general' {cases} END AS hall FROM (SELECT *, {best} AS b FROM (SELECT doc_id, {cols} FROM (SELECT doc_id, {spaced} AS t FROM documents)))"


@query("hall_of_text", _hall_sql())
def hall_of_text(spark, d):
    return texts(spark, d, "documents", "doc_id", "text").select("doc_id", T.hall_of_text(F.col("text")).alias("hall"))


@query(
    "page_slugs",
    r"""SELECT page_id, nullif(array_to_string(list_filter(list_transform(string_split(
      regexp_replace(regexp_replace(regexp_replace(lower(url), '[_\s]+', '-', 'g'), '[^a-z0-9\-/]', '', 'g'), '-{2,}', '-', 'g'), '/'),
      lambda p: trim(p, '-')), lambda p: p <> ''), '/'), '') AS slug FROM pages""",
)
def page_slugs(spark, d):
    return table(spark, d, "pages").select("page_id", T.slug(F.col("url")).alias("slug"))


@query(
    "canonical_names",
    r"""SELECT c_custkey, regexp_replace(regexp_replace(lower(c_name), '[\s\-_]+', '', 'g'), '[^\x20-\x7E]+', '', 'g') AS canonical_name FROM customer""",
)
def canonical_names(spark, d):
    return table(spark, d, "customer").select("c_custkey", T.canonical_name(F.col("c_name")).alias("canonical_name"))


@query(
    "folded_text",
    "SELECT doc_id, sha256("
    + "".join("replace(" for _ in T.FOLD_PAIRS)
    + f"translate(text, '{T.FOLD_FROM}', '{T.FOLD_TO}')"
    + "".join(f", '{a}', '{b}')" for a, b in T.FOLD_PAIRS)
    + ") AS folded_sha256 FROM documents",
)
def folded_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(T.fold_ascii(F.col("text")), 256).alias("folded_sha256"))


_STOP = "[" + ", ".join(f"'{w}'" for w in fixed.QUERY_STOP_WORDS) + "]"


@query(
    "query_terms",
    rf"""SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(text), '[\s\p{{P}}]+'),
       lambda t: length(t) >= 3 AND NOT list_contains({_STOP}, t)))), ' ') AS terms FROM conversations""",
)
def query_terms(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.array_sort(T.query_terms(F.col("text"))), " ").alias("terms"))


@query(
    "grep_exact",
    r"""SELECT doc_id, source, CASE WHEN s > 1 THEN '…' ELSE '' END || substr(text, s, least(p + n + 120, length(text) + 1) - s) AS snippet
    FROM (SELECT *, greatest(p - 80, 1) AS s FROM (SELECT doc_id, source, text, length(regexp_extract(text, '(?s)^(.*?)[Ll]icensed? under', 1)) + 1 AS p,
      length(regexp_extract(text, '[Ll]icensed? under')) AS n FROM documents WHERE regexp_matches(text, '[Ll]icensed? under')))""",
)
def grep_exact(spark, d):
    from memloom.operators.retrieval import grep_exact as grep

    return grep(table(spark, d, "documents"), "[Ll]icensed? under").select("doc_id", "source", "snippet")


@query(
    "sentence_split",
    r"""WITH b AS (SELECT doc_id, trim(unnest(string_split(text, chr(10) || chr(10))), chr(10) || ' ' || chr(9)) AS b FROM documents),
    s AS (SELECT doc_id, trim(unnest(string_split(regexp_replace(b, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))), ' ') AS s FROM b WHERE b <> '')
    SELECT doc_id, count(*) AS n_sentences, sum(length(s))::BIGINT AS n_chars FROM s WHERE s <> '' GROUP BY 1""",
)
def sentence_split(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.explode(T.sentences(F.col("text"))).alias("s"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.sum(F.length("s")).alias("n_chars"))


@query(
    "noun_phrases",
    r"SELECT doc_id, trim(left(regexp_extract(text, '^([^.!?,;:\n]*)', 1), 80)) AS phrase, CASE WHEN length(text) > 120 THEN left(text, 120) || '...' ELSE text END AS preview FROM documents",
)
def noun_phrases(spark, d):
    return table(spark, d, "documents").select("doc_id", T.noun_phrase(F.col("text")).alias("phrase"), T.truncate(F.col("text"), 120).alias("preview"))


@query("entity_types")
def entity_types(spark, d):
    """Types of part and customer names (ordered rules, tested on literals)."""
    names = table(spark, d, "part").select(F.col("p_name").alias("name")).unionByName(table(spark, d, "customer").select(F.col("c_name").alias("name"))).distinct()
    return names.select("name", T.entity_type(F.col("name")).alias("type"))


@query("symbolic_summaries")
def symbolic_summaries(spark, d):
    """Two-line symbolic summaries of documents."""
    docs = texts(spark, d, "documents", "doc_id", "text", "lang", "source")
    return docs.select("doc_id", T.symbolic(F.col("text"), wing=F.col("lang"), room=F.col("source")).alias("summary"))


@query(
    "page_links",
    r"""SELECT page_id, count(*) AS n_links, count(DISTINCT l) AS n_distinct FROM
      (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS l FROM pages) GROUP BY 1""",
)
def page_links(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("l"))
    return rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_links"), F.countDistinct("l").alias("n_distinct"))


@query(
    "conversation_mining",
    """SELECT conv_id, turn, left(sha256(text), 16) AS id, 'conversation' AS room, length(text)::BIGINT AS size FROM conversations WHERE trim(text) <> ''""",
)
def conversation_mining(spark, d):
    """Turns packed as JSON arrays per conversation, parsed back and content-addressed."""
    conv = table(spark, d, "conversations")
    packed = conv.groupBy("conv_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))).alias("json"))
    turns = I.conversation_turns(packed, "json", "conv_id")
    return turns.select("conv_id", F.col("turn"), T.short_hash(F.col("content")).alias("id"), F.lit("conversation").alias("room"), F.length("content").cast("long").alias("size"))


@query(
    "incremental_skip",
    """SELECT source, mtime FROM (SELECT source, max(n_chars) AS mtime FROM documents GROUP BY 1)
       ANTI JOIN (SELECT source, max(n_chars) AS mtime FROM documents WHERE doc_id % 2 = 0 GROUP BY 1) s USING (source, mtime)""",
)
def incremental_skip(spark, d):
    """Sources whose time differs from the stored one; even rows stand for what is stored."""
    docs = table(spark, d, "documents")
    files = docs.groupBy("source").agg(F.max("n_chars").alias("mtime"))
    stored = docs.where("doc_id % 2 = 0").groupBy("source").agg(F.max("n_chars").alias("mtime"))
    return I.changed_files(files, stored)


@query(
    "sweep_report",
    """SELECT status, count(*) AS n FROM (SELECT CASE WHEN s.mtime IS NULL THEN 'missing' WHEN s.mtime <> f.mtime THEN 'stale' ELSE 'ok' END AS status
       FROM (SELECT user_id AS source, max(event_id) AS mtime FROM events GROUP BY 1) f
       LEFT JOIN (SELECT user_id AS source, max(event_id) AS mtime FROM events WHERE event_id % 3 <> 0 GROUP BY 1) s USING (source)) GROUP BY 1""",
)
def sweep_report(spark, d):
    ev = table(spark, d, "events").select(F.col("user_id").alias("source"), F.col("event_id").alias("mtime"))
    files, stored = ev.groupBy("source").agg(F.max("mtime").alias("mtime")), ev.where("mtime % 3 <> 0").groupBy("source").agg(F.max("mtime").alias("mtime"))
    return I.sweep(files, stored).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("chunks_topic_shift")
def chunks_topic_shift(spark, d):
    """Chunks of documents, cut where the embeddings of adjacent sentences differ."""
    from memloom.seams import HashingEmbedder

    return I.chunked(texts(spark, d, "documents", "doc_id", "text"), "doc_id", "text", HashingEmbedder().matrix)


@query("chunks_structural")
def chunks_structural(spark, d):
    return I.structural_chunks(table(spark, d, "documents"), "doc_id", "text")


@query(
    "numeric_facts",
    """WITH p AS (SELECT p_partkey, p_partkey % 3 AS kind, p_size, p_brand FROM part),
    f AS (SELECT p_partkey, p_brand, unnest(CASE kind
        WHEN 0 THEN [{'s': 'Load', 'p': 'has_param_count', 'o': p_size::VARCHAR}, {'s': 'widget', 'p': 'has_version', 'o': '1.' || p_size}, {'s': 'It', 'p': 'returns_type', 'o': 'Task<int>'},
                     {'s': 'Client', 'p': 'has_timeout', 'o': p_size || 's'}, {'s': 'Server', 'p': 'uses_port', 'o': (1000 + p_partkey % 9000)::VARCHAR}, {'s': p_size || 's.', 'p': 'has_value', 'o': '800'}]
        WHEN 1 THEN [{'s': 'unknown', 'p': 'returns_type', 'o': 'bool'}, {'s': 'Open', 'p': 'uses_port', 'o': (2000 + p_partkey % 7000)::VARCHAR}]
        ELSE [{'s': p_brand, 'p': 'uses_port', 'o': '8080'}] END) AS f FROM p)
    SELECT p_partkey, f.s AS subject, f.p AS predicate, f.o AS object FROM f""",
)
def numeric_facts(spark, d):
    """Facts with numbers from sentences on parts: named, looked back for, and with no subject near."""
    size, key = F.col("p_size").cast("string"), F.col("p_partkey")
    full = F.concat(
        F.lit("Load(a, b) takes "), size, F.lit(" args. widget v1."), size, F.lit(" here. Server port: "), (1000 + key % 9000).cast("string"),
        F.lit(". It returns Task<int>. Client TIMEOUT: "), size, F.lit("s. chunk_size = 800"),
    )
    some = F.concat(F.lit("returns bool, as Open (x) and then, of all things, port "), (2000 + key % 7000).cast("string"))
    text = F.when(key % 3 == 0, full).when(key % 3 == 1, some).otherwise(F.lit("port: 8080"))
    # Short rows, but much work each: a table of few bytes is worth dealing out.
    rows = spread(table(spark, d, "part").select("p_partkey", "p_brand", "p_size"), 1 << 16)
    parts = rows.select("p_partkey", "p_brand", text.alias("text"))
    return I.numeric_facts(parts, "p_partkey", "text", F.col("p_brand")).drop("confidence")


_QUESTION = "trade between nation_3 NATION_3 france germany and japan"


@query("near_entities", f"SELECT n_nationkey::VARCHAR AS id, n_name AS name FROM nation WHERE list_contains(string_split(lower('{_QUESTION}'), ' '), lower(n_name)) ORDER BY length(n_name) DESC, n_nationkey::VARCHAR LIMIT 5")
def near_entities(spark, d):
    """Entities of the nation table named in one fixed question (whole words)."""
    from memloom.operators.graph import match_entities

    nation = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), F.lit("{}").alias("properties"))
    return match_entities(nation, _QUESTION, 5).select("id", "name")
