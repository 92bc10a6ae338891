"""The queries opN_<name> of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm.ann import nearest
from memloom.llm.decontam import contaminated
from memloom.llm.langid import held_out, identify_languages, learn_languages
from memloom.llm.licenses import KNOWN, SPELLINGS, known_digests, known_licenses, license_scan
from memloom.llm.lines import line_dedup
from memloom.llm.mixing import mix_to_targets
from memloom.llm.quality import fit_quality, score_quality
from memloom.llm.simhash import simhash_dedup
from memloom.llm.substring import substring_dedup
from memloom.llm.toxicity import fit_chain, score_toxicity

#: Toxicity categories in the order of the chain, over ``labels``.
CATEGORIES = {"junk": "1 - quality", "toxic": "toxic"}
#: Mixing domains over ``labels`` (the first that holds wins) and their target weights.
DOMAINS = {"toxic": "toxic = 1", "junk": "quality = 0", "clean": "quality = 1"}
TARGETS = {"toxic": 0.01, "junk": 0.04, "clean": 0.95}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of ``documents``: what is left after repeated windows of 35 words go."""
    out = substring_dedup(_read(spark, sf_dir, "documents"), min_words=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


_SQL_OP1 = r"""
WITH w AS (
  SELECT doc_id, coalesce(list_filter(string_split_regex(text, '[ \t\n\v\f\r]+'), lambda x: x <> ''), []) AS words,
         row_number() OVER () AS rid
  FROM documents),
s AS (SELECT rid, unnest(range(1, greatest(len(words) - 33, 1))) AS p FROM w WHERE len(words) >= 35),
g AS (SELECT s.rid, p, array_to_string(words[p:p + 34], ' ') AS seq FROM s JOIN w USING (rid)),
r AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY seq) AS n FROM g) WHERE n > 1),
gone AS (SELECT DISTINCT rid, p + k AS at FROM r, range(35) t(k)),
kept AS (
  SELECT u.rid, string_agg(u.word, ' ' ORDER BY u.at) AS kept, count(*) AS n
  FROM (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS at FROM w) u
  ANTI JOIN gone ON gone.rid = u.rid AND gone.at = u.at
  GROUP BY u.rid)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (rid)
"""


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: digest of the canonical text, and the licence that it is."""
    return license_scan(_read(spark, sf_dir, "documents"), known_licenses(spark), digests=known_digests(spark))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql_canonical(column: str) -> str:
    x = f"regexp_replace(lower({column}), '(?m)^[^a-z\\n]*(copyright|\\(c\\)|©|all rights reserved)[^\\n]*', '', 'g')"
    for a, b in SPELLINGS:
        x = f"replace({x}, '{a}', '{b}')"
    return f"trim(regexp_replace({x}, '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g'))"


_SQL_OP2 = f"""
WITH known AS (
  SELECT sha256(c) AS canonical_sha256, min(license_id) AS license_id
  FROM (SELECT license_id, {_sql_canonical("t")} AS c FROM (VALUES {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in KNOWN.items())}) v(license_id, t))
  WHERE c <> '' GROUP BY 1),
d AS (SELECT doc_id, sha256({_sql_canonical("text")}) AS canonical_sha256 FROM documents)
SELECT doc_id, canonical_sha256, license_id FROM d LEFT JOIN known USING (canonical_sha256)
"""


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: 64-bit fingerprint, and the least id reachable over links of three bits or fewer."""
    return simhash_dedup(_read(spark, sf_dir, "documents"), radius=3, width=3)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: probabilities along the chain; toxic is whether the last is a quarter or more.

    Toxic documents are one in ten: out of fold a quarter has no more false alarms than a half, and misses fewer.
    """
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    chain = fit_chain(docs, _read(spark, sf_dir, "labels"), CATEGORIES)
    return score_toxicity(docs, chain).select("doc_id", "p_junk", "p_toxic", (F.col("p_toxic") >= 0.25).alias("toxic"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: predicted language; learned from the documents that are not held out."""
    docs = _read(spark, sf_dir, "documents")
    model = learn_languages(docs.where(F.col("doc_id").isNotNull() & ~held_out()))
    found = identify_languages(docs.select("doc_id", "text"), model, need_text=False)
    spans = F.size("lang_spans").cast("long").alias("n_spans")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", spans)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, lines removed as copies of a chunk elsewhere, and a digest of what is left."""
    out = line_dedup(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


_SQL_OP6 = r"""
WITH l AS (
  SELECT doc_id, text, row_number() OVER () AS rid, string_split(text, chr(10)) AS ls FROM documents),
x AS (SELECT rid, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l),
h AS (SELECT *, ('0x' || left(md5(line), 8))::BIGINT AS h FROM x),
e AS (SELECT *, CASE WHEN i > 1 AND (31 * lag(h) OVER w + h) % 4 = 0 THEN 1 ELSE 0 END AS ends FROM h WINDOW w AS (PARTITION BY rid ORDER BY i)),
c AS (SELECT *, coalesce(sum(ends) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM e),
g AS (SELECT rid, doc_id, chunk, min(i) AS first, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS t FROM c GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, first) AS nth FROM g WHERE n > 1),
gone AS (SELECT rid, chunk FROM k WHERE nth > 1),
kept AS (SELECT rid, string_agg(line, chr(10) ORDER BY i) AS t, count(*) AS n FROM c ANTI JOIN gone USING (rid, chunk) GROUP BY rid)
SELECT doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, (coalesce(len(ls), 0) - coalesce(n, 0))::BIGINT AS n_removed,
       CASE WHEN text IS NULL THEN NULL ELSE sha256(coalesce(t, '')) END AS kept_sha256
FROM l LEFT JOIN kept USING (rid)
"""


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items that they hold, with similarity (0.8 or more) and place."""
    return contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: posterior of the weak labels, the scorer's probability, and whether to keep it (a quarter or more)."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_quality(docs, fit_quality(docs))
    return out.select("doc_id", "p_weak", "quality", (F.col("quality") >= 0.25).alias("keep"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for each vector whose id is divisible by 20."""
    vectors = _read(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: tokens, domain posteriors and the rate that meets the target weights."""
    out = mix_to_targets(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), DOMAINS, TARGETS)
    shares = [F.col("posterior")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)]
    return out.select("doc_id", "n_tokens", *shares, "rate")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_substring_dedup, op2_license_scan, op3_simhash_dedup, op4_toxicity, op5_language_id, op6_line_dedup,
            op7_benchmark_decontamination, op8_quality_classifier, op9_nearest_neighbours, op10_mixing,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": _SQL_OP1, "op2_license_scan": _SQL_OP2, "op6_line_dedup": _SQL_OP6}
