"""The corpus pipeline: five stages over ``documents``, each written as Parquet and reread by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom.llm.common import materialize, row_key
from memloom.llm.decontam import contaminated
from memloom.llm.jaccard import near_copies
from memloom.llm.langid import held_out, identify_languages, learn_languages
from memloom.llm.lines import line_dedup
from memloom.llm.mixing import mix_to_targets
from memloom.llm.queries import DOMAINS, TARGETS

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents with a language score below this are rejected.
LEAST_SCORE = 0.4


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or without a clear main language, go; ``lang`` becomes the predicted one."""
    base = docs.select(*COLUMNS)
    model = learn_languages(base.where(F.col("doc_id").isNotNull() & ~held_out()))
    found = identify_languages(base, model)
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of two or more lines go; so do documents of which nothing but blanks is left by that."""
    out = line_dedup(docs, keep=("lang", "source", "n_chars"), runs=True)
    emptied = (F.col("n_removed") > 0) & (F.trim("kept_text") == "")
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return out.where(F.col("kept_text").isNull() | ~emptied).select(
        "doc_id", F.col("kept_text").alias("text"), "lang", "source", n_chars.alias("n_chars")
    )


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts of similarity 0.8 or more (five-word shingles) the row of the least id stays."""
    base = docs.select(*COLUMNS)
    # Decided per row, so that rows of a null or a repeated id are told apart; null ids come last.
    place = F.struct(F.col("jc_id").isNull(), "jc_id", "jc_row")
    stays = near_copies(base).groupBy("jc_root").agg(F.min(place).alias("p")).select(F.col("p.jc_row").alias("pl_row"))
    first = Window.partitionBy("pl_row").orderBy(F.xxhash64("lang", "source", "n_chars"))
    return (
        base.withColumn("pl_row", row_key("doc_id", "text")).join(stays, "pl_row", "left_semi")
        .withColumn("pl_n", F.row_number().over(first)).where("pl_n = 1").select(*COLUMNS)
    )


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, decided per row of id and text."""
    base = docs.select(*COLUMNS).withColumn("pl_row", row_key("doc_id", "text"))
    found = contaminated(base, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="pl_row")
    return base.join(found.select("pl_row").distinct(), "pl_row", "left_anti").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rates that meet the target weights; ``copies`` is the rate rounded by a hash of the id, and rows of none go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = mix_to_targets(docs, labels, DOMAINS, TARGETS, keep=COLUMNS)
    dice = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("copies")), F.lit(1 << 20)) / (1 << 20)
    copies = F.floor(F.col("rate") + dice).cast("long")
    return out.withColumn("copies", copies).where("copies > 0").select(*COLUMNS, "n_tokens", "rate", "copies")


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs


#: Learned models and 64-bit xxHash fingerprints are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None
