from pyspark.sql import functions as F

from memloom.plans import registry
from memloom.sources import ingest as I


def test_facts_of_one_small_file_are_dealt_out(spark, tmp_path):
    rows = spark.range(60000).select(F.col("id").alias("p_partkey"), F.md5(F.col("id").cast("string")).alias("p_brand"), (F.col("id") % 50).cast("int").alias("p_size"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    out = registry.queries()["numeric_facts"](spark, str(tmp_path))
    assert out.rdd.getNumPartitions() > 1 and out.count() == 20000 * 6 + 20000 * 2 + 20000


def test_facts_where_no_pattern_or_one_holds(spark):
    rows = [(1, None), (2, "nothing"), (3, "a RETURN"), (4, "x PORT: 80 TIMEOUT 5 MS"), (5, "Run(x) TAKES 3 and v٣.٤"), (6, "f returns int")]
    got = I.numeric_facts(spark.createDataFrame(rows, "i long, t string"), "i", "t").select("i", "subject", "predicate", "object")
    assert sorted(map(tuple, got.collect())) == [
        (4, "80", "has_timeout", "5MS"), (4, "source", "uses_port", "80"),
        (5, "Run", "has_param_count", "3"), (5, "and", "has_version", "٣.٤"), (6, "unknown", "returns_type", "int"),
    ]
