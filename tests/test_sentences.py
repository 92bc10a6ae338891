from memloom.functions import text as T
from memloom.plans import registry
from pyspark.sql import functions as F


def test_sentences_keep_digits_at_their_ends(spark):
    rows = [(1, "0 first. Ends in 1\n\n2nd 2! 3\n\n\n\tthird block 2 \n\n"), (2, " 1 ")]
    got = {r["i"]: r["s"] for r in spark.createDataFrame(rows, "i long, x string").select("i", T.sentences(F.col("x")).alias("s")).collect()}
    assert got == {1: ["0 first.", "Ends in 1", "2nd 2!", "3", "third block 2"], 2: ["1"]}


def test_sentence_split_as_by_sql(spark, duck, tmp_path):
    rows = [(1, "0 a. key=b8a1\n\n\nx 2"), (2, "\n a.\tb 1\n\n\t \n\nc?\n3\x0b4"), (3, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sql = registry.oracle_sql()["sentence_split"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert {tuple(r) for r in registry.queries()["sentence_split"](spark, str(tmp_path)).collect()} == set(duck.execute(sql).fetchall())
