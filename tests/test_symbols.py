from memloom.functions import symbols
from memloom.functions import text as T
from pyspark.sql import functions as F

ODD = [
    None, "", "   ", "x", "0 is the first sentence of twenty letters 0", "We decided. It was because of 1. Hopeless ²hope 5fear x_joy unlove",
    "C# and .NET; a.net b2.net can't wait! no idea? at first Api-Nyckel fast besluten, OLIKA kom fram till det här för länge sedan",
    "Ångström Éa ÉAB Ⅳx ǅabc A_B Straße İstanbul ΣΑΣ Abc1 Def", 'He said "yes, we agreed on the required design" and left.\nThen nothing more was said',
    "aaa1bbb cccc dddd4 eeee_ffff 12345 ½half", "word " * 60 + ". " + "important since " * 12,
]


def columns_line(x):
    """The line put together from the column functions."""
    e, t, q, m, f = T.entity_codes(x), T.topics(x), T.key_sentence(x), T.emotions(x), T.flags(x)
    return F.concat_ws(
        "|",
        F.concat(F.lit("0:"), F.when(F.size(e) > 0, F.array_join(e, "+")).otherwise("???")),
        F.when(F.size(t) > 0, F.array_join(t, "_")).otherwise("misc"),
        F.when(q != "", F.concat(F.lit('"'), F.replace(q, F.lit('"'), F.lit("'")), F.lit('"'))),
        F.when(F.size(m) > 0, F.array_join(m, "+")),
        F.when(F.size(f) > 0, F.array_join(f, "+")),
    )


def test_line_is_that_of_the_columns(spark, data):
    texts = spark.createDataFrame([(t,) for t in ODD], "text string").unionByName(spark.read.parquet(f"{data}/documents.parquet").select("text"))
    for r in texts.select("text", columns_line(F.col("text")).alias("want"), T.symbolic(F.col("text")).alias("got")).collect():
        assert r["got"] == r["want"] == symbols.line(r["text"]), r["text"]


def test_quote_keeps_digits(spark):
    text = "0 is the first sentence of twenty letters 0"
    assert spark.range(1).select(T.key_sentence(F.lit(text)), T.symbolic(F.lit(text))).first()[0] == text
    assert f'"{text}"' in spark.range(1).select(T.symbolic(F.lit(text))).first()[0]
