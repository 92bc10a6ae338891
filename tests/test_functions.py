import pytest
from pyspark.sql import functions as F

from memloom.functions import text as T
from memloom.functions import vec as V


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    "name, kind",
    [
        ("1.5", "concept"), ("v2.1", "concept"), (".razor", "tool"), ("src/app/main.py", "tool"), ("docker", "tool"), ("Acme Logistics AB", "organization"),
        ("google", "organization"), ("order-db", "tool"), ("OrderDB", "tool"), ("kaos", "concept"), ("System.Text.Json", "tool"), ("KnowledgeGraph", "tool"),
        ("MAX_SIZE", "tool"), ("user42", "person"), ("user-service", "project"), ("Jonas Andersson", "person"), ("Jan von Sydow", "person"),
        ("billing platform", "project"), ("", "concept"), (None, "concept"), ("love", "concept"),
    ],
)
def test_entity_type(spark, name, kind):
    assert one(spark, name, T.entity_type) == kind


def test_fold_and_canonical(spark):
    assert one(spark, "Åsa Ærø straße Þor", T.fold_ascii) == "Asa AEro strasse Thor"
    assert one(spark, "Duck-DB _x Å", T.canonical_name) == "duckdbxa"
    assert one(spark, "Ängsl æß", T.strip_accents) == "angsl æß"


def test_slug(spark):
    assert one(spark, "  My Page_Name/Sub  Topic!! ", T.slug) == "my-page-name/sub-topic"
    assert one(spark, "!!!", T.slug) is None


def test_typed_tokens(spark):
    got = one(spark, "System.Text.Json uses 0xFF and 007 with 3 args, parse_it(x) 1.50", T.typed_tokens)
    assert {(r["type"], r["value"]) for r in got} >= {("qualified", "System.Text.Json"), ("hex", "0xff"), ("number", "7"), ("arity", "3"), ("funcall", "parse_it"), ("number", "1.50")}


def test_importance_orders(spark):
    low, high = one(spark, "hello there", T.importance), one(spark, "We decided it must use 5 retries because it is critical. " * 5, T.importance)
    assert 0 <= low < high <= 1
    assert one(spark, " ", T.importance) == pytest.approx(0.1)


def test_hall(spark):
    assert one(spark, "the password and jwt token", T.hall_of_text) == "security"
    assert one(spark, "nothing of note", T.hall_of_text) == "general"
    assert one(spark, "rapid cicd? ci/cd pipeline build", T.hall_of_text) == "devops"


def test_rooms(spark):
    for path, room in (("C:\\a\\Controllers\\x.cs", "controllers"), ("/a/tests/x", "tests"), ("/a/b.spec.ts", "tests"), ("/a/b", "source"), ("/a/Migration/b", "migrations")):
        assert one(spark, path, T.room_of_path) == room


def test_summary(spark):
    got = one(spark, "We decided to use DuckDB for Search. It was worried about the index size because of memory.", T.symbolic)
    assert got.startswith("0:DUC+SEA|") and got.endswith("|determ+anx|DECISION+TECHNICAL")


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0], [2.0, 0.0])], "a array<float>, z array<float>, b array<float>")
    r = df.select(V.cosine(F.col("a"), F.col("b")), V.cosine(F.col("a"), F.col("z")), V.dot(F.col("a"), F.col("b"))).first()
    assert tuple(r) == (1.0, 0.0, 2.0)


def test_snippet_and_quality(spark):
    assert one(spark, "a" * 200 + "needle" + "b" * 300, lambda c: T.snippet(c, "needle")) == "…" + "a" * 80 + "needle" + "b" * 120
    assert one(spark, "[[a/b]] text\n## h", lambda c: T.wiki_quality(c, F.lit(1), F.lit("x/y"))) == pytest.approx(0.3 * 4 / 150 + 0.7, abs=0.01)
    assert [one(spark, x, T.is_numeric) for x in ("1.5", "-3e5", "abc", "v1")] == [True, True, False, False]


def test_summary_round_trip(spark):
    text = "We decided to use DuckDB for Search. It was worried about the index size because of memory."
    df = spark.createDataFrame([(text,)], "x string").select(T.symbolic(F.col("x"), F.lit("w"), F.lit("r"), None, F.lit("file")).alias("s"))
    r = df.select(T.parse_symbolic(F.col("s")).alias("p")).first()["p"]
    assert (r["wing"], r["room"], r["date"], r["stem"]) == ("w", "r", None, "file")
    assert r["entities"] == ["DUC", "SEA"] and r["emotions"] == ["determ", "anx"] and r["flags"] == ["DECISION", "TECHNICAL"]
    assert r["quote"].startswith("It was worried") or r["quote"].startswith("We decided")
