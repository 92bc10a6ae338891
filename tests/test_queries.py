"""Every registered query with SQL against DuckDB on the smallest tables."""

import math

import pytest

from memloom.plans import registry

NAMES = sorted(registry.queries())
#: Queries without SQL and the tests that hold their results against plain computations or on literals.
CHECKED = {
    "mmr_rerank": "test_facade", "hybrid_search": "test_facade", "typed_token_index": "typed_tokens_of_parts has SQL for all types",
    "entity_types": "test_functions", "symbolic_summaries": "test_functions", "anchor_grouping": "test_unchecked", "prune_report": "test_unchecked",
    "chunks_topic_shift": "test_unchecked", "chunks_structural": "test_unchecked",
}


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return str(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19].replace("T00:00:00", "")
    x = float(v)
    return "nan" if math.isnan(x) else f"{x:.6g}"


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, data, name):
    df = registry.queries()[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name in registry.oracle_sql():
        r = duck.execute(registry.oracle_sql()[name])
        have = [x[0] for x in r.description]
        assert sorted(have) == cols
        at = [have.index(c) for c in cols]
        assert got == sorted(tuple(plain(row[i]) for i in at) for row in r.fetchall())
    else:
        assert name in CHECKED, "a query without SQL needs a test of its own"
