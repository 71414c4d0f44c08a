"""Every query with SQL gives the SQL's rows on the smallest tables; the others run."""

import math
import os

import duckdb
import pytest

from framescore.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "None"
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(_plain(r[c]) for c in cols) for r in df.collect())
    assert got
    if name in registry.ORACLES:
        cur = duck.execute(registry.ORACLES[name])
        names = [x[0] for x in cur.description]
        assert sorted(names) == cols
        assert got == sorted(tuple(_plain(dict(zip(names, r, strict=True))[c]) for c in cols) for r in cur.fetchall())


def test_clauses_on_new_lines(spark, tmp_path):
    """A line end before, after or alone in a clause, as the SQL has it."""
    texts = ["a b c d.\na b c d. a b c d", "a. \n. \t\nb;\n", " a  b!\n\na b\n?a b.\x0b", "A b c d e f g.\na B c d e f g", "x. And.\nAnd. x 1.1 x", ""]
    rows = [(1, i, t) for i, t in enumerate([*texts, "end"])]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(tuple(r) for r in registry.QUERIES["clause_dedup"](spark, str(tmp_path)).select("id", "clauses", "kept").collect())
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert got == sorted(c.execute(f"SELECT id, clauses, kept FROM ({registry.ORACLES['clause_dedup']})").fetchall()) and len(got) == len(texts)


@pytest.mark.parametrize("name", ["ro_reward", "total_reward", "eval_bundle"])
def test_rows_of_a_small_file_are_dealt_out(spark, name):
    """A file that one task reads: what is made of its rows is done by several, and parsing once a row."""
    df = registry.QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" in plan
    if name == "ro_reward":
        assert plan.count("regexp_extract_all") == 5


@pytest.mark.parametrize("name", ["meteor", "eval_bundle_full"])
def test_few_conversations_are_dealt_out(spark, name):
    """Neither the size of the file nor adaptive execution puts all pairs of a small table into one task; nothing but one exchange moves them."""
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "Window" in plan
    assert plan.split("Window", 1)[1].count("Exchange hashpartitioning(conv_id") >= 1
    if name == "meteor":
        assert plan.count("Exchange") == 1


@pytest.mark.parametrize("name", ["meteor_alignment", "effective_length"])
def test_events_and_documents_are_dealt_out(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" in plan and plan.count("Exchange") == 1
