"""Every registered query against its SQL on the smallest test tables."""

import os

import pytest

from codeprism.plans import queries as core

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, oracle, name):
    df = core.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    rel = oracle.execute(core.ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    assert got == sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in rel.fetchall())


def test_overlap_confirms_the_whole_digest(spark, tmp_path):
    """Two unlike windows whose digests begin with the same 32 bits don't overlap."""
    text = lambda i: f"w{i} a b c d e f g h i"
    spark.createDataFrame([(1, text(10463)), (2, text(78953))], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, text(78953))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [tuple(r) for r in core.QUERIES["benchmark_overlap"](spark, str(tmp_path)).select("doc_id", "item_id", "windows").collect()] == [(2, 7, 1)]


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(core.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).count() > 0


def test_filters_reach_the_scan(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    plan = core.QUERIES["pricing_summary"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThanOrEqual(l_shipdate" in plan and "l_orderkey" not in plan
