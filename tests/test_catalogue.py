"""Every query against its SQL, and the driver's contract."""

import datetime
import math
import os
import re
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from tessella.plans import written  # noqa: F401  adds its queries
from tessella.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted((tuple(map(plain, r)) for r in found.fetchall()), key=str)
    assert sorted((tuple(map(plain, r)) for r in df.select(*names).collect()), key=str) == want


def test_every_query_has_its_sql():
    assert set(ORACLE_SQL) == set(QUERIES)


@pytest.mark.parametrize("blocked", ["tessella.llm", "xxhash", "corpus_pipeline"])
def test_entry_without_the_llm_queries(blocked):
    code = f"import sys; sys.modules[{blocked!r}] = None; import __spark_entry__ as e; print(sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(__spark_entry__.__file__))
    assert "spec_filter_range" in out.stdout and "pipeline" not in out.stdout, out.stderr
    assert ("op1_" in out.stdout) == (blocked == "corpus_pipeline" and os.path.isdir(f"{os.path.dirname(__spark_entry__.__file__)}/tessella/llm"))


def test_contract(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "p_partkey" in df.columns
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_reach_the_scan(spark):
    plan = QUERIES["spec_filter_range"](spark, SF)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(p_size,10)" in plan and "TakeOrderedAndProject" in plan


@pytest.mark.parametrize("name", ["closest_length_resolve", "match_forward", "spec_pages", "listing_pages", "zipped_rows", "priced_pages", "mention_resolution"])
def test_long_work_on_a_small_file_is_dealt(spark, name):
    assert QUERIES[name](spark, SF).rdd.getNumPartitions() >= 8


#: Joins with a side of one row, or with the fifty rows of a ranked list.
NESTED = {"dense_negative_control": 1, "rrf_fusion": 1, "rrf_rounded": 1, "hybrid_topk": 1, "integrity_totals": 2, "catalogue_totals": 2, "family_context": 4, "substring_interval_join": 1, "recalls_inserted": 2}


def test_no_query_needs_a_cross_product(spark):
    for name, query in QUERIES.items():
        plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name
        rows = len(re.findall("BroadcastNestedLoopJoin", plan))
        assert rows <= NESTED.get(name, 0), (name, plan)


def test_nothing_but_the_entry_imports_the_llm_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(f"{root}/tessella"):
        if not folder.endswith("llm"):
            for f in files:
                if f.endswith(".py"):
                    assert "tessella.llm" not in open(f"{folder}/{f}").read(), f
