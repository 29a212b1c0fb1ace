"""Every registered query against its SQL, and what all plans must keep to."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract

QUERIES, SQL = contract.queries(), contract.oracle_sql()
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def comparable(rows):
    plain = [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows]
    return sorted(plain, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    assert got
    if name not in SQL:
        return
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in result.fetchall()]
    assert comparable(got) == comparable(want)


def test_workers_find_the_package_from_anywhere(sf_dir, tmp_path):
    """Started elsewhere and without the package on the workers' path."""
    code = f"""
import sys; sys.path.insert(0, {str(Path(contract.__file__).parent)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__
print("pages:", __spark_entry__.queries()["s5_page_articles"](spark, {sf_dir!r}).count())
"""
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=300)
    assert "pages: 50" in done.stdout, done.stderr[-2000:]


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_window_filter_reaches_the_scan(spark, sf_dir):
    plan = QUERIES["f1_calendar_window"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts," in plan
    assert "props" not in plan.split("ReadSchema")[1]


def test_cap_cuts_before_each_shuffle(spark, sf_dir):
    plan = QUERIES["l1_cap_large_table"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    # A partial and a final cut for the slots, and again for the groups.
    assert plan.count("WindowGroupLimit") == 4


def test_callouts_need_no_shuffle(spark, sf_dir):
    from tidings.operators.callouts import callouts
    from tidings.plans import adapters as A

    items = A.document_items(spark, sf_dir)
    before = items._jdf.queryExecution().executedPlan().toString().count("Exchange")
    after = callouts(items)._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert after == before
