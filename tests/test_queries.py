"""Every registered query of the rollout operators against its SQL, and that the contract's functions agree."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from spanmill.plans import queries
from tests.conftest import same_rows, tables


#: On the smallest tables the variants of a pair have different prompts, which is an error.
LARGER = {"bootstrap_ci", "bootstrap_seeded", "paired_delta"}


@pytest.mark.parametrize("name", sorted(set(queries.SQL) - LARGER))
def test_sql(spark, duck, sf_dir, name):
    same_rows(queries.QUERIES[name](spark, sf_dir), duck.sql(queries.SQL[name]))


@pytest.mark.parametrize("name", sorted(LARGER))
def test_sql_on_larger_tables(spark, name):
    folder = "/root/testdata/sf0.01"
    same_rows(queries.QUERIES[name](spark, folder), tables(folder).sql(queries.SQL[name]))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_rows(spark, name):
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_without_the_training_data_operators(tmp_path):
    """The rest imports and registers its queries when that subpackage is gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(entry.__file__).parent
    shutil.copytree(root / "spanmill", tmp_path / "spanmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(q.startswith('op') or q == 'pipeline' for q in e.queries()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, check=True)
    assert said.stdout.split() == [str(len(queries.QUERIES)), str(len(queries.SQL)), "False"]


def test_top_p_where_the_mass_is_p_itself(spark, tmp_path):
    """Orders whose dearest lines make up 0.6 of the price to the cent: the last digit decides, as in the SQL."""
    import duckdb

    lines = []
    for k in range(600):
        big, parts = [30_000_00 + 3 * (k * 7919 % 100_003) + 3 * i for i in range(1 + k % 2)], 1 + k // 2 % 3
        rest = sum(big) // 3 * 2
        small = [rest // parts] * (parts - 1)
        lines += [(k, i + 1, x / 100, 1.0) for i, x in enumerate([*small, rest - sum(small), *big])]
    spark.createDataFrame(lines, "l_orderkey bigint, l_linenumber int, l_extendedprice double, l_quantity double").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    same_rows(queries.QUERIES["top_p_mask"](spark, str(tmp_path)), con.sql(queries.SQL["top_p_mask"]))
