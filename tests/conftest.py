"""A Spark session and the test tables."""

from __future__ import annotations

import os
import shutil
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])  # for Spark's Python workers

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    folder = tmp_path_factory.mktemp("checkpoints")

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(folder))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
    shutil.rmtree(folder, ignore_errors=True)


@pytest.fixture(scope="session")
def sf_dir():
    return SF


def tables(folder):
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


@pytest.fixture(scope="session")
def duck(sf_dir):
    return tables(sf_dir)


def plain(value):
    """A value that compares across engines."""
    if isinstance(value, float):
        return "nan" if value != value else round(value, 5) + 0.0
    if isinstance(value, list | tuple):
        return tuple(map(plain, value))
    return value


def same_rows(df, relation) -> None:
    assert sorted(df.columns) == sorted(relation.columns)
    names = sorted(df.columns)
    at = [relation.columns.index(n) for n in names]
    ours = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in relation.fetchall()), key=repr)
    assert ours == theirs
