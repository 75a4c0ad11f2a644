"""Prefix sums, components and stored tables against plain Python."""

import random
import subprocess
import sys
from pathlib import Path
from unittest.mock import MagicMock

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomfield.plans import components, prefix, shared


@pytest.mark.parametrize("bits", [0, 3])
def test_prefix_sums(spark, bits):
    rng = random.Random(1)
    rows = [(i, rng.choice("aaab"), rng.randrange(1 << 60), rng.randrange(9)) for i in range(300)] + [(300, "b", 5, 1), (301, "b", 5, 2)]
    df = spark.createDataFrame(rows, "id long, g string, key long, v long").withColumn("b", prefix.high_bits(F.col("key"), bits))
    got = {r.id: r.before for r in prefix.prefix_in_groups(df, "g", "b", ["key", "id"], "v", "before").collect()}
    for g in "ab":
        total = 0
        for i, _, _, v in sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0])):
            assert got[i] == total
            total += v


def test_prefix_sums_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(prefix, "MOST_BUCKETS", 0)
    df = spark.createDataFrame([(i, "g", i % 4) for i in range(40)], "v long, g string, b int")
    got = sorted((r.b, r.v, r.s) for r in prefix.prefix_in_groups(df, "g", "b", ["v"], "v", "s").collect())
    total = 0
    for _, v, s in got:
        assert s == total
        total += v


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(-20, 20), st.integers(-20, 20)), max_size=30))
def test_components(spark, edges):
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    got = {r.node: r.component for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for i in up}


def test_a_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert components.connected(edges).where("component <> 0").count() == 0


def test_stored_tables(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "i int, s string")
    back, at = shared.materialize_at(df, "t")
    assert back.schema == df.schema and sorted(map(tuple, back.collect())) == [(1, None), (2, "x")]
    shared.discard(spark, at)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(at)
    assert shared.materialize(df.limit(0), "t").count() == 0


def test_a_cluster_must_name_its_shared_folder(monkeypatch):
    class Context:
        applicationId, master = "cluster", "spark://host:7077"

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session())
    Session.conf = {"spark.checkpoint.dir": "hdfs://x/y/"}
    Context._jvm, Context._jsc, left = MagicMock(), MagicMock(), []
    monkeypatch.setattr(shared.atexit, "register", lambda *a: left.append(a))
    assert shared.shared_dir(Session()) == shared.shared_dir(Session()) == "hdfs://x/y/loomfield/cluster"
    ((remove, at, _),) = left  # once, when the process ends
    remove(at, None)
    at.getFileSystem.return_value.delete.assert_called_once_with(at, True)
    shared._own.pop("cluster")


def test_tables_go_with_the_driver(tmp_path):
    code = f"""
from pyspark.sql import SparkSession
from loomfield.plans import shared
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}").getOrCreate()
assert shared.materialize(s.range(3), "t").count() == 3
import os
assert os.listdir("{tmp_path}/loomfield") == [s.sparkContext.applicationId]
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1], timeout=120)
    assert list((tmp_path / "loomfield").iterdir()) == []
