import os
import random

import pytest
from pyspark.sql import functions as F

from confab.plans.components import connected_components
from confab.plans.lineage import cut_lineage, release, shared_dir
from confab.plans.ranks import global_rank, running_total


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components(spark):
    rng = random.Random(2)
    chain = [(k, k + 1) for k in range(1000, 1060)]
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(90)] + chain + [(5, 5), (1, 2), (2, 1), (1, 2)]
    found = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert len(found) == len({r["node"] for r in found}) and {r["node"]: r["root"] for r in found} == brute(edges)
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_star_of_thousands(spark):
    edges = [(0, k) for k in range(1, 3000)]
    found = connected_components(spark.createDataFrame(edges, "u long, v long"))
    assert found.where("root = 0").count() == found.count() == 3000


def test_ranks_and_totals(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 40), k, rng.randint(0, 9)) for k in range(500)]
    frame = spark.createDataFrame(rows, "a int, b int, w int").repartition(7)
    order = sorted(rows)
    ranked = {r["b"]: r["rank"] for r in global_rank(frame, ["a", "b"], partitions=5).collect()}
    assert ranked == {r[1]: k for k, r in enumerate(order)}
    total, want = 0, {}
    for _, b, w in order:
        want[b] = total
        total += w
    assert {r["b"]: r["before"] for r in running_total(frame, ["a", "b"], "w", "before").collect()} == want
    assert running_total(frame.limit(0), ["a"], "w", "t").count() == 0


def test_lineage_is_cut_in_the_shared_folder(spark):
    frame = spark.range(10).withColumn("x", F.lit("a"))
    cut = cut_lineage(frame, "t")
    assert cut.schema.simpleString() == frame.schema.simpleString() and cut.count() == 10
    path = cut.inputFiles()[0].split("://")[-1]
    assert shared_dir(spark).split("://")[-1] in path
    plan = cut._jdf.queryExecution().toString()
    assert "Range" not in plan and "parquet" in plan
    release(spark, cut)
    assert not os.path.exists(path)


class _Session:
    """Just enough of a session to ask for its folder."""

    def __init__(self, conf, own):
        self.conf, self.sparkContext, self.made = {"spark.checkpoint.dir": conf} if conf else {}, self, own

    _jsc = property(lambda self: self)
    sc = lambda self: self
    getCheckpointDir = lambda self: self
    isDefined = lambda self: self.made is not None
    get = lambda self: self.made

    def setCheckpointDir(self, path):
        self.made = path


def test_the_folder_is_the_sessions_own_where_it_has_one():
    assert shared_dir(_Session("s3://x/ck", None)) == "s3://x/ck"
    assert shared_dir(_Session(None, "file:/ck")) == "file:/ck"
    fresh = _Session(None, None)
    assert shared_dir(fresh).startswith("file:///") and shared_dir(fresh) == fresh.made


def test_a_cluster_has_to_name_its_folder():
    far = _Session(None, None)
    far.conf["spark.master"] = "spark://host:7077"
    with pytest.raises(ValueError):
        shared_dir(far)


def test_running_fold_reads_a_long_group_in_batches(spark):
    from confab.plans.folds import running_fold

    frame = spark.range(45_000).selectExpr("id % 2 as k", "id as o")

    def fold(rows):
        total = 0
        for (o,) in rows:
            total += o
            yield o, total

    found = running_fold(frame, "k", ["o"], ["o"], fold, "o long, total long")
    assert found.count() == 45_000 and found.where("o = 44998").first()["total"] == sum(range(0, 45_000, 2))
    assert "collect_list" not in found._jdf.queryExecution().toString()


def test_written_tables_leave_no_shuffle_files_and_the_setting(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    cut = cut_lineage(spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count(), "t")
    assert cut.count() == 7 and spark.conf.get(key, None) == before


def test_ordered_fold(spark):
    from confab.plans.folds import ordered_fold

    rows = [(1, 3, "c"), (1, None, "n"), (2, 0, None), (1, 1, "a"), (None, 5, "x"), (1, 1, "b")]
    frame = spark.createDataFrame([(*r, 9) for r in rows], "k int, o int, t string, other int")
    fold = lambda group: [(len(group), "".join(t or "-" for _, t in group))]
    found = ordered_fold(frame, "k", ["o"], ["o", "t"], fold, "n int, s string")
    assert found.columns == ["k", "n", "s"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(1, 4, "nabc"), (2, 1, "-"), (None, 1, "x")], key=str)
    assert ordered_fold(frame.limit(0), "k", ["o"], ["o", "t"], fold, "n int, s string").count() == 0
    assert ordered_fold(frame, "k", ["o"], ["o", "t"], lambda g: [], "n int, s string").count() == 0
