import itertools

import pytest

from confab.llm import hilbert as X
from tests.llm import messy


@pytest.mark.parametrize(("n", "bits"), [(1, 4), (2, 4), (3, 3), (4, 2)])
def test_neighbours_on_the_curve_are_neighbours_in_space(spark, n, bits):
    from pyspark.sql import functions as F

    cells = list(itertools.product(range(1 << bits), repeat=n))
    frame = spark.createDataFrame(cells, ", ".join(f"c{k} int" for k in range(n)))
    rows = frame.select("*", X.hilbert_index([F.col(f"c{k}") for k in range(n)], bits).alias("h")).collect()
    place = {r["h"]: r[:n] for r in rows}
    assert sorted(place) == list(range(len(cells)))
    assert all(sum(abs(a - b) for a, b in zip(place[k], place[k + 1])) == 1 for k in range(len(cells) - 1))


def test_shards_are_even_and_prune(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    params = X.HilbertParams(target=40_000)
    found = X.assign_shards(docs, params).join(docs.select("doc_id", "n_chars"), "doc_id").orderBy("hilbert", "doc_id").collect()
    before = 0
    for r in found:
        assert r["shard"] == before // 40_000
        before += r["n_chars"]
    stats = X.shard_statistics(docs, params).collect()
    assert sum(r["rows"] for r in stats) == docs.count()
    touched = [sum(1 for r in stats if r["min_source"] <= s <= r["max_source"]) for s in ("src0", "src7")]
    assert max(touched) < 0.7 * len(stats)


def test_written_files_hold_every_row(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    X.write_shards(docs, str(tmp_path / "out"), X.HilbertParams(target=100_000))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.columns == docs.columns and back.exceptAll(docs).count() == 0 and back.count() == docs.count()
    assert len(list((tmp_path / "out").glob("*.parquet"))) > 1


def test_files_and_statistics_are_those_of_the_shards(spark, tmp_path):
    rows = [(k * 37 % 400, "s", "en", 3000 if k % 50 == 0 else 100, "own") for k in range(400)]  # two cells, cut within
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, shard string")
    params = X.HilbertParams(columns=("doc_id", "lang"), bits=1, target=2000)
    want = {}
    for r in X.assign_shards(docs, params).collect():
        want.setdefault(r["shard"], set()).add(r["doc_id"])
    stats = {r["shard"]: r for r in X.shard_statistics(docs, params).collect()}
    assert {k: (r["rows"], r["min_doc_id"], r["max_doc_id"]) for k, r in stats.items()} == {k: (len(v), min(v), max(v)) for k, v in want.items()}
    X.write_shards(docs, str(tmp_path / "out"), params)
    files = {int(p.name.split("-")[1]): spark.read.parquet(str(p)).collect() for p in (tmp_path / "out").glob("*.parquet")}
    assert {k: {r["doc_id"] for r in v} for k, v in files.items()} == want and max(want) > len(want)
    assert all(r["shard"] == "own" for v in files.values() for r in v)
    X.write_shards(docs.limit(0), str(tmp_path / "none"), params)
    assert spark.read.parquet(str(tmp_path / "none")).columns == docs.columns


def test_messy_rows(spark):
    docs = messy.docs(spark)
    found = X.assign_shards(docs).collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r[0]) for r in messy.rows())
    assert all(r["hilbert"] is not None and r["shard"] == 0 for r in found)
    assert X.assign_shards(messy.empty(spark)).count() == 0
