import duckdb
import numpy as np

from confab.llm import pivots as X

KIND = "vec_id long, embedding array<float>, pivot int, unit string, a int"


def clustered(n, seed=0, dim=32):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 6, dim))
    v = np.concatenate([centres[rng.integers(0, len(centres), n - 30)] + rng.normal(size=(n - 30, dim)) * rng.uniform(0.05, 0.4, (n - 30, 1)), rng.normal(size=(30, dim))])
    return v.astype(np.float32)


def brute(v, threshold):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(u @ u.T >= threshold, 1))
    return set(zip(i.tolist(), j.tolist()))


def test_recall_and_precision_against_brute_force(spark):
    v = clustered(1500)
    frame = spark.createDataFrame([(k, x.tolist(), 1, "", 2) for k, x in enumerate(v)], KIND)
    want = brute(v, 0.95)
    found = [(r["vec_a"], r["vec_b"]) for r in X.near_pairs(frame).collect()]
    assert len(found) == len(set(found)) and set(found) <= brute(v, 0.9499)
    assert len(set(found) & want) >= 0.95 * len(want) > 500


def test_cutting_lists_changes_nothing(spark):
    v = clustered(400, 1)
    frame = spark.createDataFrame([(k, x.tolist(), 1, "", 2) for k, x in enumerate(v)], KIND)
    whole = set(map(tuple, X.near_pairs(frame).collect()))
    assert whole and set(map(tuple, X.near_pairs(frame, X.PivotParams(block=13)).collect())) == whole


def test_vectors_of_every_length_are_searched(spark):
    long, short = clustered(400, 2), clustered(200, 3, 8)
    rows = [(k, x.tolist(), 1, "", 2) for k, x in enumerate([*long, *short])]
    found = {(r["vec_a"], r["vec_b"]) for r in X.near_pairs(spark.createDataFrame([*rows, (900, [1.0, 2.0], 1, "", 2)], KIND)).collect()}
    for want in (brute(long, 0.95), {(a + 400, b + 400) for a, b in brute(short, 0.95)}):
        assert len(found & want) >= 0.95 * len(want) > 50
    assert found <= brute(long, 0.9499) | {(a + 400, b + 400) for a, b in brute(short, 0.9499)}


def test_messy_rows(spark):
    a, b = [1.0, 2.0, 3.0], [3.0, -1.0, 0.0]
    rows = [(1, a), (2, a), (2, a), (3, b), (None, a), (4, None), (5, []), (6, [0.0, 0.0, 0.0]), (7, [1.0, None, 2.0]), (8, [float("nan"), 1.0, 1.0]), (9, [1.0, 2.0]), (10, [2.0, 4.0, 6.0]), (11, [float("inf"), 0.0, 0.0])]
    frame = spark.createDataFrame([(i, v, 0, "", 0) for i, v in rows], KIND)
    assert {tuple(r) for r in X.near_pairs(frame).collect()} == {(1, 2, 1.0), (1, 10, 1.0), (2, 10, 1.0)}
    assert X.near_pairs(spark.createDataFrame([], KIND)).collect() == []


def classes(frame, params=X.PivotParams()):
    return sorted(tuple(r) for r in X.near_classes(frame, params).collect())


def test_query_equals_its_sql(spark, tmp_path):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(60, 32)).repeat(4, axis=0)
    v[::2] += rng.normal(size=(120, 32)) * 0.02
    rows = [(k, x.tolist(), 1, "", 2) for k, x in enumerate(v)]
    spark.createDataFrame(rows + rows[:9], KIND).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = sorted(con.sql(X.ORACLES["op1_pivot_near_dedup"]).fetchall())
    found = X.op1_pivot_near_dedup(spark, str(tmp_path))
    assert found.columns == ["vec_id", "class_id", "links"] and sorted(map(tuple, found.collect())) == want
    assert want == [(k, k // 4 * 4, 3) for k in range(240)]


def test_a_row_a_document_however_many_are_alike(spark):
    v = clustered(300, 4)
    v = np.concatenate([v, np.repeat(v[:3], 200, axis=0)])
    frame = spark.createDataFrame([(k, x.tolist(), 1, "", 2) for k, x in enumerate(v)], KIND)
    near = brute(v, 0.95)
    links, root = np.zeros(len(v), int), list(range(len(v)))
    for _ in range(len(v)):
        before = list(root)
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    for a, b in near:
        links[a] += 1
        links[b] += 1
    want = [(k, root[k], int(links[k])) for k in range(len(v))]
    assert len(near) > 50_000
    assert classes(frame, X.PivotParams(block=50, prefix=12, shared=2)) == want  # no pair is lost by so wide prefixes


def test_messy_classes(spark):
    a, b = [1.0, 2.0, 3.0], [3.0, -1.0, 0.0]
    rows = [(1, a), (2, a), (2, a), (2, b), (3, b), (None, a), (4, None), (5, []), (6, [0.0, 0.0, 0.0]), (7, [1.0, None, 2.0]), (8, [float("nan"), 1.0, 1.0]), (9, [1.0, 2.0]), (10, [2.0, 4.0, 6.0]), (11, [float("inf"), 0.0, 0.0])]
    frame = spark.createDataFrame([(i, v, 0, "", 0) for i, v in rows], KIND)
    alone = [(k, k, 0) for k in (4, 5, 6, 7, 8, 9, 11)]
    assert classes(frame) == sorted([(1, 1, 2), (2, 1, 2), (2, 2, 1), (3, 2, 1), (10, 1, 2), *alone])
    assert classes(spark.createDataFrame([], KIND)) == []
