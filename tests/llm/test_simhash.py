import random

import numpy as np

from confab.llm import simhash as X
from tests.llm import messy


def brute_groups(prints, radius):
    """Least id of each fingerprint's group, by comparing all pairs."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(prints[a], prints[b])) <= radius:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def test_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    prints = {r["doc_id"]: X.fingerprint(r["text"]) for r in docs.collect()}
    want = {(i, r) for i, r in brute_groups(prints, 20).items() if i != r}
    for params in (X.SimHashParams(), X.SimHashParams(tile=7, min_blocks=5)):
        assert {tuple(r) for r in X.near_duplicates(docs, params).collect()} == want


def test_forest_finds_chains_across_tiles():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, (300, 2)).astype(np.uint64)
    chain = base[:1].copy()
    rows = [base]
    for k in range(40):
        chain = chain ^ np.array([[1 << (k % 60), 0]], np.uint64)
        rows.append(chain)
    h = np.concatenate(rows)
    labels = X.forest(h, np.zeros(len(h), int), 3, 16)
    assert (labels[300:] == 0).all() and (labels[1:300] == np.arange(1, 300)).all()
    side = np.array([0] * 300 + [1] * 40)
    across = X.forest(h, side, 3, 16)
    assert across[300] == 0 and across[310] == 310  # linked across sides only


def test_tiles_apart_in_population_are_skipped_exactly():
    h = np.zeros((200, 2), np.uint64)
    h[:100, 0] = (1 << np.arange(100, dtype=object) % 64).astype(np.uint64)
    h[100:] = np.uint64(2**64 - 1)
    labels = X.forest(h, np.zeros(200, int), 2, 8)
    assert set(labels[:100]) == {0} and set(labels[100:]) == {100}


def test_copies_and_edits_found_clean_left(spark):
    rng = random.Random(3)
    rows, want = [], set()
    for g in range(30):
        base = messy.words(rng, 150)
        rows.append((g * 10, " ".join(base)))
        for c in range(1, 4):
            copy = list(base)
            for _ in range(c * 2):
                copy[rng.randrange(150)] = messy.words(rng, 1)[0]
            rows.append((g * 10 + c, " ".join(copy)))
            want.add((g * 10 + c, g * 10))
    found = {tuple(r) for r in X.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found <= want and len(found) >= 0.95 * len(want)


def test_messy_rows(spark):
    docs = messy.docs(spark)
    found = {tuple(r) for r in X.near_duplicates(docs).collect()}
    assert found == {(2, 1), (3, 1), (8, 7)}
    kept = X.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    left = [r["doc_id"] for r in kept.collect()]
    assert not {2, 3, 8} & set(left) and left.count(1) == 2 and left.count(None) == 1 and left.count(4) == 1
    assert X.near_duplicates(messy.empty(spark)).count() == 0
    assert X.drop_near_duplicates(messy.empty(spark)).count() == 0


def test_search_by_parts_finds_what_all_pairs_find_and_compares_few():
    rng = np.random.default_rng(5)
    h = rng.integers(0, 2**64, (3000, 2), dtype=np.uint64)
    for k in range(1500):  # edits at the radius, one below and one above, spread over the bits
        flip = np.zeros(128, np.uint8)
        flip[rng.permutation(128)[: 19 + k % 3]] = 1
        h[1500 + k] = h[k] ^ np.packbits(flip).view(">u8").astype(np.uint64)
    params, labels, met = X.SimHashParams(), np.arange(len(h)), 0
    for part, subparts in enumerate(X.parts_of(params.radius)):
        for sub, bits in enumerate(subparts):
            values = X.bits_between(h, *bits)
            masks = X.masks_of(subparts, sub, 2)
            for v in np.unique(values):
                group = np.flatnonzero(values == v)
                found = X.search(h[group], np.zeros(len(group), int), part, sub, params)
                X.link(labels, group, group[found])
                lo, hi = subparts[0][0], subparts[-1][1]
                met += sum(n.sum() for *_, n in X.runs(np.sort(X.bits_between(h[group], lo, hi)), None, masks, 1 << (hi - lo)))
    want = X.forest(h, np.zeros(len(h), int), params.radius, params.tile)
    assert (labels == want).all() and (want[1500:] == np.arange(1500)).sum() >= 1000
    assert met < 0.02 * len(h) * (len(h) - 1) / 2


def test_cut_groups_and_like_fingerprints_change_nothing(spark):
    rng = np.random.default_rng(6)
    h = rng.integers(0, 2**64, (400, 2), dtype=np.uint64)
    h[200:] = h[:1] ^ (np.uint64(1) << rng.integers(0, 64, (200, 2), dtype=np.uint64))  # a family that shares most subparts
    h = np.unique(h, axis=0)
    want = X.forest(h, np.zeros(len(h), int), 20, 4096)
    prints = spark.createDataFrame([(k, *map(int, x)) for k, x in enumerate(h.view(np.int64))], "node long, h0 long, h1 long")
    for params in (X.SimHashParams(), X.SimHashParams(block=90), X.SimHashParams(dense=10**6)):
        labels = np.arange(len(h))
        edges = np.array([tuple(r) for r in X.near_edges(prints, params).collect()])
        X.link(labels, edges[:, 0], edges[:, 1])
        assert (labels == want).all()


def test_fingerprints_are_taken_once_and_texts_not_shuffled(spark, monkeypatch):
    docs = messy.docs(spark)
    with_shuffle = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    planned, write = [], X.cut_lineage
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(X, "cut_lineage", lambda df, name: (planned.append(plan(df)), write(df, name))[1])
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        kept = X.drop_near_duplicates(docs)
        assert planned and max(p.count("ArrowEvalPython") for p in planned) == 1
        assert "BroadcastHashJoin" in plan(kept) and "SortMergeJoin" not in plan(kept)
        monkeypatch.setattr(X, "MAX_BROADCAST", 0)  # beyond the bound: the same rows by a shuffle
        shuffled = X.drop_near_duplicates(docs)
        assert "SortMergeJoin" in plan(shuffled)
        assert kept.count() < docs.count() and sorted(map(str, kept.collect())) == sorted(map(str, shuffled.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_shuffle)
