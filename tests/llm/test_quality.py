import random

import numpy as np

from confab.llm import quality as X
from tests.llm import messy

PARAMS = X.QualityParams(trees=15)


def labelled(n, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        words = messy.words(rng, rng.randint(20, 150))
        good = k % 3 > 0
        if not good:
            words = [w + "###" for w in words] if k % 2 else [x for w in words for x in (w, "|")]
        rows.append((k, " ".join(words), int(good)))
    return rows


def test_held_out_accuracy(spark):
    kind = "doc_id long, text string, quality int"
    rows, other = spark.createDataFrame(labelled(600, 1), kind), spark.createDataFrame(labelled(300, 2), kind)
    model = X.fit(rows.select("doc_id", "text"), rows.select("doc_id", "quality"), PARAMS)
    assert 0 < len(model.rules) < 60
    found = X.classify(other, model).join(other.select("doc_id", "quality"), "doc_id").collect()
    assert sum(r["keep"] == bool(r["quality"]) for r in found) >= 0.97 * len(found)
    values = X.with_statistics(other, ["doc_id"]).toPandas()  # the compiled column equals the rules
    for r in found[:50]:
        row = values[values.doc_id == r["doc_id"]].iloc[0]
        total = model.bias + sum(w for w, c in model.rules if all((row[f"stat_{n}"] > b) == above for n, above, b in c))
        assert abs(r["score"] - 1 / (1 + np.exp(-total))) < 1e-9


def test_lasso_is_optimal_and_sparse():
    rng = np.random.default_rng(0)
    r = (rng.random((400, 30)) < 0.4).astype(float)
    y = (r[:, 0] + r[:, 1] + rng.normal(0, 0.2, 400) > 1).astype(float)
    w, b = X.lasso_logistic(r, y, np.ones(400), 0.02, 5000)
    g = r.T @ (1 / (1 + np.exp(-(r @ w + b))) - y) / 400
    assert np.abs(g[w == 0]).max() <= 0.0201 and np.abs(g[w != 0] + 0.02 * np.sign(w[w != 0])).max() < 1e-3
    assert (w != 0).sum() < 12


def test_statistics(spark):
    frame = spark.createDataFrame([("Ab cd!\ncd 12 | #",), ("",), (None,)], "text string")
    a, b, c = X.with_statistics(frame, []).collect()
    assert (a["stat_chars"], a["stat_words"], a["stat_line_words"]) == (16, 6, 3)
    assert abs(a["stat_digits"] - 2 / 16) < 1e-12 and abs(a["stat_distinct_words"] - 1) < 1e-12
    assert tuple(b) == tuple(c) and not any(b)


def test_messy_rows(spark):
    docs = messy.docs(spark)
    one = X.classify(docs, X.fit(docs, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, text int"), PARAMS)).collect()
    assert len(one) == docs.count() and all(r["keep"] for r in one)
    labels = spark.createDataFrame([(k, k % 2) for k in range(14)], "doc_id long, quality int")
    found = X.classify(docs, X.fit(docs, labels, PARAMS)).collect()
    assert len(found) == docs.count() and not any(r["score"] is None for r in found)
    assert X.classify(messy.empty(spark), X.fit(messy.empty(spark), labels, PARAMS)).count() == 0
