import random

import numpy as np
import pytest

from confab.llm import toxicity as X
from tests.llm import messy

PARAMS = X.ToxicityParams(epochs=12)
BAD = ["vileword", "nastyword", "foulword"]


def corpus(n=500, seed=1):
    rng = random.Random(seed)
    fixed = random.Random(0)
    vocab = ["".join(fixed.choice("abcdefgh") for _ in range(fixed.randint(3, 8))) for _ in range(400)]
    texts, toxic, langs = [], [], []
    for k in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(20, 200))]
        y = k % 4 == 0
        if y:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(BAD) + rng.choice(["", "x", "ing"]))
        texts.append(" ".join(w)), toxic.append(int(y)), langs.append(["en", "fr", None][k % 3])
    return texts, toxic, langs


@pytest.fixture(scope="module")
def model():
    return X.train(*corpus(), PARAMS)


def test_held_out_accuracy(model):
    texts, toxic, _ = corpus(300, 2)
    found = X.score(texts, model) >= model.thresholds[None]
    assert (found == np.array(toxic, bool)).mean() > 0.97


def test_pooling_is_that_of_each_text_alone(model):
    texts = [None, "", "one", "!!", *corpus(40, 3)[0], "vileword " * 3000]
    together = X.score(texts, model)
    assert np.allclose(together, [X.score([t], model)[0] for t in texts], atol=1e-5)
    small = X.Scorer(model, max_words=50)  # keeps almost nothing
    assert np.allclose(together, small(texts), atol=1e-5)
    words = X.words_of(texts[5])
    emb = np.stack([model.table[X.features(w, PARAMS.buckets)].sum(0) for w in words])
    want = []
    for kernel, bias in zip(model.kernels, model.biases):
        padded = np.concatenate([emb, np.zeros((2, PARAMS.dim))])
        conv = sum(padded[k : k + len(words)] @ kernel[k] for k in range(len(kernel)))
        want.append(np.maximum(conv.max(0) + bias, 0))
    assert np.allclose(X.Scorer(model).pooled([words])[0], np.concatenate(want), atol=1e-4)


def test_whole_long_text_counts(model):
    clean = corpus(1, 9)[0][0].split()
    clean = " ".join(w for w in clean * 200 if not w.startswith(tuple(BAD)))
    tail = clean + " vileword nastywording foulword vilewordx"
    a, b = X.score([clean, tail], model)
    assert b > a and b >= model.thresholds[None]


def test_one_class_rejects_nothing():
    model = X.train(["a b", "c"], [0, 0], ["en", "en"], PARAMS)
    assert not (X.score(["a b", None], model) >= model.thresholds[None]).any()


def test_messy_rows(spark, model):
    docs = messy.docs(spark)
    found = X.classify(docs, model).collect()
    assert len(found) == docs.count()
    assert all(not r["toxic"] and r["score"] == 0 for r in found if r["doc_id"] in (4, 5, 6, 7))
    kept = X.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not r["toxic"] for r in found)
    assert X.classify(messy.empty(spark), model).count() == 0


def test_fit_with_null_labels_and_empty_tables(spark):
    kind = "doc_id long, toxic int, quality int, text string"
    for rows in ([], [(1, None, 1, "x"), (None, 1, 1, "x"), (1, 1, 0, "x"), (9, 0, 0, "x")]):
        model = X.fit(messy.docs(spark), spark.createDataFrame(rows, kind), PARAMS)
        assert X.classify(messy.docs(spark), model).count() == len(messy.rows())


def test_rows_beyond_the_first_train_and_calibrate_too(spark):
    texts, toxic, _ = corpus(4000, 5)
    params = X.ToxicityParams(sample_rows=200, workers=2)
    labels = spark.createDataFrame([(k, y) for k, y in enumerate(toxic)], "doc_id long, toxic int")
    first = {r["doc_id"] for y in (0, 1) for r in X.bounded_sample(labels.where(f"toxic = {y}"), "doc_id", 200).collect()}
    other = lambda t: t.replace("vileword", "gruffterm").replace("nastyword", "gruffterm").replace("foulword", "gruffterm")
    texts = [t if k in first else other(t) for k, t in enumerate(texts)]  # its words are in no row of the first
    docs = spark.createDataFrame([(k, t, ["en", "fr", None][k % 3]) for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = X.fit(docs, labels, params)
    fresh, truth, _ = corpus(300, 6)
    for words in (fresh, list(map(other, fresh))):
        assert ((X.score(words, model) >= model.thresholds[None]) == np.array(truth, bool)).mean() > 0.97
    scores, held = X.score(texts, model), X.is_held(texts, params)
    for lang in ("en", "fr", None):  # the thresholds are those that all rows give, each counted by itself
        want = X.ToxicityModel(**{**model.__dict__, "thresholds": {}})
        X.calibrate(want, scores, np.array(toxic), [["en", "fr", None][k % 3] for k in range(len(texts))], held)
        assert ((scores >= model.thresholds[lang]) == (scores >= want.thresholds[lang])).mean() > 0.999
