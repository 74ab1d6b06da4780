import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from confab.llm import secrets as X
from tests.llm import messy


def prose(n, seed):
    rng = random.Random(seed)
    return [" ".join(messy.words(rng, rng.randint(20, 150))) for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    return X.train(prose(150, 1), X.SecretParams(generated=900, epochs=6))


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(0)
    for _ in range(30):
        n = rng.integers(1, 6)
        emit, trans = rng.normal(size=(n, 3)), rng.normal(size=(3, 3))
        score = lambda p: sum(emit[i, y] for i, y in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:]))
        best = max(itertools.product(range(3), repeat=int(n)), key=score)
        assert abs(score(X.viterbi(emit, trans)) - score(best)) < 1e-9


def test_marginals_equal_all_paths():
    rng = np.random.default_rng(4)
    emit, trans = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3))
    node, edge = X._marginals(emit, trans, np.ones((1, 4), bool))
    paths = list(itertools.product(range(3), repeat=4))
    w = np.exp([sum(emit[0, i, y] for i, y in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:])) for p in paths])
    w /= w.sum()
    for i, y in itertools.product(range(4), range(3)):
        assert abs(node[0, i, y] - sum(q for p, q in zip(paths, w) if p[i] == y)) < 1e-9
    for a, b in itertools.product(range(3), range(3)):
        assert abs(edge[a, b] - sum(q * sum((s, t) == (a, b) for s, t in zip(p, p[1:])) for p, q in zip(paths, w))) < 1e-9


def test_the_bound_never_changes_the_labels(model):
    rng = random.Random(6)
    docs = [t.split() for t in prose(40, 5)]
    for d in docs[::2]:
        d[5:5] = [t.strip("\0\1") for t in rng.choice([X._make_secret, X._make_decoy])(rng)]
    tagger = X.Tagger(model, max_tokens=30)
    for d, labels in zip(docs, tagger.labels(docs)):
        emit, _ = X.Tagger(model).emissions([d])
        path = X.viterbi(emit[: len(d)], model.trans)
        assert labels == (path if any(y != X.OUTSIDE for y in path) else None)


def test_held_out_accuracy(model):
    rng = random.Random(77)
    caught = clean = 0
    texts = prose(200, 9)
    tagger = X.Tagger(model)
    for text in texts:
        value = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        words = text.split()
        words[len(words) // 2 : len(words) // 2] = ["token", "=", f'"{value}"']
        joined = " ".join(words)
        a = joined.index(value)
        caught += tagger.spans([joined]) == [[(a, a + 40)]]
        clean += tagger.spans([text + " mail12@x.example.com 10.2.3.4 4929000011112222"]) == [[]]
    assert caught >= 190 and clean >= 190


def test_redaction_and_multi_token_spans():
    text = 'say token = "abc" and KEY\n--BEGIN x y--'
    assert X.redact(text, [(13, 16)]) == 'say token = "<SECRET>" and KEY\n--BEGIN x y--'
    assert X._to_spans("a bb cc d", [2, 0, 1, 2]) == [(2, 7)]
    assert X._to_spans("a bb cc d", [2, 0, 0, 2]) == [(2, 4), (5, 7)]
    assert X.redact(None, []) is None


def test_messy_rows(spark, model):
    docs = messy.docs(spark)
    assert X.scan(docs, model).columns == ["doc_id", "start", "end"]
    masked = X.mask_secrets(docs, model)
    assert masked.columns == docs.columns and masked.count() == docs.count()
    for r in masked.collect():
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))
    kind = "doc_id long, text string, start int, span string"
    value = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"
    some = spark.createDataFrame([(None, f'x token = "{value}" y', 1, ""), (2, " ".join(["word"] * 50_000) + f' token = "{value}"', 1, "")], kind)
    found = {r["doc_id"]: (r["start"], r["end"]) for r in X.scan(some, model).collect()}
    assert found == {None: (11, 51), 2: (250_009, 250_049)}
    assert X.scan(messy.empty(spark), model).count() == 0
    small = X.SecretParams(generated=50, epochs=1)
    assert X.scan(docs, X.fit(messy.empty(spark), small)).columns == ["doc_id", "start", "end"]


def test_masked_texts_leave_a_worker_in_pieces(spark, model):
    texts = [None, "", *prose(4, 9), "password = hunter2hunter2hunter2 " * 30_000, *["plain words here " * 20_000] * 6]
    batch = pa.array(texts, pa.string())
    parts = list(X.masked_parts(batch, X.Tagger(model)))
    tagger = X.Tagger(model)
    want = [X.redact(t, s) for t, s in zip(texts, tagger.spans(texts))]
    assert [t for p in parts for t in p.to_pylist()] == want and want[6] != texts[6]
    assert len(parts) > 2 and max(p.nbytes for p in parts) < batch.nbytes / 2
    assert len(list(X.masked_parts(batch[:0], tagger))) == 1
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    assert {r["doc_id"]: r["text"] for r in X.mask_secrets(rows, model).collect()} == dict(enumerate(want))
