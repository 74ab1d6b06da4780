import random
from collections import Counter

import numpy as np
import pytest

from confab.llm import substrings as X
from tests.llm import messy


def brute(docs, least):
    """Spans by looking every window of every length up in a table."""
    docs = {(i, t) for i, t in docs if i is not None and t is not None}
    split = {d: d[1].split() for d in docs}
    hot = {}
    length = least
    while True:
        seen = Counter(tuple(w[p : p + length]) for w in split.values() for p in range(len(w) - length + 1))
        some = {d: [p for p in range(len(w) - length + 1) if seen[tuple(w[p : p + length])] > 1] for d, w in split.items()}
        if not any(some.values()):
            break
        hot[length] = some
        length *= 2
    out = []
    for d in docs:
        spans = []
        for p in hot.get(least, {}).get(d, []):
            if spans and p <= spans[-1][1]:
                spans[-1][1] = p + least
            else:
                spans.append([p, p + least])
        for a, b in spans:
            out.append((d[0], a, b, max(n for n, s in hot.items() if any(a <= p < b for p in s[d]))))
    return sorted(out)


def planted(seed):
    rng = random.Random(seed)
    passages = [messy.words(rng, n) for n in (20, 49, 50, 51, 90, 130, 400)]
    docs = []
    for d in range(50):
        text = messy.words(rng, rng.randint(0, 120))
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            at = rng.randint(0, len(text))
            text[at:at] = p
        docs.append((d, " ".join(text)))
    docs += [(60 + k, docs[k][1]) for k in range(5)]
    docs.append((70, " ".join(["same"] * 300)))
    docs.append((71, " ".join(messy.words(rng, 30) * 8)))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    docs = planted(seed)
    found = sorted(tuple(r) for r in X.repeated_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert found == brute(docs, 50)


def test_other_least_length(spark):
    docs = planted(3)[:25]
    found = sorted(tuple(r) for r in X.repeated_spans(spark.createDataFrame(docs, "doc_id long, text string"), X.SubstringParams(min_words=20)).collect())
    assert found == brute(docs, 20)


@pytest.mark.parametrize("least, block", [(21, 1 << 20), (50, 40), (2, 100)])
def test_odd_lengths_and_small_blocks(spark, least, block):
    docs = planted(4)[:30] if least > 2 else [(k, " ".join(messy.words(random.Random(k % 3), 9))) for k in range(6)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in X.repeated_spans(frame, X.SubstringParams(least, block)).collect()) == brute(docs, least)


def test_length_below_two_is_an_error(spark):
    with pytest.raises(ValueError):
        X.repeated_spans(messy.docs(spark), X.SubstringParams(min_words=1))


def test_kinds():
    h, g = np.array([5, 1, 5, 7, 5, 1], np.uint64), np.array([0, 1, 0, 0, 0, 2], np.uint32)
    assert X.kinds(h).tolist() == [1, 1, 2, 0, 2, 2] and X.kinds(h, g).tolist() == [1, 0, 2, 0, 2, 0] and X.kinds(h[:0]).tolist() == []


def test_passage_of_most_documents_is_shuffled_once_a_task(spark):
    rng = random.Random(8)
    passage = messy.words(rng, 60)
    docs = [(k, " ".join([*messy.words(rng, 29), f"a{k}", *(passage if k % 10 else []), f"b{k}", *messy.words(rng, 29)])) for k in range(2000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    own = frame.select("doc_id", X.F.xxhash64("text").alias("t0"), X.F.lit(0).cast("long").alias("t1"), "text")
    found = own.mapInArrow(X._first_pass(X.SubstringParams()), "doc_id long, t0 long, t1 long, words int, at array<int>, h array<long>, kind array<tinyint>")
    rows = found.select(X.F.explode(X.F.arrays_zip("h", "kind")).alias("a")).select("a.h", "a.kind")
    assert rows.groupBy("h").count().agg(X.F.max("count")).first()[0] == 1800
    assert rows.where("kind < 2").groupBy("h").count().agg(X.F.max("count")).first()[0] <= 4
    assert {tuple(r)[:3] for r in X.repeated_spans(frame).collect()} == {(k, 30, 90) for k in range(2000) if k % 10}


def test_window_hashes_depend_on_the_words_alone():
    rng = np.random.default_rng(0)
    w = rng.integers(0, 2**63, 100).astype(np.uint64)
    whole = X.window_hashes(w, 25)
    assert len(whole) == 76 and X.window_hashes(w[40:70], 25)[3] == whole[43]
    assert len(X.window_hashes(w[:10], 25)) == 0
    assert (X.minima(whole, 26) == [k + whole[k : k + 26].argmin() for k in range(51)]).all()


def test_messy_rows(spark):
    docs = messy.docs(spark)
    found = sorted(tuple(r) for r in X.repeated_spans(docs).collect())
    assert found == brute([(r[0], r[1]) for r in messy.rows()], 50)
    assert {r[0] for r in found} == {1, 2, 3}
    assert X.repeated_spans(messy.empty(spark)).count() == 0
