import random

import numpy as np

from confab.llm import decontaminate as X
from tests.llm import messy

P = X.AlignParams()


def brute_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s = P.match if a[i - 1] == b[j - 1] else P.mismatch
            h[i, j] = max(0, h[i - 1, j - 1] + s, h[i - 1, j] + P.gap, h[i, j - 1] + P.gap)
    return h.max()


def test_alignment_equals_the_full_table():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(1, 20)), rng.integers(0, 4, rng.integers(1, 40))
        assert X.align(a, b) == brute_align(a, b)
    assert X.align(np.array([]), np.array([1])) == 0


def planted(seed=2):
    rng = random.Random(seed)
    items = [(k, " ".join(messy.words(rng, rng.randint(15, 50)))) for k in range(12)]
    docs, edits = [], {}
    for d in range(60):
        text = messy.words(rng, rng.randint(50, 300))
        if d % 3 == 0:
            k = d % 12
            leak = items[k][1].split()
            for i in range(0, len(leak), 8):  # every eighth word replaced
                if d % 2:
                    leak[i] = "other"
            at = rng.randrange(len(text))
            text[at:at] = leak
            edits[d, k] = True
        docs.append((d, " ".join(text)))
    return docs, items, edits


def test_equals_brute_force(spark):
    docs, items, edits = planted()
    want = set()
    for d, text in docs:
        for k, item in items:
            a, b = X.words_of(item), X.words_of(text)
            vocab = {w: i for i, w in enumerate(dict.fromkeys(a + b))}
            if X.align(np.array([vocab[w] for w in a]), np.array([vocab[w] for w in b])) >= P.threshold * P.match * len(a):
                want.add((d, k))
    assert want == set(edits)
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for params in (P, X.AlignParams(items_per_pass=100)):  # one pass, and several
        assert {(r["doc_id"], r["item_id"]) for r in X.contaminated(*frames, params).collect()} == want
        kept = {r["doc_id"] for r in X.drop_contaminated(*frames, params).collect()}
        assert kept == {d for d, _ in docs} - {d for d, _ in want}


def test_common_words_are_no_seeds():
    items = X.Items([(1, "a b c d e f g h i j k l m n o p")], P)
    items.choose_seeds({g: 1000 if g < 4 else 3 for g in range(len(items.grams))}, 1000)
    assert not {0, 1, 2, 3} & items.seeds[0] and len(items.seeds[0]) == 9
    items.choose_seeds({g: 1000 for g in range(2, len(items.grams))}, 1000)
    assert len(items.seeds[0]) == 6  # the rarer half of those that occur always stays


def test_an_item_that_leaks_often_has_seeds_everywhere(spark):
    rng = random.Random(4)
    item = messy.words(rng, 40)
    damaged = [w if i % 3 else "other" for i, w in enumerate(item)]  # no n-gram is left
    copies = [item] * 60 + [damaged[:20] + item[20:]] * 70 + [item[:20] + damaged[20:]] * 5
    docs = [(d, " ".join(messy.words(rng, 20) + (copies[d] if d < len(copies) else []) + messy.words(rng, 20))) for d in range(400)]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert {r["doc_id"] for r in X.contaminated(*frames).collect()} == set(range(len(copies)))
    items = X.Items([(1, " ".join(item))], P)
    items.choose_seeds({g: 900 + g for g in range(len(items.grams))}, 1000)
    places = sorted(at for g in items.seeds[0] for _, at in items.where[g])
    assert len(places) == 19 and max(b - a for a, b in zip([-1, *places], [*places, 37])) <= 2  # any five words in a row hold a seed


def test_messy_rows(spark):
    docs = messy.docs(spark)
    base = messy.rows()[0][1]
    kind = "item_id long, text string, score double, doc_id long"
    items = [(1, " ".join(base.split()[20:60]), 0.0, 5), (2, None, 0.0, 5), (3, "", 0.0, 5), (None, base, 0.0, 5), (4, "one", 0.0, 5), (1, " ".join(base.split()[20:60]), 0.0, 5)]
    bench = spark.createDataFrame(items, kind)
    found = {(r["doc_id"], r["item_id"]) for r in X.contaminated(docs, bench).collect()}
    assert found == {(1, 1), (2, 1), (3, 1), (9, 4), (11, 4)}  # the long text of 9 holds the word too
    kept = X.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 0
    none = spark.createDataFrame([], kind)
    assert X.contaminated(docs, none).count() == 0 and X.drop_contaminated(docs, none).count() == docs.count()
    assert X.contaminated(messy.empty(spark), bench).count() == 0


def test_very_long_text(spark):
    rng = random.Random(8)
    item = " ".join(messy.words(rng, 20))
    text = " ".join([*messy.words(rng, 40_000), item, *messy.words(rng, 10)])
    found = X.contaminated(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert [r["score"] for r in found.collect()] == [1.0]
