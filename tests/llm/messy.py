"""Documents with nulls, empty and very long texts, ties, repeated rows and clashing columns."""

import random

KIND = "doc_id long, text string, lang string, source string, n_chars long, score double, node long, h0 long, at int, tid long, toxic boolean, hilbert int, shard int, _id long, stat_chars double, ids string"


def words(rng, n, alphabet="abcdefghijklmnop"):
    return [" ".join(["".join(rng.choice(alphabet) for _ in range(rng.randint(2, 7)))]) for _ in range(n)]


def rows():
    rng = random.Random(5)
    base = " ".join(words(rng, 120))
    near = base.split()
    near[30] = "changed"
    long = " ".join(words(rng, 30_000))
    texts = [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, "   \n "), (7, "!!! ???"), (8, "!!! ???"), (9, long),
        (10, " ".join(words(rng, 200))), (10, " ".join(words(rng, 200))), (11, "one"), (None, base), (12, " ".join(words(rng, 80))), (12, None), (13, "\x00 ퟿ nul é 漢字 🙂"),
    ]
    out = [(i, t, None if k % 3 == 0 else "en", "src", None if t is None else len(t), 0.5, 1, 2, 3, 4, True, 5, 6, 7, 8.0, "x") for k, (i, t) in enumerate(texts)]
    return [*out, out[0], out[9]]


def docs(spark):
    return spark.createDataFrame(rows(), KIND)


def empty(spark):
    return spark.createDataFrame([], KIND)
