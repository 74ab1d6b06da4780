"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word's embedding is the sum of hashed rows for the word and for its opening
letters, so that unseen inflections of a known stem still score. Filters of
several widths slide over the words, each filter keeps its maximum over the text
and a logistic unit scores the maxima. The network is trained in numpy on whole texts of
all labelled rows. It starts on the driver with a bounded number of them, for as many steps
at every size; where there are more, all then train it further in a pass over the corpus, on
``workers`` tasks whose weights are averaged, each row of the table over those that met it.
Its threshold is calibrated for each language on held-out rows: the language's own, and
those of all languages with a small weight in sum, which decide where the own are few.
Beyond the first rows scores are counted in fine steps for that, with the least and the
greatest score of a step. Scoring is one map over the corpus: no shuffle, and whole texts.
The labels are broadcast to the documents up to ``MAX_BROADCAST`` of them, else joined.

Edge cases: a null or wordless text scores 0 and is never toxic; very long texts are
read whole; a score equal to the threshold is toxic; a null or unknown language uses the
threshold of all languages; repeated rows score alike; labels that contradict each other
all train; without both classes among the labels no document is toxic; an empty table
gives no rows; columns of the input other than the named ones are neither read nor needed.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from confab.llm.texts import blocks, bounded_sample, text_blocks
from confab.plans.lineage import cut_lineage
from confab.sources.tables import table

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (3, 4, 5, 6)
MAX_WINDOWS = 1 << 16  # convolved at once in training
MAX_BROADCAST = 2_000_000  # labels
STEPS = 64  # in which scores are counted, a unit of their log odds


@dataclass(frozen=True)
class ToxicityParams:
    """``sample_rows`` bounds the labelled rows of either class that training starts with; the others follow."""

    sample_rows: int = 4000
    buckets: int = 1 << 15
    dim: int = 12
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    epochs: int = 10  # over a full sample: a smaller one is gone over in as many steps
    batch: int = 64
    rate: float = 0.05
    hold_out: float = 0.25
    min_docs: int = 5  # a hashed row held by fewer training texts stays at zero, lest texts be learnt by heart
    prior: float = 15.0  # weight, in toxic rows, of all languages' held-out rows in a language's threshold
    seen: float = 0.01  # weight of a training row in the thresholds, which decides only what held-out rows leave open
    seed: int = 7
    workers: int = 16  # tasks that train on all labelled rows


@dataclass
class ToxicityModel:
    """Weights in float32; ``thresholds`` by language, with ``None`` for all others."""

    params: ToxicityParams
    table: np.ndarray
    kernels: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    thresholds: dict[str | None, float] = field(default_factory=dict)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def features(word: str, buckets: int) -> list[int]:
    """Table rows of a word: itself, and its openings of some lengths; row 0 is padding."""
    parts = ["=" + word, *(word[:k] + "*" for k in PREFIXES)]
    return [1 + xxhash.xxh32_intdigest(p) % (buckets - 1) for p in parts]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _windows(words: np.ndarray, width: int) -> np.ndarray:
    """The distinct runs of ``width`` words, a column each: a maximum over a text needs no others."""
    runs = np.lib.stride_tricks.sliding_window_view(words, width)
    key, size = runs[:, 0], int(words.max()) + 1
    for k in range(1, width):
        key = np.unique(key, return_inverse=True)[1] * size + runs[:, k]
    return runs[np.unique(key, return_index=True)[1]].T.astype(np.int32)


def _sum_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, in order, and the sum of the rows of each."""
    order = np.argsort(keys, kind="stable")
    found, first = np.unique(keys[order], return_index=True)
    return found, np.add.reduceat(values[order], first, axis=0)


def is_held(texts: list[str | None], params: ToxicityParams) -> np.ndarray:
    """Texts that are held out of training."""
    return np.array([xxhash.xxh32_intdigest(t or "") % 1000 < params.hold_out * 1000 for t in texts], bool)


def _words(texts: list[str], params: ToxicityParams) -> tuple[np.ndarray, list[np.ndarray]]:
    """Table rows of each word met, word 0 being padding, and the words of each text."""
    pad = max(params.widths) - 1
    known: dict[str, int] = {}
    rows: list[list[int]] = [[0] * (len(PREFIXES) + 1)]
    docs = []
    for text in texts:
        ids = []
        for word in words_of(text):
            k = known.get(word)
            if k is None:
                k = known[word] = len(rows)
                rows.append(features(word, params.buckets))
            ids.append(k)
        docs.append(np.array((ids or [0]) + [0] * pad, np.int32))
    return np.array(rows, np.int32), docs


def _supported(feats: np.ndarray, docs: list[np.ndarray], support: np.ndarray, params: ToxicityParams) -> tuple[np.ndarray, list[np.ndarray]]:
    """Table rows of the words that have one with enough support, and the windows of each text over them."""
    feats = np.where(support[feats] < params.min_docs, 0, feats)
    number = np.zeros(len(feats), np.int64)  # of the words with a row; the others are padding
    number[feats.any(1)] = np.arange(1, feats.any(1).sum() + 1)
    feats = np.concatenate([np.zeros((1, feats.shape[1]), np.int32), feats[number > 0]])
    return feats, [_windows(number[d], max(params.widths)) for d in docs]


def _count(feats: np.ndarray, docs: list[np.ndarray], support: np.ndarray) -> None:
    met = np.zeros(len(support), bool)
    for doc in docs:
        met[:] = False
        met[feats[doc]] = True
        support += met


class Trainer:
    """Adagrad on the cross entropy, a batch of texts a step; ``hits`` counts the steps of each row of the table."""

    def __init__(self, model: ToxicityModel, weight: dict[float, float]):
        self.model, self.weight = model, weight
        self.slots = [np.full_like(x, 1e-6) for x in (*model.kernels, *model.biases, model.out)]
        self.table = np.full(model.params.buckets, 1e-6, np.float32)
        self.hits, self.steps = np.zeros(model.params.buckets, np.int64), 0

    def step(self, feats: np.ndarray, windows: list[np.ndarray], y: np.ndarray) -> None:
        model, params, slots, weight = self.model, self.model.params, self.slots, self.weight
        width, nf, pad, some = feats.shape[1], params.filters, max(params.widths) - 1, windows
        uniq = np.unique(np.concatenate([d.ravel() for d in some]))
        number = np.zeros(len(feats), np.int64)
        number[uniq] = np.arange(len(uniq))
        of_word = feats[uniq]
        emb = sum(model.table[of_word[:, k]] for k in range(width))
        taps = np.zeros((pad + 1, len(model.kernels), nf, len(uniq)), np.float32)
        for j, kernel in enumerate(model.kernels):
            taps[: len(kernel), j] = (emb @ kernel).transpose(0, 2, 1)
        taps = taps.reshape(pad + 1, -1, len(uniq))
        top = np.empty((len(some), taps.shape[1]), np.float32)
        best = np.empty((pad + 1, len(some), taps.shape[1]), np.int64)  # words under each filter's maximum
        ends = np.cumsum([d.shape[1] for d in some])
        first = 0
        while first < len(some):  # about MAX_WINDOWS at once, one text at least
            start = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, start + MAX_WINDOWS, side="right")))
            own = number[np.concatenate(some[first:last], 1)]
            conv = sum(np.take(taps[k], own[k], 1) for k in range(pad + 1))
            for i in range(first, last):
                lo, hi = (ends[i - 1] if i else 0) - start, ends[i] - start
                a = conv[:, lo:hi].argmax(1)
                top[i] = conv[np.arange(len(conv)), lo + a]
                best[:, i] = own[:, lo + a]
            first = last
        top, best = top.reshape(len(some), -1, nf), best.reshape(pad + 1, len(some), -1, nf)
        pooled = [np.maximum(top[:, j] + bias, 0) for j, bias in enumerate(model.biases)]
        hidden = np.concatenate(pooled, 1)
        p = _sigmoid(hidden @ model.out + model.out_bias)
        delta = (p - y) * np.where(y > 0, weight[1.0], weight[0.0]) / len(some)
        g_hidden = np.outer(delta, model.out) * (hidden > 0)
        g_kernels, g_biases, words, at_words = [], [], [], []
        for j, (kernel, w) in enumerate(zip(model.kernels, params.widths)):
            g = g_hidden[:, j * nf : (j + 1) * nf]
            g_biases.append(g.sum(0))
            for k in range(w):
                words.append(best[k, :, j].ravel())
                at_words.append((g[:, :, None] * kernel[k].T[None]).reshape(-1, params.dim))
            g_kernels.append(np.stack([np.einsum("bfd,bf->df", emb[best[k, :, j]], g) for k in range(w)]))
        g_out = hidden.T @ delta
        for x, g, slot in zip((*model.kernels, *model.biases, model.out), (*g_kernels, *g_biases, g_out), slots):
            slot += g * g
            x -= params.rate * g / np.sqrt(slot)
        model.out_bias -= params.rate * float(delta.sum())
        touched, g_words = _sum_by(np.concatenate(words), np.concatenate(at_words))
        rows_hit, summed = _sum_by(of_word[touched].ravel(), np.repeat(g_words, width, 0))
        summed[rows_hit == 0] = 0  # row 0 is padding and stays zero
        self.table[rows_hit] += (summed * summed).mean(1)
        model.table[rows_hit] -= params.rate * summed / np.sqrt(self.table[rows_hit])[:, None]
        self.hits[rows_hit] += 1
        self.steps += 1


def train(texts: list[str], toxic: list[int], langs: list[str | None], params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Fit by Adagrad on the cross entropy, then calibrate thresholds on held-out rows."""
    return start(texts, toxic, langs, params).model


def start(texts: list[str], toxic: list[int], langs: list[str | None], params: ToxicityParams) -> Trainer:
    """The same with what further training needs."""
    rng = np.random.default_rng(params.seed)
    nf = params.filters
    model = ToxicityModel(
        params,
        rng.normal(0, 0.1, (params.buckets, params.dim)).astype(np.float32),
        [rng.normal(0, 0.3, (w, params.dim, nf)).astype(np.float32) for w in params.widths],
        [np.zeros(nf, np.float32) for _ in params.widths],
        rng.normal(0, 0.3, nf * len(params.widths)).astype(np.float32),
        0.0,
        {None: 1.1},
    )
    model.table[0] = 0
    if len(set(toxic)) < 2:
        return Trainer(model, {})
    feats, docs = _words(texts, params)
    y, held = np.array(toxic, np.float32), is_held(texts, params)
    order = np.flatnonzero(~held) if not held.all() else np.arange(len(texts))
    support = np.zeros(params.buckets, np.int64)
    _count(feats, [docs[k] for k in {texts[k]: k for k in order}.values()], support)  # copies count once
    model.table[support < params.min_docs] = 0
    feats, windows = _supported(feats, docs, support, params)
    trainer = Trainer(model, {c: 0.5 * len(order) / max(1, (y[order] == c).sum()) for c in (0.0, 1.0)})
    at = len(order)
    for _ in range(int(params.epochs * 2 * params.sample_rows * (1 - params.hold_out)) // params.batch):
        if at >= len(order):
            rng.shuffle(order)
            at = 0
        some = order[at : at + params.batch]
        at += params.batch
        trainer.step(feats, [windows[k] for k in some], y[some])
    calibrate(model, score(texts, model), y, langs, held)
    return trainer


def calibrate(model: ToxicityModel, scores: np.ndarray, truth: np.ndarray, langs: list[str | None], held: np.ndarray, count: np.ndarray | float = 1.0, tops: np.ndarray | None = None) -> None:
    """Set the thresholds: of all languages, and of each language by weighted rows of its own and of all."""
    params = model.params
    base = np.where(held, 1.0, params.seen) * count
    model.thresholds[None] = _threshold(scores, truth, base, tops)
    others = base * min(1.0, params.prior / (base * truth).sum())
    names = np.array([x or "" for x in langs])
    for lang in sorted({x for x in langs if x is not None}):
        model.thresholds[lang] = _threshold(scores, truth, np.where(names == lang, base, others), tops)


def _threshold(scores: np.ndarray, truth: np.ndarray, weight: np.ndarray | None = None, tops: np.ndarray | None = None) -> float:
    """Middle of the widest gap among the cuts with the best weighted F1; a row may stand for scores up to its top."""
    order = np.argsort(-scores, kind="stable")
    s, t = scores[order], truth[order]
    w = np.ones(len(s)) if weight is None else weight[order]
    f1 = 2 * np.cumsum(w * t) / (np.cumsum(w) + (w * t).sum())
    below = np.append((scores if tops is None else tops)[order][1:], 0.0)
    f1[s == np.append(s[1:], 0.0)] = -1
    best = np.flatnonzero(f1 >= f1.max() - 1e-9)
    k = best[np.argmax(s[best] - below[best])]
    return float((s[k] + below[k]) / 2)


class Scorer:
    """Scores texts; the projections of words already met are kept, for a bounded number of words."""

    def __init__(self, model: ToxicityModel, max_words: int = 200_000):
        self.model, self.max_words = model, max_words
        self.flat = np.concatenate([k for kernel in model.kernels for k in kernel], 1)  # dim x (taps * filters)
        self.known: dict[str, int] = {}
        self.rows = np.zeros((max_words + 1, self.flat.shape[1]), np.float32)  # row 0 is padding

    def _ids(self, words: list[str]) -> list[int]:
        known, fresh = self.known, []
        for w in dict.fromkeys(words):
            if w not in known:
                fresh.append(w)
        if fresh:
            if len(known) + len(fresh) > self.max_words:
                known.clear()
                fresh = list(dict.fromkeys(words))
                if len(fresh) > self.max_words:
                    self.max_words = len(fresh)
                    self.rows = np.zeros((self.max_words + 1, self.flat.shape[1]), np.float32)
            base = len(known) + 1
            ids = np.array([features(w, self.model.params.buckets) for w in fresh], np.int32)
            self.rows[base : base + len(fresh)] = self.model.table[ids].sum(1) @ self.flat
            known.update(zip(fresh, range(base, base + len(fresh))))
        return [known[w] for w in words]

    def pooled(self, docs: list[list[str]]) -> np.ndarray:
        """Maxima of every filter for each text; texts without words give zeros."""
        m, nf = self.model, self.model.params.filters
        pad = max(m.params.widths) - 1
        flat: list[str] = [w for d in docs for w in d]
        ids = np.array(self._ids(flat), np.int64)
        lengths = np.array([len(d) for d in docs])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) + pad * np.arange(len(docs)) if docs else np.zeros(0, np.int64)
        total = int(lengths.sum()) + pad * len(docs)
        tokens = np.zeros(total, np.int64)
        at = np.repeat(starts - (np.concatenate([[0], np.cumsum(lengths)[:-1]]) if docs else 0), lengths) + np.arange(len(ids))
        tokens[at] = ids
        out, tap = [], 0
        full = np.flatnonzero(lengths)
        ends = starts + lengths
        for w, bias in zip(m.params.widths, m.biases):
            conv = self.rows[:, tap * nf : (tap + 1) * nf][tokens]
            for k in range(1, w):
                conv[: total - k] += self.rows[:, (tap + k) * nf : (tap + k + 1) * nf][tokens[k:]]
            tap += w
            top = np.zeros((len(docs), nf), np.float32)
            if len(full):
                edges = np.stack([starts[full], ends[full]], 1).ravel()
                if edges[-1] >= total:
                    conv = np.concatenate([conv, np.zeros((1, nf), np.float32)])
                top[full] = np.maximum(np.maximum.reduceat(conv, edges, axis=0)[::2] + bias, 0)
            out.append(top)
        return np.concatenate(out, 1)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        found = np.zeros(len(texts), np.float32)
        for a, b in blocks(texts):
            docs = [words_of(t) for t in texts[a:b]]
            some = np.array([len(d) > 0 for d in docs])
            p = _sigmoid(self.pooled(docs) @ self.model.out + self.model.out_bias)
            found[a:b] = np.where(some, p, 0)
        return found


def score(texts: list[str | None], model: ToxicityModel) -> np.ndarray:
    """Probability of toxicity for each text."""
    return Scorer(model)(texts)


def fit(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Train on the labelled rows: first on ``params.sample_rows`` of either class, then, where there are more, on all."""
    named = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_toxic")).where("_id is not null and _toxic in (0, 1)")
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), F.col("lang").alias("_lang")).where("_text is not null")
    sizes = {r["_toxic"]: r["count"] for r in named.groupBy("_toxic").count().collect()}
    sample = None
    for value in (0, 1):
        part = bounded_sample(named.where(F.col("_toxic") == value), "_id", params.sample_rows)
        sample = part if sample is None else sample.unionByName(part)
    rows = texts.join(F.broadcast(sample), "_id").toPandas().sort_values(["_id", "_toxic", "_text"], ignore_index=True)
    langs = [None if pd.isna(x) else x for x in rows["_lang"]]
    trainer = start(rows["_text"].tolist(), rows["_toxic"].astype(int).tolist(), langs, params)
    if max(sizes.values(), default=0) > params.sample_rows and trainer.weight:
        small = F.broadcast if sum(sizes.values()) <= MAX_BROADCAST else lambda df: df
        rows = texts.join(small(named), "_id").withColumn("_hash", F.xxhash64("_text"))
        firsts = cut_lineage(rows.groupBy("_hash").agg(F.min("_id").alias("_id")).withColumn("_first", F.lit(True)), "firsts")  # of copies
        further(trainer, rows.join(small(firsts), ["_id", "_hash"], "left"))
    return trainer.model


def _chunks(batches: Iterator[pa.RecordBatch], params: ToxicityParams, rows: int = 1024, chars: int = 1 << 22) -> Iterator[tuple[list[str], np.ndarray, list[bool]]]:
    """(texts, toxic, first) of the rows that aren't held out, some at a time."""
    kept, size = [], 0
    for batch in batches:
        for at, texts in text_blocks(batch["_text"]):
            toxic, first = (batch[c].slice(at, len(texts)).to_pylist() for c in ("_toxic", "_first"))
            kept += [x for x, out in zip(zip(texts, toxic, first), is_held(texts, params)) if not out]
            size += sum(map(len, texts))
            if len(kept) >= rows or size >= chars and kept:
                yield [x[0] for x in kept], np.array([x[1] for x in kept], np.float32), [bool(x[2]) for x in kept]
                kept, size = [], 0
    if kept:
        yield [x[0] for x in kept], np.array([x[1] for x in kept], np.float32), [bool(x[2]) for x in kept]


def _gather(rows: DataFrame, work) -> Iterator[list[np.ndarray]]:
    """What each of the tasks made of its rows: arrays, of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with io.BytesIO() as file:
            np.savez(file, *work(batches))
            yield pa.RecordBatch.from_arrays([pa.array([file.getvalue()], pa.binary())], ["made"])

    for row in rows.mapInArrow(run, "made binary").collect():
        with np.load(io.BytesIO(row["made"])) as made:
            yield [made[k] for k in made.files]


def further(trainer: Trainer, rows: DataFrame) -> None:
    """Train on all ``rows`` (_text, _toxic, _lang, _first) and calibrate on all that are held out."""
    model, params = trainer.model, trainer.model.params
    tasks = rows.coalesce(params.workers)

    def count(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
        support, classes = np.zeros(params.buckets, np.int64), np.zeros(2, np.int64)
        for texts, toxic, first in _chunks(batches, params):
            classes += np.bincount(toxic.astype(int), minlength=2)
            _count(*_words(list(dict.fromkeys(t for t, f in zip(texts, first) if f)), params), support)
        return [support, classes]

    support, classes = (sum(x) for x in zip(*_gather(tasks, count)))
    if not classes.all():
        return
    trainer.weight = {float(c): 0.5 * classes.sum() / classes[c] for c in (0, 1)}
    trainer.hits[:] = trainer.steps = 0

    def learn(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
        rng = np.random.default_rng(params.seed)
        for texts, toxic, _ in _chunks(batches, params):
            feats, windows = _supported(*_words(texts, params), support, params)
            for some in np.array_split(rng.permutation(len(texts)), -(-len(texts) // params.batch)):
                trainer.step(feats, [windows[k] for k in some], toxic[some])
        m = trainer.model
        return [np.array(trainer.steps), trainer.hits, m.table, np.array(m.out_bias), m.out, *m.kernels, *m.biases]

    steps, hits, table, rest = 0, np.zeros(params.buckets), np.zeros(model.table.shape), None
    for own, own_hits, own_table, *others in _gather(tasks, learn):
        steps, hits = steps + int(own), hits + own_hits
        table += own_hits[:, None] * own_table.astype(np.float64)
        others = [int(own) * x.astype(np.float64) for x in others]
        rest = others if rest is None else [a + b for a, b in zip(rest, others)]
    model.table[hits > 0] = (table[hits > 0] / hits[hits > 0, None]).astype(np.float32)
    bias, out, *shaped = (x / steps for x in rest)
    model.out_bias, model.out = float(bias), out.astype(np.float32)
    shaped = [x.astype(np.float32) for x in shaped]
    model.kernels, model.biases = shaped[: len(params.widths)], shaped[len(params.widths) :]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for at, texts in text_blocks(batch["_text"]):
                lang, toxic = (batch[c].slice(at, len(texts)) for c in ("_lang", "_toxic"))
                yield pa.RecordBatch.from_arrays([lang, toxic, pa.array(is_held(texts, params)), pa.array(scorer(texts), pa.float32())], ["lang", "toxic", "held", "score"])

    odds = F.log(F.col("score").cast("double") / (1 - F.col("score").cast("double")))
    step = F.floor(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.when(F.col("score") <= 0, -30.0).when(F.col("score") >= 1, 30.0).otherwise(odds))) * STEPS)
    found = rows.mapInArrow(scored, "lang string, toxic int, held boolean, score float").groupBy("lang", "toxic", "held", step.alias("step"))
    found = found.agg(F.count("*").alias("n"), F.min("score").alias("least"), F.max("score").alias("most")).toPandas()  # some thousands a language
    by = found.groupby("step")
    scores, tops = by["least"].transform("min").to_numpy(float), by["most"].transform("max").to_numpy(float)
    langs = [None if pd.isna(x) else x for x in found["lang"]]
    model.thresholds = {}
    calibrate(model, scores, found["toxic"].to_numpy(float), langs, found["held"].to_numpy(bool), found["n"].to_numpy(float), tops)


def score_column(model: ToxicityModel, text: str = "text") -> Column:
    """Column of scores; the network is a few MB by its parameters and travels with the task."""

    @arrow_udf("float")
    def toxicity(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(model)
        for batch in batches:
            yield pa.array(np.concatenate([np.zeros(0, np.float32), *(scorer(texts) for _, texts in text_blocks(batch))]))

    return toxicity(F.col(text))


def threshold_column(model: ToxicityModel, lang: str = "lang") -> Column:
    """Threshold of the row's language."""
    other = F.lit(float(model.thresholds[None]))
    chosen = None
    for name, value in sorted((k, v) for k, v in model.thresholds.items() if k is not None):
        chosen = (F.when if chosen is None else chosen.when)(F.col(lang) == name, F.lit(float(value)))
    return other if chosen is None else chosen.otherwise(other)


def classify(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """One row a document: doc_id, lang, score, threshold, toxic."""
    own = docs.select("doc_id", "lang", "text")
    return own.select(
        "doc_id", "lang", score_column(model).cast("double").alias("score"), threshold_column(model).alias("threshold")
    ).withColumn("toxic", F.col("score") >= F.col("threshold"))


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The documents that are not toxic, with all their columns."""
    return docs.where(score_column(model).cast("double") < threshold_column(model))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op7_toxicity": op7_toxicity}
ORACLES: dict[str, str] = {}
