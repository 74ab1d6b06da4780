"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Two maps over the corpus. The first counts, over all documents, how many hold each
n-gram of the test items; from those counts every item gets its seeds, the n-grams
that are rare in the corpus or little commoner than the rarer half of its own, wherever
in the item they lie. The second finds seeds in the documents and aligns the
item with the passage around each hit; the alignment score, as a share of the item's
own, decides. Substituted, inserted and lost words cost little, so edited copies score
high. Neither map shuffles texts: only n-gram counts move.

An item whose own n-grams are all common tells nothing by one of them: a short item, of
fewer than ``short`` n-grams' words, is sought by rare n-grams alone, and a passage found by
common n-grams only must share two of them that don't overlap. Items with no seed are
listed by :func:`unsought`, not sought by a word that half the corpus holds.

Test items are looked up from a table inside each task. Its size is checked: beyond
``items_per_pass`` words the items are cut into slices by hash, each with its own two
maps, so memory stays bounded for any benchmark.

Edge cases: null or wordless texts and items match nothing; items shorter than an
n-gram are sought whole, if that is rare; very long texts are searched and aligned whole;
equal scores all count, and of an item's n-grams with equal counts those nearer its start come first; rows that share a document or item id answer with their best
score; null ids are left out of the pairs, yet such documents are dropped by
``drop_contaminated`` when they match; no items means no pairs; other columns are
neither read nor lost.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type

from confab.llm.texts import text_blocks
from confab.sources.tables import table

WORD = re.compile(r"\w+")
_GAP = -1  # word outside every item


@dataclass(frozen=True)
class AlignParams:
    n: int = 4
    rare_share: float = 0.01  # an n-gram in no more than this share of the documents is rare
    rare_count: int = 50  # and so is one in no more than so many documents, which matters in small tables
    short: int = 2  # items of fewer words than so many n-grams laid end to end are sought by rare n-grams alone
    near_half: float = 4.0  # an n-gram is a seed up to so many times the count that bounds the rarer half of the item
    match: int = 2
    mismatch: int = -1
    gap: int = -1
    threshold: float = 0.5  # of the item's score with itself
    items_per_pass: int = 2_000_000  # words


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def align(item: np.ndarray, passage: np.ndarray, params: AlignParams = AlignParams()) -> int:
    """Best Smith-Waterman score of two word sequences with linear gaps."""
    if not len(item) or not len(passage):
        return 0
    steps = -params.gap * np.arange(1, len(passage) + 1)
    row, best = np.zeros(len(passage) + 1, np.int64), 0
    for word in item:
        scores = np.where(passage == word, params.match, params.mismatch)
        here = np.maximum(np.maximum(row[:-1] + scores, row[1:] + params.gap), 0)
        row = np.concatenate([[0], np.maximum.accumulate(here + steps) - steps])
        best = max(best, int(row.max()))
    return best


class Items:
    """Lookup of the n-grams of test items; ``grams`` maps a tuple of word numbers to its number."""

    def __init__(self, items: list[tuple[object, str]], params: AlignParams):
        self.params = params
        self.vocab: dict[str, int] = {}
        self.ids, self.texts = [], []
        self.grams: dict[tuple[int, ...], int] = {}
        self.where: list[list[tuple[int, int]]] = []  # of each gram: (item, offset)
        for item_id, text in items:
            words = words_of(text)
            if item_id is None or not words:
                continue
            seq = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
            k = len(self.ids)
            self.ids.append(item_id)
            self.texts.append(np.array(seq))
            n = min(params.n, len(seq))
            for at in range(len(seq) - n + 1):
                gram = tuple(seq[at : at + n])
                g = self.grams.setdefault(gram, len(self.grams))
                if g == len(self.where):
                    self.where.append([])
                self.where[g].append((k, at))
        self.seeds: np.ndarray | None = None  # of each gram, for the second map: is it a seed of the item?
        self._index()

    def _index(self) -> None:
        self.codes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by_n: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for gram, g in self.grams.items():
            by_n[len(gram)].append((self._code(np.array(gram)), g))
        for n, pairs in by_n.items():
            codes, numbers = np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs])
            order = np.argsort(codes, kind="stable")
            self.codes[n] = codes[order], numbers[order]

    def _code(self, seq: np.ndarray) -> int:
        base, code = len(self.vocab) + 1, 0
        for x in seq:
            code = (code * base + int(x) + 1) & ((1 << 63) - 1)
        return code

    def encode(self, words: list[str]) -> np.ndarray:
        get = self.vocab.get
        return np.fromiter((get(w, _GAP) for w in words), np.int64, len(words))

    def hits(self, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``seq`` and grams found there; equal codes are checked word by word."""
        base = len(self.vocab) + 1
        at_all, gram_all = [], []
        for n, (codes, numbers) in self.codes.items():
            if len(seq) < n:
                continue
            inside = seq >= 0
            whole = inside[: len(seq) - n + 1].copy()
            for k in range(1, n):
                whole &= inside[k : len(seq) - n + 1 + k]
            at = np.flatnonzero(whole)
            if not len(at):
                continue
            code = np.zeros(len(at), np.int64)
            with np.errstate(over="ignore"):
                for k in range(n):
                    code = (code * base + seq[at + k] + 1) & np.int64((1 << 63) - 1)
            spot = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            same = codes[spot] == code
            for p, s, c in zip(at[same], spot[same], code[same]):
                while s < len(codes) and codes[s] == c:
                    if self.grams.get(tuple(seq[p : p + n].tolist())) == numbers[s]:
                        at_all.append(p)
                        gram_all.append(numbers[s])
                    s += 1
        return np.array(at_all, np.int64), np.array(gram_all, np.int64)

    def choose_seeds(self, df: dict[int, int], documents: int) -> None:
        """Per item: the rare n-grams and, if few are rare, the rarer half of those that occur.

        An item that leaks often has counts that are all alike or, with edited copies, nearly
        so; n-grams up to ``near_half`` times as common as that half are seeds too, lest one
        end of the item be without. Where that half is in most documents, it is spread evenly.
        """
        self.seeds = [set() for _ in self.ids]
        of_item: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for g, places in enumerate(self.where):
            for k, at in places:
                of_item[k].append((df.get(g, 0), at, g))
        rare = max(self.params.rare_count, self.params.rare_share * documents)
        self.common = np.array([df.get(g, 0) > rare for g in range(len(self.where))], bool)
        for k, found in of_item.items():
            found = sorted(f for f in found if f[0])
            half = (len(found) + 1) // 2
            mark = found[half - 1][0] if found else 0
            if len(self.texts[k]) < self.params.short * self.params.n:
                self.seeds[k] = {g for n, _, g in found if n <= rare}
                continue
            if 2 * mark <= documents:
                self.seeds[k] = {g for n, _, g in found if n <= max(rare, self.params.near_half * mark)}
                continue
            clear = [f for f in found if 2 * f[0] < mark]
            rest = sorted((at, n, g) for n, at, g in found[len(clear) :])
            spread = [rest[i * len(rest) // (half - len(clear))][2] for i in range(half - len(clear))]
            self.seeds[k] = {*spread, *(f[2] for f in clear), *(g for n, _, g in found if n <= rare)}

    def matches(self, words: list[str]) -> list[tuple[object, float]]:
        """(item id, score) of the items aligned to the words at or above the threshold."""
        seq = self.encode(words)
        at, grams = self.hits(seq)
        spans: dict[int, list[tuple[int, int, int, bool]]] = defaultdict(list)
        for p, g in zip(at, grams):
            for k, offset in self.where[g]:
                if g in self.seeds[k]:
                    n = len(self.texts[k])
                    spans[k].append((p - offset - n // 2 - 2, p - offset + n + n // 2 + 2, p, not self.common[g]))
        found = []
        for k, own in spans.items():
            own.sort()
            best, (lo, hi, first, sure) = 0, own[0]
            last = first
            for a, b, p, rare in [*own[1:], (len(seq) + 1 << 40, 0, 0, False)]:
                if a <= hi:
                    hi, first, last, sure = max(hi, b), min(first, p), max(last, p), sure or rare
                    continue
                if sure or last - first >= self.params.n:
                    best = max(best, align(self.texts[k], seq[max(0, lo) : max(0, hi)], self.params))
                lo, hi, first, last, sure = a, b, p, p, rare
            share = best / (self.params.match * len(self.texts[k]))
            if share >= self.params.threshold:
                found.append((self.ids[k], share))
        return sorted(found, key=lambda f: str(f[0]))


def _count(items: Items):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, documents = np.zeros(len(items.grams), np.int64), 0
        for batch in batches:
            documents += batch.num_rows
            for _, texts in text_blocks(batch.column(0)):
                words, ends = [], []
                for t in texts:
                    words += words_of(t)
                    words += ["\n"] * items.params.n  # no n-gram runs from one text into the next
                    ends.append(len(words))
                at, grams = items.hits(items.encode(words))
                if len(at):
                    doc = np.searchsorted(np.array(ends), at, side="right")
                    pairs = np.unique(np.stack([doc, grams], 1), axis=0)
                    df += np.bincount(pairs[:, 1], minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"gram": pa.array([-1, *some], pa.int64()), "n": pa.array([documents, *df[some]], pa.int64())})

    return count


def passes(docs: DataFrame, benchmark: DataFrame, params: AlignParams = AlignParams()) -> Iterator[Items]:
    """The items, a slice at a time, with seeds chosen by counts over all documents."""
    own = benchmark.select(F.col("item_id").alias("_item"), F.col("text").alias("_text")).where("_item is not null and _text is not null")
    size = own.agg(F.sum(F.size(F.split("_text", r"\s+")))).first()[0] or 0
    slices = max(1, -(-size // params.items_per_pass))
    for k in range(slices):
        rows = own.where(F.pmod(F.xxhash64("_text"), F.lit(slices)) == k).orderBy("_item", "_text").collect()
        items = Items([(r[0], r[1]) for r in rows], params)
        if not items.ids:
            continue
        counts = docs.select("text").mapInArrow(_count(items), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        df = {r["gram"]: r["n"] for r in counts.collect()}  # the slice's n-grams at most
        items.choose_seeds(df, df.pop(-1, 0))
        yield items


def match_column(items: Items, item_type: T.DataType, text: str = "text") -> Column:
    """Array of (item_id, score) of the items that a text leaks."""
    kind = T.ArrayType(T.StructType([T.StructField("item_id", item_type), T.StructField("score", T.DoubleType())]))

    @arrow_udf(kind)
    def leaks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        arrow = to_arrow_type(kind)
        for batch in batches:
            found = [items.matches(words_of(t)) for _, texts in text_blocks(batch) for t in texts]
            yield pa.array([[{"item_id": i, "score": s} for i, s in own] for own in found], arrow)

    return leaks(F.col(text))


def contaminated(docs: DataFrame, benchmark: DataFrame, params: AlignParams = AlignParams()) -> DataFrame:
    """(doc_id, item_id, score) of every document that holds a copy of a test item, exact or edited."""
    kind = benchmark.schema["item_id"].dataType
    found = None
    for items in passes(docs, benchmark, params):
        leaks = docs.select("doc_id", F.explode(match_column(items, kind)).alias("leak")).select("doc_id", "leak.item_id", "leak.score")
        found = leaks if found is None else found.unionByName(leaks)
    if found is None:
        return docs.sparkSession.createDataFrame([], T.StructType([docs.schema["doc_id"], T.StructField("item_id", kind), T.StructField("score", T.DoubleType())]))
    return found.where("doc_id is not null").groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, params: AlignParams = AlignParams()) -> DataFrame:
    """The documents that leak no test item, with all their columns."""
    kept = docs
    for items in passes(docs, benchmark, params):
        kept = kept.where(F.size(match_column(items, benchmark.schema["item_id"].dataType)) == 0)
    return kept


def unsought(docs: DataFrame, benchmark: DataFrame, params: AlignParams = AlignParams()) -> DataFrame:
    """(item_id) of the items with words but without a seed: none of their n-grams occurs, or all are too common to tell."""
    found = [(i,) for items in passes(docs, benchmark, params) for i, seeds in zip(items.ids, items.seeds) if not seeds]
    kind = T.StructType([T.StructField("item_id", benchmark.schema["item_id"].dataType)])
    return docs.sparkSession.createDataFrame(found, kind).distinct()


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op5_decontaminate": op5_decontaminate}
ORACLES: dict[str, str] = {}
