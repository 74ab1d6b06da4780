"""Substring dedup by level-wise doubling.

A passage is a run of words; a window is a run of fixed length. Level 0 looks at windows
of half the least length and, of these, only at the local minima of their hashes
(winnowing): any repeated window of the least length holds such a minimum, the same
one at each of its places, so nothing repeated is missed. Level 1 looks at windows of
the least length whose minimum is repeated. From there on, windows repeated at
one length alone are extended to twice that length, by joining two hashes of the level
before, until no candidates survive. Spans are the unions of repeated windows.

Equal texts are found first by a 128-bit hash, so that a text is examined once however
many documents carry it; its copies are spans as wholes. Windows are judged twice. Each
task first looks among those it makes itself, ``block`` at a time: those it holds more
than once are repeated for sure, and only one of them goes on, to answer for the others.
What a task holds once is then compared across tasks by a spillable window over the
hash. A passage that most documents share is thus shuffled once a block, not once a
document, and no task gets more of it than there are blocks. Shuffled are level 0's minima
(about 2 in 27 words), the texts that hold repeated ones, and the windows.

Words are runs of characters other than white space. Level 0 only proposes places, by 64
bits; from level 1 on windows are equal if 96 bits of hashes of their words are. A window
is repeated if it starts at two places, in two documents or one.

Edge cases: null ids and texts are left out; texts of fewer words than the least length
have no spans; very long texts are examined whole; rows equal in id and text are one
document; rows sharing an id only are taken as separate texts and their spans are listed
together; equal hashes within a run of minima leave the leftmost; ids are integers, or
texts of integers, and any other is an error; an empty table gives no rows; other columns
are neither read nor needed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from confab.llm.texts import text_blocks
from confab.plans.lineage import cut_lineage, release
from confab.sources.tables import table

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_WINDOWS = "key long, at int, h long, g int, kind tinyint"


@dataclass(frozen=True)
class SubstringParams:
    min_words: int = 50  # least length of a repeated passage, 2 at least
    block: int = 1 << 20  # windows that a task compares among themselves before it passes them on


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = base
    return np.cumprod(out, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of every window of ``length`` words, from their hashes."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(BASE, len(words)), dtype=np.uint64)])
    return mix((sums[length:] - sums[:-length]) * _powers(INVERSE, n))


def kinds(h: np.ndarray, g: np.ndarray | None = None) -> np.ndarray:
    """0 for hashes that occur once, 1 for the first of those that occur again, 2 for the others."""
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if g is not None:
        same &= g[order][1:] == g[order][:-1]
    found = np.zeros(len(h), np.int8)
    found[order[:-1][same]] = 1
    found[order[1:][same]] = 2
    return found


def minima(hashes: np.ndarray, span: int) -> np.ndarray:
    """For every run of ``span`` neighbours, the place of its least hash, the leftmost of equals."""
    if len(hashes) < span:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(hashes, span)
    return view.argmin(1) + np.arange(len(view))


def _first_pass(params: SubstringParams):
    half, span = params.min_words // 2, params.min_words - params.min_words // 2 + 1
    names = ["doc_id", "t0", "t1", "words", "at", "h", "kind"]

    def flush(ids: list[pa.RecordBatch], lengths: list[int], at: list[np.ndarray], h: list[np.ndarray]) -> pa.RecordBatch:
        keys = [pa.concat_arrays([b.column(k) for b in ids]) for k in range(3)]
        seen: set[tuple[int, int]] = set()
        for k, text in enumerate(zip(keys[1].to_pylist(), keys[2].to_pylist())):
            if text in seen:  # a copy has the places of the text before
                at[k], h[k] = at[k][:0], h[k][:0]
            seen.add(text)
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in at])]).astype(np.int32))
        hashes = np.concatenate(h)
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (np.concatenate(at), hashes.view(np.int64), kinds(hashes))]
        return pa.RecordBatch.from_arrays([*keys, pa.array(lengths, pa.int32()), *lists], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, at, h, held = [], [], [], [], 0
        for batch in batches:
            for first, texts in text_blocks(batch.column(3)):
                kept = []
                for k, text in enumerate(texts):
                    words = text.split()
                    if len(words) < params.min_words:
                        continue
                    hashes = window_hashes(word_hashes(words), half)
                    places = np.unique(minima(hashes, span))
                    kept.append(first + k)
                    lengths.append(len(words))
                    at.append(places.astype(np.int32))
                    h.append(hashes[places])
                    held += len(places)
                if kept:
                    ids.append(batch.select([0, 1, 2]).take(pa.array(kept)))
                if held >= params.block:
                    yield flush(ids, lengths, at, h)
                    ids, lengths, at, h, held = [], [], [], [], 0
        if ids:
            yield flush(ids, lengths, at, h)

    return run


def _judged(windows: Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]], block: int):
    """Rows (key, at, h, g, kind) of what ``windows`` makes of each batch, ``block`` of them judged together."""

    def flush(held: list[tuple]) -> pa.RecordBatch:
        key = np.repeat([k for k, *_ in held], [len(at) for _, at, _, _ in held])
        at, h, g = (np.concatenate([x[k] for x in held]) for k in (1, 2, 3))
        return pa.RecordBatch.from_pydict({"key": key.astype(np.int64), "at": at.astype(np.int32), "h": h.view(np.int64), "g": g.view(np.int32), "kind": kinds(h, g)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for one in windows(batch):
                held.append(one)
                size += len(one[1])
                if size >= block:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return run


def _second_pass(params: SubstringParams):
    """Windows of the least length whose minimum is repeated."""
    least, half = params.min_words, params.min_words // 2

    def windows(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        for first, texts in text_blocks(batch.column(1)):
            places = batch.column(2).slice(first, len(texts))
            for key, text, own in zip(batch.column(0).slice(first, len(texts)).to_pylist(), texts, places):
                words, own = word_hashes(text.split()), own.values.to_numpy()
                hot = np.zeros(len(words), bool)
                hot[own[own < len(words)]] = True
                p = np.flatnonzero(hot[minima(window_hashes(words, half), least - half + 1)])
                yield key, p, window_hashes(words, least)[p], (window_hashes(mix(words ^ BASE), least)[p] >> np.uint64(32)).astype(np.uint32)

    return _judged(windows, params.block)


def _extend(length: int, params: SubstringParams):
    """Windows of twice ``length`` from a text's repeated windows of that length."""

    def windows(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        for key, rows in zip(batch.column(0).to_pylist(), batch.column(1)):
            values = rows.values
            at, h, g = values.field("at").to_numpy(), values.field("h").to_numpy().view(np.uint64), values.field("g").to_numpy().view(np.uint32).astype(np.uint64)
            spot = np.minimum(np.searchsorted(at, at + length), len(at) - 1)
            ok = at[spot] == at + length
            if ok.any():
                joined = mix(h[ok] * BASE + mix(h[spot[ok]] + np.uint64(length)))
                yield key, at[ok], joined, (mix((g[ok] << np.uint64(32)) | g[spot[ok]]) >> np.uint64(32)).astype(np.uint32)

    return _judged(windows, params.block)


def _repeated(windows: DataFrame) -> DataFrame:
    """Of the windows (key, at, h, g, kind) those that occur at two places or more."""
    asked = windows.where("kind < 2").withColumn("n", F.count("*").over(Window.partitionBy("h", "g"))).where("n > 1 and kind = 0")
    return windows.where("kind > 0").drop("kind").unionByName(asked.drop("kind", "n"))


def _by_text(windows: DataFrame) -> DataFrame:
    return windows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "h", "g"))).alias("rows"))


def _runs(length: int):
    """(key, length, starts, ends): runs of a level's windows, merged where ``length`` lets them touch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts, lasts = [], []
            for rows in batch.column(1):
                at = rows.values.field("at").to_numpy()
                cut = np.flatnonzero(np.diff(at) > length) + 1
                firsts.append(at[np.concatenate([[0], cut])])
                lasts.append(at[np.concatenate([cut - 1, [len(at) - 1]])] + length)
            kind = pa.list_(pa.int32())
            columns = [batch.column(0), pa.array([length] * batch.num_rows, pa.int32()), pa.array(firsts, kind), pa.array(lasts, kind)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "length", "starts", "ends"])

    return run


def _spans(params: SubstringParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"key": [], "start_word": [], "end_word": [], "longest": []}
            for key, levels in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                starts = np.array(levels[0]["starts"])
                longest = np.full(len(starts), params.min_words)
                for level in levels[1:]:  # a run of longer windows lies within one span
                    inside = np.searchsorted(starts, np.array(level["starts"]), side="right") - 1
                    longest[inside] = level["length"]
                out["key"] += [key] * len(starts)
                out["start_word"] += levels[0]["starts"]
                out["end_word"] += levels[0]["ends"]
                out["longest"] += longest.tolist()
            types = {"key": pa.int64(), "start_word": pa.int32(), "end_word": pa.int32(), "longest": pa.int32()}
            yield pa.RecordBatch.from_pydict({k: pa.array(v, types[k]) for k, v in out.items()})

    return run


def repeated_spans(docs: DataFrame, params: SubstringParams = SubstringParams()) -> DataFrame:
    """(doc_id, start_word, end_word, longest): the passages of a document that occur again.

    ``end_word`` is exclusive; ``longest`` is the greatest length of the levels (least
    length times a power of two) at which some window of the span is still repeated.
    """
    least = params.min_words
    if least < 2:
        raise ValueError("min_words has to be 2 at least")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t0"), F.xxhash64(F.lit(1), F.col("text")).alias("t1"), "text").where("doc_id is not null and text is not null")
    first = cut_lineage(own.mapInArrow(_first_pass(params), "doc_id long, t0 long, t1 long, words int, at array<int>, h array<long>, kind array<tinyint>"), "minima")
    texts = first.groupBy("t0", "t1").agg(F.min("doc_id").alias("rep"), F.count_distinct("doc_id").alias("copies"), F.first("words").alias("words"))
    texts = cut_lineage(texts.withColumn("tid", F.xxhash64("t0", "t1")), "texts")
    places = first.select(F.xxhash64("t0", "t1").alias("tid"), F.explode(F.arrays_zip("at", "h", "kind")).alias("a")).select("tid", "a.at", "a.h", "a.kind")
    same, place = Window.partitionBy("h"), F.struct("tid", "at")  # copies of a text share its places
    apart = (F.min(place).over(same) != F.max(place).over(same)) | (F.max("kind").over(same) > 0)
    asked = places.where("kind < 2").withColumn("apart", apart).where("apart and kind = 0")
    hot = places.where("kind > 0").select("tid", "at").unionByName(asked.select("tid", "at")).groupBy("tid").agg(F.collect_set("at").alias("places"))
    hot = hot.join(texts.select("tid", F.col("rep").alias("doc_id"), "t0", "t1"), "tid").drop("tid")
    hot = cut_lineage(hot.withColumn("key", F.monotonically_increasing_id()), "hot")  # a number of its own for every text
    text_rows = own.join(hot, ["doc_id", "t0", "t1"]).dropDuplicates(["doc_id", "t0", "t1"])
    windows, length, levels = text_rows.select("key", "text", "places").mapInArrow(_second_pass(params), _WINDOWS), least, []
    while True:
        windows = cut_lineage(windows, "candidates")
        now = cut_lineage(_by_text(_repeated(windows)), "windows")
        release(docs.sparkSession, windows)
        if now.isEmpty():
            release(docs.sparkSession, now)
            break
        levels.append(now.mapInArrow(_runs(length), "key long, length int, starts array<int>, ends array<int>"))
        windows = now.mapInArrow(_extend(length, params), _WINDOWS)
        length *= 2
    copied = texts.where("copies > 1").select("t0", "t1", F.lit(0).alias("start_word"), F.col("words").alias("end_word"), (least * F.pow(2.0, F.floor(F.log2(F.col("words") / least)))).cast("int").alias("longest"))
    found = copied
    if levels:
        all_levels = levels[0]
        for level in levels[1:]:
            all_levels = all_levels.unionByName(level)
        runs = all_levels.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("length", "starts", "ends"))).alias("levels"))
        spans = runs.mapInArrow(_spans(params), "key long, start_word int, end_word int, longest int")
        single = texts.where("copies = 1").select("t0", "t1").join(hot.select("key", "t0", "t1"), ["t0", "t1"]).join(spans, "key")
        found = copied.unionByName(single.select(copied.columns))
    return first.select("doc_id", "t0", "t1").distinct().join(found, ["t0", "t1"]).select("doc_id", "start_word", "end_word", "longest")


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))


_LEVELS = 11  # 50 words to 51,200


def _oracle() -> str:
    sql = [
        "words AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)",
        "w0 AS (SELECT doc_id, p, hash(w[p + 1 : p + 50]) AS h FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS p FROM words WHERE len(w) >= 50))",
    ]
    for k in range(_LEVELS):
        sql.append(f"r{k} AS (SELECT doc_id, p, h FROM (SELECT *, count(*) OVER (PARTITION BY h) AS n FROM w{k}) WHERE n > 1)")
        if k + 1 < _LEVELS:
            sql.append(f"w{k + 1} AS (SELECT a.doc_id, a.p, hash([a.h, b.h]) AS h FROM r{k} a JOIN r{k} b ON a.doc_id = b.doc_id AND b.p = a.p + {50 << k})")
    sql.append("g AS (SELECT doc_id, p, sum(CASE WHEN q IS NULL OR p - q > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS i FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM r0))")
    sql.append("s AS (SELECT doc_id, i, min(p) AS a, max(p) + 50 AS b FROM g GROUP BY ALL)")
    sql.append("l AS (" + " UNION ALL ".join(f"SELECT doc_id, p, {50 << k} AS n FROM r{k}" for k in range(_LEVELS)) + ")")
    return "WITH " + ",\n".join(sql) + "\nSELECT s.doc_id, CAST(a AS INTEGER) AS start_word, CAST(b AS INTEGER) AS end_word, CAST(max(n) AS INTEGER) AS longest FROM s JOIN l ON l.doc_id = s.doc_id AND l.p >= a AND l.p < b GROUP BY s.doc_id, a, b"


QUERIES = {"op8_substring_dedup": op8_substring_dedup}
ORACLES = {"op8_substring_dedup": _oracle()}
