"""Embedding near-duplicates by a pivot-permutation index.

A vector is described by its nearest reference points (pivots) in order, kept to a
prefix. Inverted lists hold, for each pivot, the vectors whose prefix names it. Within
a list, pairs that share enough pivots are candidates; their cosine decides. Counting is
a product of incidence matrices and a pair is answered only in the list of the first
pivot it shares, so nothing is answered twice and no candidates are collected.

``near_pairs`` answers with the pairs themselves, which can be as many as the square of the
vectors. The query, ``near_classes``, answers with a row a document: the least id of its
class, the documents that chains of near pairs connect, and the number of its links. Equal
vectors are searched once, as one with a weight, and a list answers with a sum of weights
and a spanning forest, so its rows grow with the vectors however many of them are alike.

Pivots are put in one order, that of the shortest list first. Two prefixes of ``prefix``
pivots that share ``shared`` of them also share one of the first ``prefix - shared + 1``
of each in that order, so a vector is sent to those lists only, its shortest, and no pair
is lost by it. The number of pivots grows with the square root of the number of vectors,
which keeps lists short; they are the only thing broadcast, and their size is bounded by
``pivot_bytes`` (a million pivots of 64 numbers, enough for 10^11 vectors; beyond it lists
grow in proportion). A list longer than ``block`` is cut into blocks and each pair of
blocks is one task, so no list is too long for a task and none is cut short.

The search is approximate: a pair above the threshold is missed if its prefixes share
fewer than ``shared`` pivots. Recall is tested against brute force.

Edge cases: null ids and null, empty, zero or non-finite vectors are in no pair; vectors
of each length have an index of their own and pair among themselves; a repeated row
pairs as one; vectors that share an id don't pair with each other, and a pair of ids
answers with its greatest cosine; equal vectors pair with cosine 1; pivots that are
equally near may stand in any order; ids are integers, or texts of integers, and any other
is an error; an empty table gives no rows; other columns are not read. In ``near_classes``
a row that repeats an id with another vector is a document of its own, which links like any
other; a repeated row is one document; a vector that can be in no pair is a class of its own
without links; a null id has no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confab.llm.simhash import link
from confab.llm.texts import bounded_sample
from confab.plans.components import connected_components
from confab.plans.lineage import cut_lineage
from confab.sources.tables import table


@dataclass(frozen=True)
class PivotParams:
    threshold: float = 0.95  # cosine
    prefix: int = 8  # nearest pivots kept of each vector
    shared: int = 3  # pivots that a candidate pair has in common
    pivot_factor: float = 2.0  # pivots = factor * sqrt(vectors)
    min_pivots: int = 16
    pivot_bytes: int = 256 << 20  # of all pivots, in float32
    block: int = 4096  # vectors of a list in one block


def matrix_of(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)


def _describe(pivots: np.ndarray, prefix: int, dim: int):
    """Unit vectors and the ordered prefix of their nearest pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = matrix_of(batch.column(1), dim)
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            near = np.empty((len(unit), prefix), np.int32)
            rows = max(1, (1 << 22) // len(pivots))
            for a in range(0, len(unit), rows):
                far = -(unit[a : a + rows] @ pivots.T)
                some = np.argpartition(far, prefix - 1, axis=1)[:, :prefix] if prefix < len(pivots) else np.broadcast_to(np.arange(prefix), far.shape)
                near[a : a + rows] = np.take_along_axis(some, np.argsort(np.take_along_axis(far, some, 1), axis=1, kind="stable"), 1)
            sizes = lambda n: pa.array(np.arange(len(unit) + 1, dtype=np.int32) * n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(sizes(dim), pa.array(unit.ravel())), pa.ListArray.from_arrays(sizes(prefix), pa.array(near.ravel())), batch.column(2)],
                ["vec_id", "unit", "near", "weight"],
            )

    return run


def pairs_in_list(pivot: int, ids: np.ndarray, unit: np.ndarray, near: np.ndarray, side: np.ndarray, params: PivotParams) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of one list (or of two blocks of it) that this pivot answers for: rows and cosine, some at a time.

    ``pivot`` and ``near`` are places in the common order of pivots.
    """
    one = np.flatnonzero(side == 0)
    two = np.flatnonzero(side == 1) if side.any() else one
    names, where = np.unique(near, return_inverse=True)
    held = np.zeros((len(ids), len(names)), np.float32)
    held[np.arange(len(ids))[:, None], where.reshape(near.shape)] = 1
    for a in range(0, len(one), 1024):
        rows = one[a : a + 1024]
        i, j = np.nonzero(held[rows] @ held[two].T > params.shared - 0.5)
        i, j = rows[i], two[j]
        once = ids[i] < ids[j] if two is one else ids[i] != ids[j]
        i, j = i[once], j[once]
        for b in range(0, len(i), 1 << 18):
            p, q = i[b : b + (1 << 18)], j[b : b + (1 << 18)]
            cosine = np.einsum("nd,nd->n", unit[p], unit[q])
            close = cosine >= params.threshold
            p, q, cosine = p[close], q[close], cosine[close]
            common = np.where((near[p][:, :, None] == near[q][:, None, :]).any(2), near[p], np.iinfo(np.int32).max)
            mine = common.min(1) == pivot if len(p) else np.zeros(0, bool)
            yield p[mine], q[mine], cosine[mine]


def _pairs_of(columns: list[np.ndarray], found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    """(vec_a, vec_b, cosine) of the pairs of rows ``found``."""
    ids, cut = columns[0], [(np.zeros(0, int), np.zeros(0, int), np.zeros(0)), *found]
    p, q, cosine = (np.concatenate(x) for x in zip(*cut))
    a, b = np.minimum(ids[p], ids[q]), np.maximum(ids[p], ids[q])
    return pa.table({"vec_a": pa.array(a, pa.int64()), "vec_b": pa.array(b, pa.int64()), "cosine": pa.array(cosine, pa.float64())})


def _links_of(columns: list[np.ndarray], found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    """(node, other, links): each row that is in a pair of ``found``, the weight of those it pairs with, and a spanning forest."""
    ids, weight = columns
    labels, links = np.arange(len(ids)), np.zeros(len(ids), np.int64)
    for p, q, _ in found:
        np.add.at(links, p, weight[q])
        np.add.at(links, q, weight[p])
        link(labels, p, q)
    some = np.flatnonzero(links)
    return pa.table({"node": pa.array(ids[some], pa.int64()), "other": pa.array(ids[labels[some]], pa.int64()), "links": pa.array(links[some], pa.int64())})


#: What a list may answer with, and its columns.
PAIRS = _pairs_of, "vec_a long, vec_b long, cosine double"
LINKS = _links_of, "node long, other long, links long"


def _vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows with an id."""
    own = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("v"))
    return own.where("vec_id is not null")


def _usable(own: DataFrame) -> DataFrame:
    """The rows whose vector has a direction."""
    fine = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)  # null or NaN if any element is
    return own.where("size(v) > 0").where((fine > 0) & (fine < float("inf")))


def _search(own: DataFrame, params: PivotParams, answer: tuple) -> DataFrame:
    """What the lists of the vectors (vec_id, v, weight) answer, those of each length apart."""
    sizes = own.groupBy(F.size("v").alias("dim")).count().where("count > 1").orderBy("dim").collect()  # a row a length
    found = None
    for dim, total in sizes:
        some = _search_length(own.where(F.size("v") == dim), dim, total, params, answer)
        found = some if found is None else found.unionByName(some)
    return own.sparkSession.createDataFrame([], answer[1]) if found is None else found


def near_pairs(embeddings: DataFrame, params: PivotParams = PivotParams()) -> DataFrame:
    """(vec_a, vec_b, cosine): pairs of vectors with cosine at the threshold or above, vec_a < vec_b."""
    found = _search(_usable(_vectors(embeddings)).withColumn("weight", F.lit(1).cast("long")), params, PAIRS)
    return found.groupBy("vec_a", "vec_b").agg(F.round(F.max("cosine"), 3).alias("cosine"))  # a repeated row repeats its pairs


def near_classes(embeddings: DataFrame, params: PivotParams = PivotParams()) -> DataFrame:
    """(vec_id, class_id, links): a row a document, with the least id of its class and the number of documents that it is near to."""
    docs = _vectors(embeddings).distinct()
    folded = _usable(docs).groupBy("v").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"))
    nodes = cut_lineage(folded.withColumn("node", F.monotonically_increasing_id()), "vectors")
    found = cut_lineage(_search(nodes.select(F.col("node").alias("vec_id"), "v", "weight"), params, LINKS), "links")
    roots = connected_components(found.select(F.col("node").alias("u"), F.col("other").alias("v")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    own = nodes.drop("v").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = own.groupBy("root").agg(F.min("least").alias("class_id"))
    classes = own.join(least, "root").select("node", "class_id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    classes = nodes.select("node", "v").join(classes, "node").drop("node")
    return docs.join(classes, "v", "left").select("vec_id", F.coalesce("class_id", "vec_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def _search_length(own: DataFrame, dim: int, total: int, params: PivotParams, answer: tuple) -> DataFrame:
    """What the lists of the ``total`` vectors (vec_id, v, weight) of ``own``, all of ``dim`` elements, answer."""
    most = max(params.min_pivots, params.pivot_bytes // (4 * dim))
    count = int(min(most, max(params.min_pivots, params.pivot_factor * total**0.5)))
    hashed = own.select("v", F.xxhash64("v").alias("key"))  # equal vectors are chosen, or not, as one
    chosen = bounded_sample(hashed, "key", count).select("v").toArrow()["v"].combine_chunks()
    pivots = np.unique(matrix_of(chosen, dim), axis=0)
    pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
    prefix = min(params.prefix, len(pivots))
    params = PivotParams(**{**params.__dict__, "prefix": prefix, "shared": min(params.shared, prefix)})
    index = cut_lineage(own.mapInArrow(_describe(pivots, prefix, dim), "vec_id long, unit array<float>, near array<int>, weight long"), "pivots")
    counts = {r["pivot"]: r["count"] for r in index.select(F.explode("near").alias("pivot")).groupBy("pivot").count().collect()}  # a row a pivot
    place = np.empty(len(pivots), int)
    place[sorted(range(len(pivots)), key=lambda p: (counts.get(p, 0), p))] = np.arange(len(pivots))
    ranked = F.array_sort(F.transform("near", lambda p: F.get(F.array(*map(F.lit, place.tolist())), p)))
    listed = index.select("vec_id", "unit", "weight", ranked.alias("near")).withColumn("pivot", F.explode(F.slice("near", 1, prefix - params.shared + 1)))
    lengths = {r["pivot"]: r["count"] for r in listed.groupBy("pivot").count().collect()}
    cuts = F.array(*[F.lit(max(1, -(-lengths.get(p, 0) // params.block))) for p in range(len(pivots))])
    placed = listed.withColumn("cuts", F.get(cuts, F.col("pivot"))).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("cuts")))
    tasks = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("other")).select(
        "pivot", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), (F.col("block") > F.col("other")).cast("int").alias("side"), "vec_id", "unit", "near", "weight"
    )

    def verify(key: tuple, group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        columns = [group[c].combine_chunks() for c in ("vec_id", "unit", "near", "side", "weight")]
        near, ids = columns[2].flatten().to_numpy().reshape(-1, prefix), columns[0].to_numpy()
        found = pairs_in_list(key[0].as_py(), ids, matrix_of(columns[1], dim), near, columns[3].to_numpy(), params)
        return answer[0]([ids, columns[4].to_numpy()], found)

    return tasks.groupBy("pivot", "a", "b").applyInArrow(verify, answer[1])


def op1_pivot_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "embeddings"))


QUERIES = {"op1_pivot_near_dedup": op1_pivot_near_dedup}
ORACLES = {
    "op1_pivot_near_dedup": """
WITH RECURSIVE docs AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id, embedding) AS n, vec_id, embedding
    FROM (SELECT DISTINCT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL)),
pairs AS MATERIALIZED (
    SELECT a.n AS a, b.n AS b FROM docs a JOIN docs b ON a.n <> b.n
    WHERE list_cosine_similarity(a.embedding, b.embedding) BETWEEN 0.95 AND 1.01),
reached AS (
    SELECT n, n AS root FROM docs
    UNION SELECT p.b, r.root FROM reached r JOIN pairs p ON p.a = r.n WHERE r.root < p.b),
classes AS (SELECT n, min(root) AS root FROM reached GROUP BY n),
links AS (SELECT a, count(*) AS links FROM pairs GROUP BY a)
SELECT d.vec_id, o.vec_id AS class_id, coalesce(l.links, 0) AS links
FROM docs d JOIN classes c ON c.n = d.n JOIN docs o ON o.n = c.root LEFT JOIN links l ON l.a = d.n"""
}
