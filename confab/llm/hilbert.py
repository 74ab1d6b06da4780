"""Sharding in Hilbert-curve order.

Metadata columns are quantised to equally filled buckets, the buckets of a row are a
cell of a grid, and the cell's place on a Hilbert curve orders the rows, so rows near
each other in several columns at once share a file and file statistics prune on any of
them. Runs of the order are cut where the running total of a size column passes a
multiple of the target, so files are alike in size.

Everything is built from columns in the JVM: the curve is a walk through two constant
tables (state and bits to place and next state). Bucket bounds are exact, from counts
of distinct values; only they, 2^bits a column, reach the driver. Ordering is one range
shuffle of narrow rows; totals are summed a partition and then across partitions.

Edge cases: null metadata sort below all values; a null or negative size counts 0; rows
equal in place and id keep any order among themselves, which can't show; null ids sort
first; an empty table gives no rows; other columns are not read, except by
``write_shards``, which keeps them all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confab.plans.lineage import cut_lineage, temporary
from confab.plans.ranks import running_total
from confab.sources.tables import table


@dataclass(frozen=True)
class HilbertParams:
    columns: tuple[str, ...] = ("source", "lang", "n_chars")
    bits: int = 5  # of each column
    size: str = "n_chars"
    target: int = 4_000_000  # characters a shard


def curve_tables(n: int) -> tuple[list[int], list[int]]:
    """(place, next state) for state * 2^n + bits; a state is entry corner * n + direction."""
    full = (1 << n) - 1
    left = lambda x, k: ((x << (k % n)) | (x >> (n - k % n))) & full if k % n else x
    gray = lambda w: w ^ (w >> 1)
    inverse = {gray(w): w for w in range(1 << n)}
    trailing = lambda w: 0 if w == 0 else next(k for k in range(n + 1) if not (w >> k) & 1)
    entry = lambda w: 0 if w == 0 else gray(2 * ((w - 1) // 2))
    place, after = [], []
    for e in range(1 << n):
        for d in range(n):
            for bits in range(1 << n):
                w = inverse[left(bits ^ e, n - (d + 1) % n)]
                turn = 0 if w == 0 else trailing(w - 1 if w % 2 == 0 else w) % n
                place.append(w)
                after.append((e ^ left(entry(w), d + 1)) * n + (d + turn + 1) % n)
    return place, after


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """Place of a cell on the curve, as a bigint."""
    n = len(cells)
    place, after = (F.array(*map(F.lit, t)) for t in curve_tables(n))
    state, index = F.lit(0), F.lit(0).cast("bigint")
    for level in range(bits - 1, -1, -1):
        corner = F.lit(0)
        for k, cell in enumerate(cells):
            corner = corner + F.shiftleft(F.shiftright(cell, level).bitwiseAND(1), k)
        at = state * (1 << n) + corner
        index = index * (1 << n) + F.get(place, at)
        state = F.get(after, at)
    return index


def bucket_bounds(docs: DataFrame, column: str, bits: int) -> list[tuple[int, object]]:
    """(bucket, least value) of the buckets in use, at most 2^bits of them."""
    counts = docs.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    with temporary():
        placed = cut_lineage(running_total(counts, ["v"], "n", "before"), "bounds")
        total = placed.agg(F.sum("n")).first()[0] or 1
        bucket = F.floor(F.col("before") * (1 << bits) / total).cast("int")
        rows = placed.where("v is not null").groupBy(bucket.alias("b")).agg(F.min("v").alias("v")).orderBy("b").collect()
    return [(r["b"], r["v"]) for r in rows]


def bucket_column(column: str, bounds: list[tuple[int, object]]) -> Column:
    """Bucket of a value; null is bucket 0."""
    if not bounds:
        return F.lit(0)
    values, buckets = F.array(*[F.lit(v) for _, v in bounds]), F.array(*[F.lit(b) for b, _ in bounds])
    below = F.size(F.filter(values, lambda v: v <= F.col(column)))
    return F.when(F.col(column).isNull(), 0).otherwise(F.coalesce(F.get(buckets, below - 1), F.lit(0)))


def hilbert_column(docs: DataFrame, params: HilbertParams = HilbertParams()) -> Column:
    """Curve index of a row of ``docs``."""
    return hilbert_index([bucket_column(c, bucket_bounds(docs, c, params.bits)) for c in params.columns], params.bits)


def _placed(docs: DataFrame, params: HilbertParams, *row: Column) -> DataFrame:
    """(doc_id, hilbert, weight, shard, row...) of every row, in the one order that cuts shards."""
    weight = F.greatest(F.coalesce(F.col(params.size).cast("bigint"), F.lit(0)), F.lit(0))
    placed = docs.select("doc_id", hilbert_column(docs, params).alias("hilbert"), weight.alias("weight"), *row)
    total = running_total(placed, ["hilbert", "doc_id", "weight"], "weight", "before")
    return total.withColumn("shard", F.floor(F.col("before") / params.target).cast("bigint"))


def assign_shards(docs: DataFrame, params: HilbertParams = HilbertParams()) -> DataFrame:
    """(doc_id, hilbert, shard) of every row."""
    return _placed(docs, params).select("doc_id", "hilbert", "shard")


def shard_statistics(docs: DataFrame, params: HilbertParams = HilbertParams()) -> DataFrame:
    """One row a shard: rows, size, and the bounds of each curve column, for pruning."""
    placed = _placed(docs, params, F.struct(*dict.fromkeys(params.columns)).alias("row"))
    bounds = [f(F.col("row")[c]).alias(f"{name}_{c}") for c in params.columns for name, f in (("min", F.min), ("max", F.max))]
    return placed.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("weight").alias("size"), *bounds)


def write_shards(docs: DataFrame, path: str, params: HilbertParams = HilbertParams()) -> None:
    """Write all columns in curve order, a file a shard, whose part number is the shard's.

    Texts are shuffled twice: by range, for the running total, and to the file of their shard.
    """
    placed = _placed(docs, params, F.struct("*").alias("row"))
    files = (placed.agg(F.max("shard")).first()[0] or 0) + 1
    ordered = placed.repartitionById(files, F.col("shard").cast("int")).sortWithinPartitions("hilbert", "doc_id", "weight")
    ordered.select("row.*").write.parquet(path)


def op2_hilbert_shards(spark, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))


def _oracle(params: HilbertParams = HilbertParams()) -> str:
    n, full = len(params.columns), 1 << params.bits
    place, after = curve_tables(n)
    parts, names = [], []
    for k, c in enumerate(params.columns):
        parts.append(f"c{k} AS (SELECT v, CAST(floor(coalesce(sum(n) OVER (ORDER BY v NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * {full}.0 / (SELECT count(*) FROM documents)) AS INTEGER) AS b FROM (SELECT {c} AS v, count(*) AS n FROM documents GROUP BY {c}))")
        names.append(f"CASE WHEN {c} IS NULL THEN 0 ELSE c{k}.b END AS b{k}")
    joins = " ".join(f"LEFT JOIN c{k} ON c{k}.v = documents.{c}" for k, c in enumerate(params.columns))
    parts.append(f"l{params.bits} AS (SELECT doc_id, greatest(coalesce({params.size}, 0), 0) AS w, {', '.join(names)}, 0 AS state, 0::BIGINT AS h FROM documents {joins})")
    keep = "doc_id, w, " + ", ".join(f"b{k}" for k in range(n))
    for level in range(params.bits - 1, -1, -1):
        corner = " + ".join(f"((b{k} >> {level}) & 1) * {1 << k}" for k in range(n))
        at = f"state * {1 << n} + {corner} + 1"
        parts.append(f"l{level} AS (SELECT {keep}, ({after})[{at}] AS state, h * {1 << n} + ({place})[{at}] AS h FROM l{level + 1})")
    total = "coalesce(sum(w) OVER (ORDER BY h, doc_id NULLS FIRST, w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    return f"WITH {', '.join(parts)} SELECT doc_id, CAST(h AS BIGINT) AS hilbert, CAST(floor({total} / {params.target}.0) AS BIGINT) AS shard FROM l0"


QUERIES = {"op2_hilbert_shards": op2_hilbert_shards}
ORACLES = {"op2_hilbert_shards": _oracle()}
