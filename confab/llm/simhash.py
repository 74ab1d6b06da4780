"""SimHash near-duplicates by exact search over parts of fingerprints.

Every text gets a 128-bit fingerprint: the sign, bit by bit, of the sum of the hashes
of its distinct words. The bits are cut into parts, seven for a radius of 20, and each
part into three subparts. Two fingerprints within the radius differ by two bits at most
in one of the parts, at least, and so agree in one of its subparts. Fingerprints are
therefore grouped by every subpart; within a group those whose part differs by no more
than two bits are looked up by all masks of so few bits, and numpy exclusive-or and bit
counts decide. No pair is lost, and about one in a hundred pairs is compared; a group of
so many like fingerprints that the masks would meet as many pairs as there are is compared
tile with tile. It answers with a spanning forest of the pairs within the radius, never
with all of them, so a family of thousands of copies costs rows in proportion to its
members; connected components of those edges are the groups.

Scale: the shuffle carries 21 rows of some 28 bytes a fingerprint, at any size. A group
longer than ``block`` is cut into blocks and each pair of blocks is compared. The pairs
that are compared still grow with the square of the fingerprints. Equal fingerprints are
compared once.

Edge cases: null ids and null or blank texts are in no group; texts without word
characters are hashed whole; very long texts are fingerprinted whole, in pieces; a bit
whose hashes tie is 0; rows that share an id are one document (they stay or go
together); of a group the least id stays; ids are integers, or texts of integers, and
any other id is an error; no documents give no rows; other columns, whatever their
names, are neither read nor lost.
"""

from __future__ import annotations

import itertools
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from confab.llm.texts import text_blocks
from confab.plans.components import connected_components
from confab.plans.lineage import cut_lineage
from confab.sources.tables import table

WORD = re.compile(r"\w+")
BITS = 128
STRIP = 64  # rows of a tile compared at once
SUBPARTS = 3  # of a part; a part that differs by fewer bits agrees in one of them
BATCH = 1 << 17  # look-ups, or pairs, at once
MAX_BROADCAST = 1_000_000  # ids of documents that go; beyond that they are joined with a shuffle of the texts


@dataclass(frozen=True)
class SimHashParams:
    radius: int = 20  # of 128 bits
    tile: int = 4096  # fingerprints a tile, compared in strips of rows that fit a core's cache
    block: int = 250_000  # most fingerprints a block of a group, and about as many rows a task
    min_blocks: int = 8  # least tasks, so that small inputs still spread over the cores
    dense: int = 12  # pairs that a tile compares in the time of one that is looked up


def fingerprint(text: str | None) -> tuple[int, int] | None:
    """Two signed 64-bit halves of the fingerprint; None for null or blank text."""
    if text is None or not text.strip():
        return None
    words = set(WORD.findall(text.lower())) or {text.strip()}
    raw = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint8).reshape(-1, BITS // 8)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(raw), 8192):
        ones += np.unpackbits(raw[at : at + 8192], axis=1).sum(0, dtype=np.int64)
    halves = np.packbits(2 * ones > len(raw)).view(np.int64)
    return int(halves[0]), int(halves[1])


@arrow_udf(T.StructType([T.StructField("h0", T.LongType()), T.StructField("h1", T.LongType())]))
def fingerprint_column(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        found = [fingerprint(t) or (None, None) for _, texts in text_blocks(batch) for t in texts]
        yield pa.StructArray.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["h0", "h1"])


def link(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the sets of ``labels`` (each row's least member) along the edges i-j, in place."""
    while len(i):
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up


def forest(h: np.ndarray, side: np.ndarray, radius: int, tile: int) -> np.ndarray:
    """Least row linked to each row of ``h`` (n x 2 uint64, any order).

    ``side`` is 0 or 1: rows of both sides are compared across; a block compared with
    itself has side 0 alone.
    """
    pops = np.bitwise_count(h).sum(1).astype(np.int64)
    order = np.lexsort((side, pops))
    labels = np.arange(len(h))
    one = order[side[order] == 0]
    two = order[side[order] == 1] if side.any() else None
    out = np.empty((min(STRIP, tile), tile), np.uint64)
    count = np.empty(out.shape, np.uint8)
    other = one if two is None else two
    for a in range(0, len(one), len(out)):
        rows = one[a : a + len(out)]
        left, lo, hi = h[rows], pops[rows[0]], pops[rows[-1]]
        for b in range(a // tile * tile if two is None else 0, len(other), tile):
            cols = other[b : b + tile]
            if pops[cols[0]] - hi > radius or lo - pops[cols[-1]] > radius:
                continue
            right = h[cols]
            x, c = out[: len(rows), : len(cols)], count[: len(rows), : len(cols)]
            np.bitwise_xor(left[:, 0][:, None], right[:, 0][None], out=x)
            np.bitwise_count(x, out=c)
            near = np.flatnonzero(c <= radius)
            if not len(near):
                continue
            i, j = np.divmod(near, len(cols))
            apart = labels[rows[i]] != labels[cols[j]]
            i, j = i[apart], j[apart]
            d = np.bitwise_count(left[i, 0] ^ right[j, 0]).astype(np.int64) + np.bitwise_count(left[i, 1] ^ right[j, 1])
            close = d <= radius
            link(labels, rows[i[close]], cols[j[close]])
    return labels


def parts_of(radius: int) -> list[list[tuple[int, int]]]:
    """Ranges of bits of the subparts of each part: so many parts that one differs by two bits at most."""
    parts = max(7, radius // SUBPARTS + 1)
    ends = [BITS * k // parts for k in range(parts + 1)]
    return [[(lo + (hi - lo) * k // SUBPARTS, lo + (hi - lo) * (k + 1) // SUBPARTS) for k in range(SUBPARTS)] for lo, hi in zip(ends, ends[1:])]


def masks_of(subparts: list[tuple[int, int]], sub: int, most: int) -> np.ndarray:
    """Differences of up to ``most`` bits of a part that agrees in subpart ``sub`` and in none before it."""
    end, found = subparts[-1][1], []
    spots = [(1 << (end - 1 - bit), k) for k, (lo, hi) in enumerate(subparts) if k != sub for bit in range(lo, hi)]
    for n in range(most + 1):
        for some in itertools.combinations(spots, n):
            if {k for _, k in some} >= set(range(sub)):
                found.append(sum(bit for bit, _ in some))
    return np.array(found, np.int64)


def bits_between(h: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Bits ``lo`` to ``hi`` (the first is the highest of h0) of each row of ``h`` (n x 2 uint64)."""
    if hi <= 64:
        found = h[:, 0] >> np.uint64(64 - hi)
    elif lo >= 64:
        found = h[:, 1] >> np.uint64(128 - hi)
    else:
        found = h[:, 0] << np.uint64(hi - 64) | h[:, 1] >> np.uint64(128 - hi)
    return (found & np.uint64((1 << (hi - lo)) - 1)).astype(np.int64)


def _column_between(lo: int, hi: int):
    """The same of the columns h0 and h1."""
    if hi <= 64:
        found = F.shiftrightunsigned("h0", 64 - hi)
    elif lo >= 64:
        found = F.shiftrightunsigned("h1", 128 - hi)
    else:
        found = F.shiftleft("h0", hi - 64).bitwiseOR(F.shiftrightunsigned("h1", 128 - hi))
    return found.bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("long")).cast("int")


def runs(one: np.ndarray, two: np.ndarray | None, masks: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of ``one``, first row, number of rows of the other side): those whose keys differ by a mask.

    Keys are sorted and below ``size``; without ``two`` pairs are within ``one``, each once.
    """
    starts = np.concatenate([[0], np.cumsum(np.bincount(one if two is None else two, minlength=size))])
    step = max(1, BATCH // max(1, len(masks)))
    for a in range(0, len(one), step):
        key = one[a : a + step]
        met = key[:, None] ^ masks
        first, n = starts[met], starts[met + 1] - starts[met]
        if two is None:
            own = np.arange(a, a + len(key))[:, None]
            n = np.where(masks == 0, starts[met + 1] - own - 1, np.where(met > key[:, None], n, 0))
            first = np.where(masks == 0, own + 1, first)
        row, which = np.nonzero(n)
        yield row + a, first[row, which], n[row, which]


def search(h: np.ndarray, side: np.ndarray, part: int, sub: int, params: SimHashParams) -> np.ndarray:
    """As ``forest``, for rows that agree in a subpart: those are linked whose part differs as ``masks_of`` says, at least."""
    subparts, radius = parts_of(params.radius)[part], params.radius
    masks = masks_of(subparts, sub, radius // len(parts_of(radius)))
    lo, hi = subparts[0][0], subparts[-1][1]
    keys = bits_between(h, lo, hi)
    order = np.lexsort((keys, side))
    cut = len(h) - int(side.sum())
    one, two = order[:cut], order[cut:] if cut < len(h) else None
    other = one if two is None else two
    labels = np.arange(len(h))
    counts = np.bincount(keys[other], minlength=1 << (hi - lo))
    some, times = np.unique(keys[one], return_counts=True)
    met = sum(int((times * counts[some ^ m]).sum()) for m in masks)
    if met * params.dense > len(one) * len(other) and len(one) * len(other) > BATCH:
        return forest(h, side, radius, params.tile)
    left, right = h[one], h[other]
    for rows, first, n in runs(keys[one], None if two is None else keys[two], masks, 1 << (hi - lo)):
        ends = np.cumsum(n)
        at = 0
        while at < len(rows):  # about BATCH pairs at once, a row's at least
            start = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, start + BATCH, side="right")))
            many = n[at:upto]
            col = np.arange(ends[upto - 1] - start) + np.repeat(first[at:upto] - (ends[at:upto] - many - start), many)
            near = np.flatnonzero(np.bitwise_count(np.repeat(left[rows[at:upto], 0], many) ^ right[col, 0]) <= radius)
            if len(near):
                i, j = rows[at + np.searchsorted(ends[at:upto] - start, near, side="right")], col[near]
                d = np.bitwise_count(left[i] ^ right[j]).sum(1, dtype=np.int64)
                link(labels, one[i[d <= radius]], other[j[d <= radius]])
            at = upto
    return labels


def _edges_of(params: SimHashParams):
    def edges(key: tuple, group: pa.Table) -> pa.Table:
        node = group["node"].to_numpy()
        h = np.stack([group["h0"].to_numpy(), group["h1"].to_numpy()], 1).view(np.uint64)
        labels = search(h, group["side"].to_numpy(), *divmod(key[0].as_py(), SUBPARTS), params)
        child = np.flatnonzero(labels != np.arange(len(labels)))
        return pa.table({"u": pa.array(node[child], pa.int64()), "v": pa.array(node[labels[child]], pa.int64())})

    return edges


def near_edges(prints: DataFrame, params: SimHashParams = SimHashParams()) -> DataFrame:
    """Spanning edges (u, v) of the pairs of ``prints`` (node, h0, h1) within the radius."""
    ranges = [r for part in parts_of(params.radius) for r in part]
    listed = prints.select("node", "h0", "h1", F.posexplode(F.array(*[_column_between(*r) for r in ranges])).alias("place", "value"))
    sizes = {(r["place"], r["value"]): r["count"] for r in listed.groupBy("place", "value").count().collect()}  # 21 x 128 rows at most
    values = 1 << max(hi - lo for lo, hi in ranges)
    cuts = [-(-sizes.get((p, v), 1) // params.block) for p in range(len(ranges)) for v in range(values)]
    rows = sum(n * -(-n // params.block) for n in sizes.values())
    tasks = min(max(params.min_blocks, -(-rows // params.block)), 20_000)
    placed = listed.withColumn("cuts", F.get(F.array(*map(F.lit, cuts)), F.col("place") * values + F.col("value")))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("h0", "h1"), F.col("cuts")).cast("int"))
    pairs = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("other")).select(
        "node", "h0", "h1", "place", "value",
        F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"),
        (F.col("block") > F.col("other")).cast("int").alias("side"),
    )
    by = ["place", "value", "a", "b"]
    return pairs.repartition(tasks, *by).groupBy(*by).applyInArrow(_edges_of(params), "u long, v long")


def near_duplicates(docs: DataFrame, params: SimHashParams = SimHashParams()) -> DataFrame:
    """(doc_id, duplicate_of): every document that is not the least of its group, with the one that is."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint_column("text").alias("h"))
    prints = cut_lineage(own.where("doc_id is not null").select("doc_id", "h.h0", "h.h1"), "prints")
    prints = prints.where("h0 is not null")  # not before: the condition would be pushed down and take all fingerprints twice
    nodes = cut_lineage(prints.groupBy("h0", "h1").agg(F.min("doc_id").alias("node")), "nodes")  # copies fold before the shuffle
    # a document that is the node of two fingerprints links what is near either of them
    roots = connected_components(near_edges(nodes, params))
    least = nodes.join(roots, "node", "left").select("h0", "h1", F.coalesce("root", "node").alias("duplicate_of"))
    return (
        prints.join(least, ["h0", "h1"])  # one row a fingerprint on one side: a hot one splits on the other
        .groupBy("doc_id")
        .agg(F.min("duplicate_of").alias("duplicate_of"))
        .where("doc_id <> duplicate_of")
    )


def drop_near_duplicates(docs: DataFrame, params: SimHashParams = SimHashParams()) -> DataFrame:
    """The documents with one left of each group, with all their columns."""
    own = f"gone_{uuid.uuid4().hex}"  # no column of the documents
    gone = cut_lineage(near_duplicates(docs, params).select(F.col("doc_id").alias(own)), "gone")
    if gone.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        gone = F.broadcast(gone)
    return docs.join(gone, docs["doc_id"].cast("long") == gone[own], "left_anti")


def op3_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op3_simhash_near_dedup": op3_simhash_near_dedup}
ORACLES: dict[str, str] = {}
