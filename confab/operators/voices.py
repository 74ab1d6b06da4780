"""Voiceprints: verification, prototypes and clustering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

MAX_BROADCAST_VOICES = 50_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    """Unit vector, or null for an empty, zero or non-finite one."""
    n = norm(a)
    return F.when((F.size(a) > 0) & (n > 1e-8) & (n < float("inf")), F.transform(a, lambda x: (x / n).cast("double")))


def verify_speaker(probes: DataFrame, registered: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(vec_id, speaker, similarity): most similar registered voice; none where it isn't above the threshold.

    Registered voices are few; their number is checked before they travel with the tasks as
    a matrix, and a batch of probes is one product with it: no join, shuffle or sort. More of
    them are cut into slices by hash, joined slice by slice key, and the best of the
    slices wins, so no side is ever sent whole. Of equally similar voices the least speaker
    wins; vectors with a null, or as long as no voice, are like none.
    """
    voices = registered.select(F.col("speaker"), F.col("embedding").alias("_ref"))
    count = voices.count()
    if count <= MAX_BROADCAST_VOICES:
        return _nearest(probes, voices, threshold)
    slices = -(-count // MAX_BROADCAST_VOICES)
    left = probes.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    pairs = left.join(voices.withColumn("_slice", F.pmod(F.xxhash64("speaker"), F.lit(slices)).cast("int")), "_slice")
    scored = pairs.select("vec_id", "speaker", dot(F.col("embedding"), F.col("_ref")).alias("sim"))
    best = scored.groupBy("vec_id").agg(F.min(F.struct(-F.col("sim"), "speaker")).alias("b"))
    sim = F.greatest(-F.col("b.col1"), F.lit(0.0))
    return best.select("vec_id", F.when(sim > threshold, F.col("b.speaker")).alias("speaker"), sim.alias("similarity"))


def _nearest(probes: DataFrame, voices: DataFrame, threshold: float) -> DataFrame:
    """A row a probe; ``voices`` (speaker, _ref) fit in a task."""
    kind = T.StructType([probes.schema["vec_id"], T.StructField("speaker", voices.schema["speaker"].dataType), T.StructField("similarity", T.DoubleType())])
    arrow = to_arrow_schema(kind)
    held: dict[int, tuple[list, list]] = {}
    for speaker, ref in voices.where("_ref is not null and speaker is not null").orderBy("speaker").collect():
        names, refs = held.setdefault(len(ref), ([], []))
        names.append(speaker)
        refs.append(ref)
    known = {n: (names, np.array(refs, float)) for n, (names, refs) in held.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1)
            lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
            speakers: list = [None] * len(vectors)
            best = np.zeros(len(vectors))
            for n, (names, refs) in known.items():
                own = np.flatnonzero(lengths == n)
                for at in range(0, len(own), max(1, (1 << 22) // len(names))):
                    some = own[at : at + max(1, (1 << 22) // len(names))]
                    flat = vectors.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False)
                    sim = np.nan_to_num(flat.astype(float).reshape(len(some), n) @ refs.T, nan=-np.inf)
                    top = sim.argmax(1)
                    best[some] = np.maximum(sim[np.arange(len(some)), top], 0)
                    for row, k in zip(some.tolist(), top.tolist()):
                        if best[row] > threshold:
                            speakers[row] = names[k]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(speakers, arrow.field(1).type), pa.array(best)], schema=arrow)

    return probes.select("vec_id", "embedding").mapInArrow(run, kind)


def average_linkage(unit: np.ndarray, cut: float | None = None, clusters: int | None = None) -> np.ndarray:
    """Cluster of each unit vector by average linkage on cosine distance.

    Merges go on while the nearest clusters are within ``cut``, or until ``clusters``
    remain; ties take the pair that comes first.
    """
    n = len(unit)
    labels = np.arange(n)
    if n == 0:
        return labels
    d = 1 - unit @ unit.T
    np.fill_diagonal(d, np.inf)
    size, alive = np.ones(n), n
    while alive > 1 and (clusters is None or alive > max(1, clusters)):
        k = int(d.argmin())
        i, j = divmod(k, n)
        if i > j:
            i, j = j, i
        if clusters is None and d[i, j] > cut + 1e-12:
            break
        d[i] = np.where(np.isinf(d[i]), np.inf, (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j]))
        d[i, i] = np.inf
        d[:, i] = d[i]
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        labels[labels == j] = i
        alive -= 1
    return np.unique(labels, return_inverse=True)[1]


def cluster_prototypes(prototypes: DataFrame, threshold: float = 0.75, clusters: int | None = None) -> DataFrame:
    """(record, key, name): SPEAKER_00 and on, numbered by first appearance.

    ``prototypes`` has record, key, first_ms and embedding; a key without one is a
    cluster of its own, unless the number of speakers is given: then it is an error.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["first_ms", "key"], ignore_index=True)
        good = [k for k, e in enumerate(pdf["embedding"]) if e is not None]
        if clusters is not None and (len(good) < len(pdf) or clusters > len(good)):
            raise ValueError("a known number of speakers needs as many usable voiceprints")
        cluster = {}
        if good:
            unit = np.stack([np.asarray(pdf["embedding"][k], np.float64) for k in good])
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            cluster = dict(zip(good, average_linkage(unit, max(0.0, 1 - threshold), clusters).tolist()))
        order: dict = {}
        names = [f"SPEAKER_{order.setdefault(cluster.get(k, ('own', k)), len(order)):02d}" for k in range(len(pdf))]
        return pd.DataFrame({"record": pdf["record"], "key": pdf["key"], "name": names})

    kind = f"record {prototypes.schema['record'].dataType.simpleString()}, key string, name string"
    return prototypes.select("record", "key", "first_ms", "embedding").groupBy("record").applyInPandas(fold, kind)
