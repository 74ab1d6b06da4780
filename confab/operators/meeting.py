"""The offline meeting pipeline: from segments and raw turns to attributed, clean text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confab.operators import store as S
from confab.operators import timeline as T
from confab.plans.lineage import cut_lineage


CLIPS = 100_000  # more than a segment has pieces


def speaker_timeline(turns: DataFrame, gap: int = 500) -> DataFrame:
    """Smoothed turns with their overlaps marked."""
    return T.mark_overlaps(T.smooth_timeline(turns, gap))


def stitched_turns(local: DataFrame, names: DataFrame | None = None, gap: int = 500) -> DataFrame:
    """Turns of all chunks in record time under global names, smoothed and marked.

    ``names`` maps (record, key) to names, as clustering of voiceprints gives them; without
    it the speakers of chunks are matched by their own names.
    """
    turns = cut_lineage(T.restore_global_time(local), "turns")
    named = T.global_names(turns) if names is None else names.withColumnRenamed("key", "speaker")
    return speaker_timeline(T.remap_speakers(turns, named), gap)


def attribute(segments: DataFrame, turns: DataFrame | None, decode: Callable[[Column, Column, Column], Column] | None = None) -> DataFrame:
    """(record, idx, clip, speaker, confidence, start_ms, end_ms, text): who said what.

    Without turns every segment stays under UNKNOWN. With ``decode``, an injected
    recogniser, segments across a change of speaker are decoded again piece by piece,
    unless that would lose text. Texts repeated at boundaries are cut last.
    """
    base = segments.select("record", "idx", "start_ms", "end_ms", "text")
    turns = None if turns is None else cut_lineage(turns, "turns")  # read by several joins
    if turns is None:
        said = base.withColumns({"clip": F.lit(0).cast("bigint"), "speaker": F.lit("UNKNOWN"), "confidence": F.lit(0).cast("bigint")})
    else:
        aligned = T.align_speakers(base, turns).select("record", "idx", "speaker", "confidence")
        said = base.join(aligned, ["record", "idx"]).withColumn("clip", F.lit(0).cast("bigint"))
        if decode is not None:
            clips = T.boundary_clips(base, turns)
            again = T.redecode(said.drop("clip", "confidence"), clips, decode)
            said = again.join(aligned.select("record", "idx", "confidence"), ["record", "idx"])
    said = said.withColumn("_at", F.col("idx") * CLIPS + F.col("clip"))
    clean = T.deduplicate_adjacent(said.select("record", F.col("_at").alias("idx"), "text")).withColumnRenamed("idx", "_at")
    return said.drop("text").join(clean, ["record", "_at"]).drop("_at")


def meeting_report(said: DataFrame) -> DataFrame:
    """Transcript, duration and speakers of each record."""
    return S.record_report(cut_lineage(said, "said").withColumn("idx", F.col("idx") * CLIPS + F.col("clip")))
