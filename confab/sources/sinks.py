"""Sinks: recordings, transcripts, statistics, downloads."""

from __future__ import annotations

import json
import os
import re
import wave
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confab.functions import acoustics as A


def safe_id(name: str) -> str:
    """Identifier usable as a file name."""
    out = re.sub(r"[^A-Za-z0-9_-]+", "_", name).strip("_")
    if not out:
        raise ValueError("the identifier has no usable characters")
    return out[:120]


class Recording:
    """16-bit file that appears under its name only when finished; an aborted one stays as ``.part``."""

    def __init__(self, folder: str, stream: str, rate: int = A.RATE):
        self.path = os.path.join(folder, safe_id(stream) + ".wav")
        if os.path.exists(self.path):
            raise FileExistsError(self.path)
        os.makedirs(folder, exist_ok=True)
        self.part, self.rate, self.samples = self.path + ".part", rate, 0
        self._file = wave.open(self.part, "wb")  # noqa: SIM115
        self._file.setparams((1, 2, rate, 0, "NONE", ""))

    def append(self, pcm: bytes) -> None:
        self._file.writeframes(pcm)
        self.samples += len(pcm) // 2

    def finalize(self) -> str:
        self._file.close()
        os.replace(self.part, self.path)
        return self.path

    def abort(self) -> str:
        self._file.close()
        return self.part


def assemble_recordings(frames: DataFrame) -> DataFrame:
    """(stream, samples, wav): whole recordings from (stream, seq, samples), frames in order, as binary files."""
    ordered = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "samples"))), lambda f: f["samples"]))
    joined = frames.where("samples is not null").groupBy("stream").agg(ordered.alias("x"))
    return joined.select("stream", F.size("x").alias("samples"), F.unbase64(A.encoded_wav(F.col("x"))).alias("wav"))


def write_results(results: DataFrame, path: str, order: list[str]) -> None:
    """results (JSON), transcript and statistics folders; Spark's committer makes each appear whole."""
    results.write.mode("errorifexists").json(f"{path}/results")
    clock = lambda ms: F.format_string("%02d:%02d", F.floor(ms / 60000).cast("int"), F.floor(ms / 1000 % 60).cast("int"))
    line = F.concat(F.lit("["), clock(F.col("start_ms")), F.lit(" - "), clock(F.col("end_ms")), F.lit("] "), F.coalesce("speaker", F.lit("UNKNOWN")), F.lit(": "), F.coalesce("text", F.lit("")))
    results.orderBy(*order).select(line.alias("value")).write.mode("errorifexists").text(f"{path}/transcript")
    stats = results.agg(F.count("*").alias("segments"), F.sum(F.length("text")).alias("chars"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), F.count_distinct("speaker").alias("speakers"))
    stats.select(F.to_json(F.struct("*")).alias("value")).write.mode("errorifexists").text(f"{path}/stats")


def write_error_report(report: DataFrame, path: str) -> None:
    """Word error table, best first, one line a group."""
    group = report.columns[0]
    line = F.concat_ws("\t", F.col(group).cast("string"), F.format_string("%.2f", F.col("wer") * 100))
    report.orderBy("wer", group).select(line.alias("value")).write.mode("errorifexists").text(path)


def disposition(title: Column, extension: str) -> Column:
    """Content-Disposition with an ASCII name and the full one as UTF-8."""
    plain = F.regexp_replace(F.regexp_replace(title, r'[\\/:*?"<>|\r\n]+', "_"), "[^ -~]", "_")
    full = F.concat(F.regexp_replace(title, r'[\\/:*?"<>|\r\n]+', "_"), F.lit(f".{extension}"))
    return F.concat(F.lit('attachment; filename="'), plain, F.lit(f".{extension}\"; filename*=UTF-8''"), F.replace(F.url_encode(full), F.lit("+"), F.lit("%20")))


def parsed_filename(header: Column) -> Column:
    """File name of a Content-Disposition header, the UTF-8 one first."""
    star = F.regexp_extract(header, r"filename\*=UTF-8''([^;]+)", 1)
    plain = F.regexp_extract(header, r'filename="?([^";]+)"?', 1)
    return F.when(star != "", F.try_url_decode(star)).when(plain != "", plain)


def source_digest(content: Column) -> Column:
    return F.sha2(content, 256)


def save_json(path: str, value: object) -> None:
    """Settings file, written beside and moved over the old one."""
    part = f"{path}.part"
    with open(part, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2)
    os.replace(part, path)


def load_json(path: str, default: object) -> object:
    """Settings file; a missing or broken one gives the default."""
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except (OSError, ValueError):
        return default


def ordered_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that hands micro-batches to ``write`` in order; a batch already written is skipped by its id."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
