"""Contracts for injected models, with deterministic doubles, and their registry.

A model is a plain callable or object; these helpers put it behind Arrow UDFs, made
once a Python worker and called a batch at a time. No weights come with the library.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


class Recognizer(Protocol):
    """Text of samples at a rate; ``finalize`` flushes what a stream still holds."""

    def recognize(self, samples: np.ndarray, rate: int) -> str: ...


class SpeechDetector(Protocol):
    """(start, end) seconds of speech in samples."""

    def detect(self, samples: np.ndarray, rate: int) -> list[tuple[float, float]]: ...


class Diarizer(Protocol):
    """Is it usable, and why not; (start, end, speaker) turns of samples."""

    def availability(self) -> tuple[bool, str]: ...

    def diarize(self, samples: np.ndarray, rate: int, speakers: int | None) -> list[tuple[float, float, str]]: ...


class Embedder(Protocol):
    """Voiceprint of samples."""

    def extract(self, samples: np.ndarray, rate: int) -> np.ndarray: ...


class Summarizer(Protocol):
    """Summary of a prompt, as a JSON-like dict."""

    def complete(self, prompt: str) -> dict: ...


_registry: dict[tuple[str, str], Callable[[], object]] = {}


def register(kind: str, name: str, factory: Callable[[], object]) -> None:
    """A factory, not an instance, so that each worker makes its own."""
    _registry[kind, name] = factory


def factory(kind: str, *names: str) -> Callable[[], object]:
    """First registered factory among the names, in order of preference."""
    for name in names:
        if (kind, name) in _registry:
            return _registry[kind, name]
    raise KeyError(f"no {kind} among {names}")


def recognized(samples: Column, make: Callable[[], Recognizer], fallback: Callable[[], Recognizer] | None = None, rate: int = 16_000) -> Column:
    """struct(text, error): the first model's text or, where it fails, the fallback's with the error noted."""
    kind = T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])

    @pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model, other = make(), fallback() if fallback else None
        for batch in batches:
            rows = []
            for x in batch:
                if x is None:
                    rows.append((None, None))
                    continue
                try:
                    rows.append((model.recognize(np.asarray(x, np.float32), rate), None))
                except Exception as e:  # injected models may fail in any way
                    text = other.recognize(np.asarray(x, np.float32), rate) if other else None
                    rows.append((text, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["text", "error"])

    return run(samples)


def speech_regions(audio: DataFrame, make: Callable[[], SpeechDetector], pre_ms: int = 250, post_ms: int = 450, rate: int = 16_000) -> DataFrame:
    """(record, start_ms, end_ms) from (record, samples): detected, padded, clipped and merged."""
    from confab.operators.timeline import pad_and_merge

    @pandas_udf("array<struct<start_ms:bigint,end_ms:bigint>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for batch in batches:
            found = [[] if x is None else model.detect(np.asarray(x, np.float32), rate) for x in batch]
            yield pd.Series([[{"start_ms": round(a * 1000), "end_ms": round(b * 1000)} for a, b in f] for f in found], dtype=object)

    total = F.round(F.size("samples") * 1000 / rate).cast("bigint")
    rows = audio.select("record", total.alias("total_ms"), F.explode(run(F.col("samples"))).alias("r")).select("record", "total_ms", "r.start_ms", "r.end_ms")
    return pad_and_merge(rows, pre_ms, post_ms, ["record"], "total_ms").drop("n")


def interval_text(audio: DataFrame, regions: DataFrame, make: Callable[[], Recognizer], pre_ms: int = 0, post_ms: int = 0, rate: int = 16_000) -> DataFrame:
    """(record, start_ms, end_ms, text, error): regions decoded with padding, reported without it; under 0.1 s skipped."""
    from confab.functions.acoustics import sliced_seconds

    wide = regions.where("end_ms - start_ms >= 100").join(audio, "record")
    cut = sliced_seconds(F.col("samples"), (F.col("start_ms") - pre_ms) / 1000, (F.col("end_ms") + post_ms) / 1000, rate)
    heard = wide.select("record", "start_ms", "end_ms", recognized(cut, make, rate=rate).alias("t"))
    return heard.select("record", "start_ms", "end_ms", "t.text", "t.error")


def voiceprints(pieces: DataFrame, make: Callable[[], Embedder], rate: int = 16_000) -> DataFrame:
    """(record, key, embedding): unit voiceprints of samples; null where empty, zero or not finite."""

    @pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for batch in batches:
            out = []
            for x in batch:
                v = np.asarray(model.extract(np.asarray(x, np.float32), rate), np.float64).ravel() if x is not None and len(x) else np.zeros(0)
                n = float(np.linalg.norm(v)) if len(v) else 0.0
                out.append((v / n).tolist() if n > 1e-8 and np.isfinite(n) else None)
            yield pd.Series(out, dtype=object)

    return pieces.select("record", "key", run(F.col("samples")).alias("embedding"))


class LoudnessDetector:
    """Double: speech is where 20 ms frames are loud."""

    def __init__(self, threshold: float = 0.012):
        self.threshold = threshold

    def detect(self, samples: np.ndarray, rate: int) -> list[tuple[float, float]]:
        size = rate // 50
        n = len(samples) // size
        loud = np.sqrt((samples[: n * size].reshape(n, size).astype(np.float64) ** 2).mean(1)) >= self.threshold
        edges = np.flatnonzero(np.diff(np.concatenate([[0], loud.astype(int), [0]])))
        return [(a * size / rate, b * size / rate) for a, b in edges.reshape(-1, 2)]


class LengthRecognizer:
    """Double: says how many milliseconds it heard."""

    def recognize(self, samples: np.ndarray, rate: int) -> str:
        return f"{round(len(samples) * 1000 / rate)}ms"


class StatisticsEmbedder:
    """Double: level and sign changes of the samples."""

    def extract(self, samples: np.ndarray, rate: int) -> np.ndarray:
        return np.array([np.abs(samples).mean(), np.mean(samples), (np.diff(np.sign(samples)) != 0).mean() if len(samples) > 1 else 0.0])


class FirstLinesSummarizer:
    """Double: the first line of the prompt's text as its overview."""

    def complete(self, prompt: str) -> dict:
        lines = [x for x in prompt.splitlines() if x.strip()]
        return {"overview": lines[-1][:200] if lines else "", "topics": [x[:40] for x in lines[1:3]]}


register("vad", "loudness", LoudnessDetector)
register("asr", "length", LengthRecognizer)
register("embedder", "statistics", StatisticsEmbedder)
register("summarizer", "first-lines", FirstLinesSummarizer)
