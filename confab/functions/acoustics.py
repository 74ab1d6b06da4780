"""Signal arrays and acoustic scores.

Scores of numbers are Columns. What needs whole sample arrays is numpy over Arrow
batches; the frame statistics exist in SQL form too, for sample tables.
"""

from __future__ import annotations

import base64
import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

RATE = 16_000


# Columns


def scene(snr: Column, rt60: Column) -> Column:
    """Acoustic scene from noise and reverberation."""
    large = F.when(snr < 10, "大型会议室(高混响+噪声)").otherwise("报告厅(高混响)")
    middle = F.when(snr < 12, "中型会议室(中混响+噪声)").otherwise("中型会议室")
    small = F.when(snr < 8, "嘈杂环境(低SNR)").when(snr < 18, "普通室内(中SNR)").otherwise("安静室内")
    return F.when(rt60 > 1, large).when(rt60 > 0.5, middle).otherwise(small)


def _unit(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def quality_score(snr: Column, rt60: Column, overlap: Column | float = 0.0) -> Column:
    """Half signal to noise, three tenths dryness, a fifth freedom from overlap."""
    share = overlap if isinstance(overlap, Column) else F.lit(float(overlap))
    return 0.5 * _unit(snr / 30) + 0.3 * _unit(1 - (rt60 - 0.2) / 1.8) + 0.2 * (1 - share)


def quality_label(score: Column) -> Column:
    return F.when(score > 0.7, "high").when(score > 0.4, "medium").otherwise("low")


def asr_confidence(score: Column) -> Column:
    return F.greatest(F.lit(0.4), score * 0.9)


def uncertainty(snr: Column, rt60: Column, overlap: Column, confidence: Column, out_of_domain: Column | bool = False) -> Column:
    """struct(total, aleatoric, epistemic, asr, level, action, calibrated)."""
    strange = out_of_domain if isinstance(out_of_domain, Column) else F.lit(out_of_domain)
    noise = F.when(snr < 5, 0.40).when(snr < 12, 0.25).when(snr < 20, 0.10).otherwise(0.0)
    echo = F.when(rt60 > 1.2, 0.15).when(rt60 > 0.7, 0.08).otherwise(0.0)
    aleatoric = noise + echo + overlap * 0.2
    epistemic = F.when(strange, 0.2).otherwise(0.0)
    heard = F.greatest(F.lit(0.0), 1 - confidence) * 0.5
    total = F.least(F.lit(1.0), aleatoric + epistemic + heard)
    bands = ((0.15, "L0_高确信", "静默接受"), (0.40, "L1_中确信", "接受并标记"), (0.65, "L2_低确信", "主动确认"))
    level, action = F.lit("L3_极低确信"), F.lit("请求复述/拒绝")
    for bound, name, what in reversed(bands):
        level, action = F.when(total < bound, name).otherwise(level), F.when(total < bound, what).otherwise(action)
    return F.struct(total.alias("total"), aleatoric.alias("aleatoric"), epistemic.alias("epistemic"), heard.alias("asr"), level.alias("level"), action.alias("action"), F.greatest(F.lit(0.0), 1 - total).alias("calibrated"))


def uncertain_spans(text: Column, snr: Column) -> Column:
    """Words of one or two characters in noise below 8 dB: array of struct(start, end, text, confidence)."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    spans = F.transform(words, lambda w, i: F.struct(i.alias("start"), (i + 1).alias("end"), w.alias("text"), F.greatest(F.lit(0.4), snr / 20).alias("confidence")))
    return F.when(snr < 8, F.filter(spans, lambda s: F.length(s["text"]) <= 2)).otherwise(F.filter(spans, lambda s: F.lit(False)))


def clamped(c: Column, low: float, high: float, default: float, places: int = 3) -> Column:
    """Number kept within bounds and rounded; anything else is the default."""
    return F.round(F.least(F.greatest(F.coalesce(c.try_cast("double"), F.lit(float(default))), F.lit(float(low))), F.lit(float(high))), places)


def mixed_down(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: (a + b) / 2)


def valid_samples(samples: Column) -> Column:
    """Samples kept within -1..1; null if any is missing or not finite."""
    fine = F.forall(samples, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, F.transform(samples, lambda x: F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0))))


def sliced_seconds(samples: Column, start: Column, end: Column, rate: int = RATE) -> Column:
    a = F.least(F.greatest(F.round(start * rate), F.lit(0)), F.size(samples)).cast("int")
    b = F.least(F.greatest(F.round(end * rate), a), F.size(samples)).cast("int")
    return F.slice(samples, a + 1, b - a)


def windows(samples: Column, size: int = 512, tail: int = 0) -> Column:
    """Fixed windows; the remainder is dropped after ``tail`` zeros are appended."""
    padded = F.concat(samples, F.array_repeat(F.lit(0.0), tail)) if tail else samples
    n = F.floor(F.size(padded) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice(padded, k * size + 1, F.lit(size)))).otherwise(F.array().cast("array<array<double>>"))


def rms(samples: Column) -> Column:
    n = F.greatest(F.size(samples), F.lit(1))
    return F.sqrt(F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x) / n)


def peak(samples: Column) -> Column:
    return F.aggregate(samples, F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x.cast("double"))))


def smoothed_levels(levels: Column, attack: float = 0.65, release: float = 0.14) -> Column:
    """Fast rise, slow fall: an array of the levels so filtered."""
    start = F.struct(F.lit(0.0).alias("level"), F.array().cast("array<double>").alias("out"))

    def step(acc, x):
        moved = acc["level"] + (x - acc["level"]) * F.when(x > acc["level"], attack).otherwise(release)
        return F.struct(moved.alias("level"), F.concat(acc["out"], F.array(moved)).alias("out"))

    return F.aggregate(levels, start, step, lambda a: a["out"])


# Sample tables (stream, i, x): one row a sample


def frame_levels(samples: DataFrame, size: int) -> DataFrame:
    """(stream, frame, rms, peak, mean_abs, power) of fixed frames; the remainder is dropped."""
    cut = samples.withColumn("frame", F.floor(F.col("i") / size))
    levels = cut.groupBy("stream", "frame").agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.max(F.abs("x")).alias("peak"), F.avg(F.abs("x")).alias("mean_abs"), F.avg(F.col("x") * F.col("x")).alias("power"), F.count("*").alias("_n"))
    return levels.where(F.col("_n") == size).drop("_n")


def snr_of_frames(levels: DataFrame) -> DataFrame:
    """(stream, snr): frames above the median level against the others, 0..60 dB, 30 where it can't tell."""
    middle = levels.groupBy("stream").agg(F.median("mean_abs").alias("mid"), F.count("*").alias("n"))
    loud = F.col("mean_abs") > F.col("mid")
    powers = levels.join(middle, "stream").groupBy("stream").agg(F.avg(F.when(loud, F.col("power"))).alias("s"), F.avg(F.when(~loud, F.col("power"))).alias("q"), F.max("n").alias("n"))
    snr = F.least(F.lit(60.0), F.greatest(F.lit(0.0), 10 * F.log10(F.col("s") / F.col("q"))))
    bad = (F.col("n") < 2) | F.col("s").isNull() | F.col("q").isNull() | (F.col("q") < 1e-10)
    return powers.select("stream", F.when(bad, 30.0).otherwise(snr).alias("snr"))


def decay_of_frames(levels: DataFrame) -> DataFrame:
    """(stream, frame, db): energy left from each frame on, in dB from the loudest frame's."""
    top = levels.groupBy("stream").agg(F.max_by("frame", F.struct("power", -F.col("frame"))).alias("top"))
    after = levels.join(top, "stream").where("frame >= top")
    left = F.sum("power").over(Window.partitionBy("stream").orderBy(F.desc("frame")).rowsBetween(Window.unboundedPreceding, 0))
    db = 10 * F.log10(F.greatest(left, F.lit(1e-10)))
    return after.withColumn("_db", db).withColumn("db", F.col("_db") - F.max("_db").over(Window.partitionBy("stream"))).select("stream", "frame", "db")


def pre_roll(samples: DataFrame, n: int) -> DataFrame:
    """The last ``n`` samples before each onset row (``onset`` true)."""
    order = Window.partitionBy("stream").orderBy("i").rowsBetween(-n, -1)
    return samples.withColumn("pre_roll", F.collect_list("x").over(order)).where("onset").select("stream", "i", "pre_roll")


# Arrays in numpy


def estimate_snr(x: np.ndarray, rate: int = RATE) -> float:
    size = int(rate * 0.02)
    n = len(x) // size
    if n < 2:
        return 30.0
    frames = np.asarray(x[: n * size], np.float64).reshape(n, size)
    level = np.abs(frames).mean(1)
    loud = level > np.median(level)
    if loud.all() or not loud.any():
        return 30.0
    signal, noise = (frames[loud] ** 2).mean(), (frames[~loud] ** 2).mean()
    return 30.0 if noise < 1e-10 else float(np.clip(10 * np.log10(signal / noise), 0, 60))


def estimate_rt60(x: np.ndarray, rate: int = RATE) -> float:
    size = int(rate * 0.01)
    if len(x) < rate:
        return 0.3
    n = len(x) // size
    power = (np.asarray(x[: n * size], np.float64).reshape(n, size) ** 2).mean(1)
    top = int(power.argmax())
    if power[top] < 1e-10:
        return 0.3
    left = 10 * np.log10(np.maximum(power[top:][::-1].cumsum()[::-1], 1e-10))
    fallen = np.flatnonzero(left - left[0] < -60)
    at = fallen[0] if len(fallen) else len(left) - 1
    return float(np.clip(at * 0.01, 0.1, 3.0))


def resample_linear(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    if rate == to or not len(x):
        return np.asarray(x, np.float32)
    n = round(len(x) * to / rate)
    return np.interp(np.arange(n) / n, np.arange(len(x)) / len(x), x).astype(np.float32)


def resample_bucket_mean(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Mean of the source samples that fall into each target sample."""
    n = int(len(x) * to / rate)
    edges = np.minimum(np.round(np.arange(n + 1) * rate / to).astype(int), len(x))
    sums = np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)])
    return ((sums[edges[1:]] - sums[edges[:-1]]) / np.maximum(1, np.diff(edges))).astype(np.float32)


def resample_polyphase(x: np.ndarray, rate: int, to: int, half: int = 16) -> np.ndarray:
    """Windowed-sinc resampling by the ratio of the rates.

    Only the samples asked for are computed: those that share a phase share their taps, so
    each phase is one product of strided windows with them.
    """
    g = np.gcd(rate, to)
    up, down = to // g, rate // g
    if up == down:
        return np.asarray(x, np.float32)
    width = half * max(up, down)
    t = np.arange(-width, width + 1) / max(up, down)
    taps = np.sinc(t) * np.kaiser(len(t), 8.0) * up / max(up, down)
    lead = width // up + 1
    out = np.empty(-(-len(x) * up // down))
    reach = np.arange(-lead, lead + 1)
    padded = np.concatenate([np.zeros(lead), x, np.zeros(lead + 1)])
    around = np.lib.stride_tricks.sliding_window_view(padded, 2 * lead + 1)
    for m in range(min(up, len(out))):  # m, m + up, ... have the same phase
        first, phase = divmod(m * down, up)
        at = width + phase - reach * up
        own = np.where((at >= 0) & (at <= 2 * width), taps[np.clip(at, 0, 2 * width)], 0)
        out[m::up] = around[first::down][: len(out[m::up])] @ own
    return out.astype(np.float32)


def pcm_to_float(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, "<i2").astype(np.float32) / 32768.0


def float_to_pcm(x: np.ndarray, asymmetric: bool = False) -> bytes:
    """16-bit samples; the browser's form scales negative ones by 32768."""
    x = np.clip(np.asarray(x, np.float64), -1, 1)
    scaled = np.where(x < 0, x * 32768, x * 32767) if asymmetric else x * 32767
    return np.trunc(scaled).astype("<i2").tobytes()


def to_wav(x: np.ndarray, rate: int = RATE, normalize: bool = True) -> bytes:
    """RIFF file of the samples, brought to full scale if they exceed it or on request."""
    x = np.asarray(x, np.float64)
    top = np.abs(x).max() if len(x) else 0
    if normalize and top > 0:
        x = x / top * 0.95
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(float_to_pcm(x))
    return out.getvalue()


def from_wav(payload: bytes, target: int = RATE) -> tuple[np.ndarray, int]:
    """Mono samples at the target rate, and the file's own rate."""
    with wave.open(io.BytesIO(payload)) as f:
        rate, channels, width, raw = f.getframerate(), f.getnchannels(), f.getsampwidth(), f.readframes(f.getnframes())
    if width == 2:
        x = np.frombuffer(raw, "<i2") / 32768.0
    elif width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    elif width == 4:
        x = np.frombuffer(raw, "<i4") / 2147483648.0
    else:
        raise ValueError(f"samples of {width} bytes")
    mono = x.reshape(-1, channels).mean(1)
    return np.clip(resample_polyphase(mono, rate, target) if rate != target else mono, -1, 1).astype(np.float32), rate


def array_udf(function: Callable[[np.ndarray], float]) -> Callable[[Column], Column]:
    """Arrow UDF of a function of one sample array; null stays null."""

    @pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if x is None else float(function(np.asarray(x, np.float32))) for x in batch], dtype="float64")

    return run


def snr(samples: Column) -> Column:
    return array_udf(estimate_snr)(samples)


def rt60(samples: Column) -> Column:
    return array_udf(estimate_rt60)(samples)


def bytes_udf(function: Callable[[object], object], kind: T.DataType) -> Callable[[Column], Column]:
    """Arrow UDF that answers null where the function fails on a value."""

    @pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for value in batch:
                try:
                    out.append(None if value is None else function(value))
                except (ValueError, EOFError, wave.Error):
                    out.append(None)
            yield pd.Series(out, dtype=object)

    return run


def decoded_pcm(payload: Column) -> Column:
    return bytes_udf(lambda b: pcm_to_float(bytes(b)).tolist(), T.ArrayType(T.FloatType()))(payload)


def decoded_wav(payload: Column, target: int = RATE) -> Column:
    return bytes_udf(lambda b: from_wav(bytes(b), target)[0].tolist(), T.ArrayType(T.FloatType()))(payload)


def encoded_wav(samples: Column, rate: int = RATE) -> Column:
    """Base64 of the samples as a file."""
    return bytes_udf(lambda x: base64.b64encode(to_wav(np.asarray(x), rate)).decode(), T.StringType())(samples)


def blob_of(text: Column) -> Column:
    """Bytes of base64 text or of a data URL; null where it is neither."""
    return F.try_to_binary(F.regexp_replace(text, r"^data:[\w/+.;=-]*,", ""), F.lit("base64"))


def mime_of(text: Column, default: str = "audio/wav") -> Column:
    found = F.regexp_extract(text, r"^data:([\w.+-]+/[\w.+-]+)", 1)
    return F.when(found != "", found).otherwise(default)
