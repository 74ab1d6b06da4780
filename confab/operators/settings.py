"""Typed settings, profiles, model inventories and catalogs, as small tables and columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confab.functions.acoustics import clamped

#: name: (low, high, default)
RUNTIME = {
    "vad_threshold": (0.05, 0.95, 0.5), "vad_min_silence": (0.1, 5.0, 0.5), "vad_min_speech": (0.05, 2.0, 0.2), "pre_roll_ms": (0, 2000, 200), "endpoint_grace_ms": (0, 5000, 800), "tail_pad_ms": (0, 3000, 1000), "hotword_score": (0.1, 20.0, 5.0),
}
LLM = {"temperature": (0, 2, 0.3), "max_tokens": (256, 384_000, 8192), "timeout_sec": (10, 600, 120)}
CHOICES = {"profile": (("meeting", "dictation", "oncall"), "meeting"), "theme": (("light", "dark", "system"), "system"), "output_style": (("formal", "concise"), "formal"), "formula_mode": (("auto", "off"), "auto")}
LIVE_PROFILES = {"meeting": (0.5, 0.7, 0.25, 900), "dictation": (0.45, 0.5, 0.2, 600), "oncall": (0.6, 0.4, 0.15, 400)}
PROFILE_ALIASES = {"low_latency": "low-latency", "lowlatency": "low-latency", "fast": "low-latency", "default": "meeting", "high": "quality"}
FALLBACK = ("meeting", "balanced", "low-latency", "quality")


def normalized_settings(df: DataFrame, limits: dict[str, tuple[float, float, float]] = RUNTIME, choices: dict = CHOICES) -> DataFrame:
    """Numbers clamped and rounded, choices held to their list; unknown columns pass."""
    for name, (low, high, default) in limits.items():
        if name in df.columns:
            df = df.withColumn(name, clamped(F.col(name).cast("string"), low, high, default))
    for name, (allowed, default) in choices.items():
        if name in df.columns:
            df = df.withColumn(name, choice(F.col(name), allowed, default))
    return df


def choice(c: Column, allowed: tuple[str, ...], default: str) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low.isin(*allowed), low).otherwise(default)


def resolved_profile(name: Column) -> Column:
    low = F.replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), F.lit("_"), F.lit("-"))
    table = F.create_map(*[F.lit(x) for k, v in PROFILE_ALIASES.items() for x in (k.replace("_", "-"), v)])
    known = F.coalesce(F.try_element_at(table, low), low)
    return F.when(known.isin(*FALLBACK), known).otherwise("meeting")


def available_profile(wanted: Column, installed: Column) -> Column:
    """Wanted profile if its model is there, else the first of the fallbacks that is; null if none."""
    order = F.array(resolved_profile(wanted), *map(F.lit, FALLBACK))
    return F.get(F.filter(order, lambda p: F.array_contains(installed, p)), F.lit(0))


def missing_files(required: DataFrame, listed: DataFrame) -> DataFrame:
    """(model, file) required but not listed."""
    return required.join(listed.select("model", "file"), ["model", "file"], "left_anti")


def complete_models(required: DataFrame, listed: DataFrame) -> DataFrame:
    gone = missing_files(required, listed).select("model").distinct()
    return required.select("model").distinct().join(gone, "model", "left_anti")


def enabled_words(words: Column) -> Column:
    """Map of the enabled words of array<struct<text,score,enabled>> to their scores; the first of equals wins."""
    on = F.filter(words, lambda w: w["enabled"])
    names = F.array_distinct(F.transform(on, lambda w: w["text"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.get(F.filter(on, lambda w: w["text"] == n), F.lit(0))["score"]))


def model_choice(catalog: DataFrame, provider: str, model: str | None = None) -> DataFrame:
    """Row of the wanted model, or the provider's default."""
    own = catalog.where(F.col("provider") == provider)
    return own.orderBy(F.desc(F.col("model") == F.lit(model or "")), F.desc("is_default"), "model").limit(1)


def normalized_job(df: DataFrame) -> DataFrame:
    """Upload job rows with typed defaults and progress within 0..1."""
    progress = F.least(F.greatest(F.coalesce(F.col("progress").cast("string").try_cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return df.select(F.coalesce("file_id", F.lit("")).alias("file_id"), F.coalesce("filename", F.lit("")).alias("filename"), F.coalesce("status", F.lit("queued")).alias("status"), progress.alias("progress"))


def duration_buckets(utterances: DataFrame, buckets: int, max_batch: float) -> DataFrame:
    """(bucket, batch): equally filled duration buckets, each cut into batches of bounded total duration.

    Bucket edges are quantiles, so no window spans the table; running sums are a bucket's own.
    """
    from pyspark.sql import Window

    edges = utterances.stat.approxQuantile("duration", [k / buckets for k in range(1, buckets)], 0.001)
    bucket = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col("duration"))) if edges else F.lit(0)
    order = Window.partitionBy("bucket").orderBy("duration", "id").rowsBetween(Window.unboundedPreceding, 0)
    return utterances.withColumn("bucket", bucket).withColumn("batch", F.floor((F.sum("duration").over(order) - 1e-9) / max_batch))
