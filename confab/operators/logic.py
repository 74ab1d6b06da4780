"""Consistency checks over statements and the per-segment enhancement pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confab.functions import acoustics as A
from confab.functions import cleanup as C

COMPARED = ("result", "total", "calculated_total")


def parse_numeric(text: Column) -> Column:
    """First run of digits and points as a number; units are ignored, no number gives null."""
    return F.regexp_extract(text, r"[\d.]+", 0).try_cast("double")


def data_points(text: Column) -> Column:
    """Array of struct(value, type): percentages, amounts, then whole numbers above 10.

    A number before a unit counts as an amount and, if whole and of two digits or more,
    again as a number.
    """
    made = lambda values, kind: F.transform(values, lambda v: F.struct(v.alias("value"), F.lit(kind).alias("type")))
    percent = F.regexp_extract_all(text, F.lit(r"([0-9]+(?:[.][0-9]+)?\s*%)"), 1)
    amount = F.regexp_extract_all(text, F.lit(r"([0-9]+(?:[.][0-9]+)?\s*[万亿元])"), 1)
    whole = F.regexp_extract_all(text, F.lit(r"(?<![0-9])([0-9]{2,})(?![0-9]|[.]?[0-9]*%)"), 1)
    numbers = F.transform(F.filter(whole, lambda w: w.try_cast("decimal(38,0)") > 10), lambda w: w.try_cast("decimal(38,0)").cast("string"))
    return F.concat(made(percent, "percentage"), made(amount, "amount"), made(numbers, "number"))


def data_conflicts(points: DataFrame, tolerance: float = 0.20) -> DataFrame:
    """(meeting, seq, prev_seq, type, value, prev_value, percent): each claim against every earlier of its type.

    ``points`` has meeting, seq, type and value (text). The pairs are those of one
    meeting and type, an equi join; conflicts are what the method asks to list.
    """
    typed = points.where(F.col("type").isin(*COMPARED)).withColumn("value", parse_numeric(F.col("value"))).where("value is not null").select("meeting", "seq", "type", "value")
    earlier = typed.select("meeting", "type", F.col("seq").alias("prev_seq"), F.col("value").alias("prev_value"))
    percent = F.abs(F.col("value") - F.col("prev_value")) / F.greatest(F.col("prev_value"), F.lit(1.0)) * 100
    return typed.join(earlier, ["meeting", "type"]).where("prev_seq < seq").withColumn("percent", percent).where(F.col("percent") > tolerance * 100)


def budget_checks(points: DataFrame) -> DataFrame:
    """(meeting, seq, total_seq, claimed, budget, state): department budgets so far against each earlier total."""
    typed = points.withColumn("value", parse_numeric(F.col("value"))).where("value is not null")
    order = Window.partitionBy("meeting").orderBy("seq", "value").rowsBetween(Window.unboundedPreceding, 0)
    dept = typed.where("type = 'dept_budget'").withColumn("claimed", F.sum("value").over(order)).select("meeting", "seq", "claimed")
    totals = typed.where("type = 'total_budget'").select("meeting", F.col("seq").alias("total_seq"), F.col("value").alias("budget"))
    state = F.when(F.col("claimed") > F.col("budget"), "budget_overflow").when(F.col("claimed") == F.col("budget"), "budget_resolved")
    return dept.join(totals, "meeting").where("total_seq < seq").withColumn("state", state).where("state is not null")


def enhance(segments: DataFrame, hotwords=None, overlap: float = 0.0) -> DataFrame:
    """Segments with scores, cleaned text of final ones, data points, spans and uncertainty.

    ``segments`` has text, is_final, snr and rt60; ``hotwords`` is a HotwordRewriter or None.
    The order is hotwords, cleanup, points, spans, uncertainty; partial results keep their text.
    """
    out = segments.withColumn("raw_text", F.col("text"))
    if hotwords is not None:
        out = out.withColumn("_h", hotwords.rewrite(F.col("text"))).withColumn("text", F.col("_h.text")).withColumn("corrections", F.col("_h.corrections")).drop("_h")
    cleaned = C.cleaned(F.col("text"))
    out = out.withColumn("text", F.when(F.col("is_final") & (F.trim("text") != ""), cleaned).otherwise(F.col("text")))
    score = A.quality_score(F.col("snr"), F.col("rt60"), overlap)
    out = out.withColumn("_q", score).withColumn("quality_label", A.quality_label(F.col("_q"))).withColumn("asr_confidence", A.asr_confidence(F.col("_q")))
    out = out.withColumn("data_points", data_points(F.col("text"))).withColumn("uncertain_spans", A.uncertain_spans(F.col("text"), F.col("snr")))
    out = out.withColumn("uncertainty", A.uncertainty(F.col("snr"), F.col("rt60"), F.lit(0.0), F.col("asr_confidence")))
    return out.withColumn("quality_score", F.round("_q", 2)).withColumn("snr", F.round("snr", 1)).withColumn("rt60", F.round("rt60", 2)).drop("_q")
