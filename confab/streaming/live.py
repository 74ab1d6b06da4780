"""Live audio over Structured Streaming, and the same operators over finished tables."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from confab.plans.folds import running_fold
from confab.streaming import machines as M

EVENTS = "seq long, us long, event string, text string"
VAD_ROWS = "seq long, speaking boolean, started boolean, ended boolean"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


VAD_FIELDS = ["seq", "rms", "samples"]
SESSION_FIELDS = ["seq", "us", "rms", "samples", "text", "end"]


def _number(x: float | None) -> float:
    return float(x) if x is not None and x == x else 0.0


def _vad_rows(state: M.VadState, rows: Iterable[tuple], p: M.VadParams) -> list[tuple]:
    return [(seq, *M.vad_step(state, rms, int(samples), p)) for seq, rms, samples in rows]


def _session_rows(state: M.SessionState, rows: Iterable[tuple], p: M.SessionParams) -> list[tuple]:
    out = []
    for seq, us, rms, samples, text, end in rows:
        known = seq is not None and seq == seq
        heard = text if isinstance(text, str) else None
        for event, said in M.session_step(state, int(seq) if known else None, int(us), _number(rms), int(_number(samples)), heard, bool(end), p):
            out.append((seq, us, event, said))
    return out


def _each(state: Callable, rows: Callable, params) -> Callable[[Iterator[tuple]], Iterator[tuple]]:
    """Fold that takes a stream's rows one by one through a machine of its own."""

    def fold(group: Iterator[tuple]) -> Iterator[tuple]:
        own = state()
        for row in group:
            yield from rows(own, [row], params)

    return fold


def energy_vad(frames: DataFrame, params: M.VadParams = M.VadParams()) -> DataFrame:
    """Batch form over (stream, seq, rms, samples): a fold a stream in order of sequence."""
    rows = frames.select(F.col("stream").cast("string").alias("stream"), *VAD_FIELDS)
    return running_fold(rows, "stream", ["seq"], VAD_FIELDS, _each(M.VadState, _vad_rows, params), VAD_ROWS)


def live_sessions(frames: DataFrame, params: M.SessionParams = M.SessionParams()) -> DataFrame:
    """Batch form over (stream, seq, us, rms, samples, text, end): events in order of arrival."""
    return running_fold(_session_columns(frames), "stream", ["us", "seq"], SESSION_FIELDS, _each(M.SessionState, _session_rows, params), EVENTS)


def _session_columns(frames: DataFrame) -> DataFrame:
    return frames.select(F.col("stream").cast("string").alias("stream"), F.col("seq").cast("long").alias("seq"), F.col("us").cast("long").alias("us"), F.col("rms").cast("double").alias("rms"), F.col("samples").cast("int").alias("samples"), "text", F.coalesce(F.col("end"), F.lit(False)).alias("end"))


class _Machine(StatefulProcessor):
    """Keeps a machine's state as JSON a key; rows of a batch are taken in order of arrival time."""

    def __init__(self, fresh: Callable[[], object], load: Callable[[dict], object], rows: Callable, fields: list[str], columns: list[str], ttl_ms: int | None):
        self.fresh, self.load, self.rows, self.fields, self.columns, self.ttl_ms = fresh, load, rows, fields, columns, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "json string", self.ttl_ms) if self.ttl_ms else handle.getValueState("state", "json string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        machine = self.load(json.loads(held[0])) if held else self.fresh()
        pdf = pd.concat(list(rows), ignore_index=True)
        pdf = pdf.sort_values([c for c in ("us", "seq") if c in pdf.columns], ignore_index=True)
        out = self.rows(machine, zip(*[pdf[f].tolist() for f in self.fields]))
        self.state.update((json.dumps(M.to_dict(machine)),))
        yield pd.DataFrame([(key[0], *row) for row in out], columns=["stream", *self.columns])

    def close(self) -> None:
        pass


def stream_energy_vad(frames: DataFrame, params: M.VadParams = M.VadParams()) -> DataFrame:
    """Streaming form of :func:`energy_vad`; the state of a stream is three numbers."""
    machine = _Machine(M.VadState, M.vad_from, lambda s, rows: _vad_rows(s, rows, params), VAD_FIELDS, ["seq", "speaking", "started", "ended"], None)
    rows = frames.select(F.col("stream").cast("string").alias("stream"), "seq", "rms", "samples")
    return rows.groupBy("stream").transformWithStateInPandas(machine, "stream string, " + VAD_ROWS, "append", "none")


def stream_sessions(frames: DataFrame, params: M.SessionParams = M.SessionParams(), ttl_ms: int | None = None) -> DataFrame:
    """Streaming form of :func:`live_sessions`; with a time to live, idle streams are forgotten."""
    machine = _Machine(M.SessionState, M.session_from, lambda s, rows: _session_rows(s, rows, params), SESSION_FIELDS, ["seq", "us", "event", "text"], ttl_ms)
    return _session_columns(frames).groupBy("stream").transformWithStateInPandas(machine, "stream string, " + EVENTS, "append", "processingTime" if ttl_ms else "none")


def live_metrics(frames: DataFrame) -> DataFrame:
    """Counters a stream: frames, samples, least and greatest time, mean level; batch or complete-mode stream."""
    return frames.groupBy("stream").agg(F.count("*").alias("frames"), F.sum("samples").alias("samples"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.max("seq").alias("last_seq"))


def session_windows(frames: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Speech sessions by event time; a frame at exactly the gap still joins."""
    timed = frames.withColumn("ts", F.timestamp_micros("us"))
    if frames.isStreaming:
        timed = timed.withWatermark("ts", late)
    return timed.groupBy("stream", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("stream", "w.start", "w.end", "n")


def sampled_chunks(frames: DataFrame, every: int = 5) -> DataFrame:
    """Frames on which acoustics are measured: the first of a stream and every fifth."""
    n = F.row_number().over(Window.partitionBy("stream").orderBy("seq"))
    return frames.withColumn("_n", n).where((F.col("_n") == 1) | (F.col("_n") % every == 0)).drop("_n")


def job_states(events: DataFrame) -> DataFrame:
    """(job, status, progress, events): latest state of each job; terminal states are final."""
    done = F.col("status").isin("completed", "failed", "cancelled")
    rank = F.struct(done.alias("d"), F.when(done, -F.col("us")).otherwise(F.col("us")).alias("u"))
    return events.groupBy("job").agg(F.max_by("status", rank).alias("status"), F.max_by("progress", rank).alias("progress"), F.max("us").alias("last_us"), F.count("*").alias("events"))


def expired_jobs(states: DataFrame, now_us: int, ttl_s: int = 3600) -> DataFrame:
    """Terminal jobs idle for longer than the time to live."""
    return states.where(F.col("status").isin("completed", "failed", "cancelled") & (F.lit(now_us) - F.col("last_us") > ttl_s * 1_000_000))


def canonical_text(results: DataFrame) -> DataFrame:
    """One row a stream and segment: the canonical result replaces earlier ones, later ones replace older."""
    order = Window.partitionBy("stream", "segment").orderBy(F.desc("is_canonical"), F.desc("us"), F.desc("text"))
    return results.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def legal_transitions(events: DataFrame) -> DataFrame:
    """Controller events (client, us, event, token) with ``taken``; stale tokens and illegal steps are not."""

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        state = ("idle", -1)
        for us, event, token in rows:
            state, taken = M.microphone_step(state, event, int(token))
            yield us, event, token, taken

    kinds = {c: events.schema[c].dataType.simpleString() for c in ("us", "event", "token")}
    return running_fold(events, "client", ["us", "event", "token"], ["us", "event", "token"], fold, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", taken boolean")


def coalesced_reloads(requests: DataFrame, busy_us: int) -> DataFrame:
    """Reload requests that run: bursts within the time a reload takes collapse into one that follows."""
    before = F.lag("us").over(Window.partitionBy("service").orderBy("us"))
    return requests.withColumn("_b", before).where(F.col("_b").isNull() | (F.col("us") - F.col("_b") >= busy_us)).drop("_b")
