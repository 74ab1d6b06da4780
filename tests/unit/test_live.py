import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from confab.functions import acoustics as A
from confab.functions import plugins as P
from confab.sources import readers as R
from confab.sources import sinks as K
from confab.streaming import live as L
from confab.streaming import machines as M


def run(frames, params):
    state, out = M.SessionState(), []
    for seq, rms, text in frames:
        out.append(M.session_step(state, seq, seq * 40_000, rms, 640, text, False, params))
    return state, out


def test_energy_vad_needs_consecutive_voice():
    p, s = M.VadParams(0.01, 1600, 1600), M.VadState()
    assert [M.vad_step(s, r, 1600, p) for r in (0.0, 0.5, 0.0)] == [(False, False, False), (True, True, False), (False, False, True)]
    s = M.VadState()
    p = M.VadParams(0.01, 1600, 1280)
    assert [M.vad_step(s, r, 640, p)[1] for r in (0.5, 0.0, 0.5, 0.5)] == [False, False, False, True]
    assert M.vad_step(M.VadState(), 0.01, 9999, M.VadParams())[0] is False and M.vad_step(M.VadState(), 0.012, 9999, M.VadParams())[0]
    assert not M.vad_step(M.VadState(), 0.012, 9999, M.VadParams(strict=True))[0]


PARAMS = M.SessionParams(M.VadParams(0.1, 640, 640), pre_roll=1280, grace=1280)


def test_grace_counts_from_the_ending_frame():
    state, out = run([(0, 1, "a"), (1, 0, "a b"), (2, 0, "a b c"), (3, 0, "a b c d")], PARAMS)
    assert out[3] == [("partial", "a b c d"), ("final", "a b c d")] and not any(e[0] == "final" for o in out[:3] for e in o)
    assert (state.finals, state.partials) == (1, 4)


def test_resumed_speech_cancels_the_end():
    state, out = run([(0, 1, "a"), (1, 0, "a"), (2, 1, "a"), (3, 0, "a"), (4, 0, "a")], PARAMS)
    assert state.finals == 0 and [e for o in out for e in o] == [("partial", "a")]


def test_sequence_rules():
    state, out = run([(0, 1, None), (2, 1, None), (2, 1, None)], PARAMS)
    assert state.dropped == 1 and state.errors == 1 and out[2][0][0] == "error"
    assert run([(5, 1, None)], PARAMS)[0].dropped == 0


def test_pre_roll_is_forwarded():
    state, _ = run([(0, 0, None), (1, 0, None), (2, 0, None), (3, 1, "x")], PARAMS)
    assert state.received == 4 * 640 and state.forwarded == 1280 + 640
    assert M.session_step(state, None, 1, 0, 0, None, True, PARAMS) == [("final", "x")]
    assert M.session_step(state, 9, 1, 0, 0, None, False, PARAMS)[0][0] == "error"


def test_stale_tokens_change_nothing():
    state, ok = M.microphone_step(("idle", -1), "starting", 1)
    assert ok and M.microphone_step(state, "live", 0) == (state, False) and M.microphone_step(state, "live", 1) == (("live", 1), True)
    assert M.microphone_step(("idle", 1), "stopping", 1)[1] is False


def frames(spark):
    rng = np.random.default_rng(0)
    rows = [(f"s{k % 3}", k // 3, (k // 3) * 40_000, float(rng.random() > 0.4), 640, f"t{k // 9}", False) for k in range(240)]
    return spark.createDataFrame(rows, "stream string, seq long, us long, rms double, samples int, text string, end boolean")


@pytest.mark.parametrize("kind", ["vad", "session"])
def test_stream_equals_batch(spark, tmp_path, kind):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", L.ROCKSDB)
    source = frames(spark)
    for k in range(3):
        source.where(f"seq >= {k * 27} and seq < {k * 27 + 27}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = L.stream_energy_vad(stream, PARAMS.vad) if kind == "vad" else L.stream_sessions(stream, PARAMS)
    batch = L.energy_vad(source, PARAMS.vad) if kind == "vad" else L.live_sessions(source, PARAMS)
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.exceptAll(batch).count() == 0 and batch.exceptAll(found).count() == 0 and batch.count() > 50


def test_metrics_stream(spark, tmp_path):
    source = frames(spark)
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    q = L.live_metrics(stream).writeStream.format("memory").queryName("live_metrics_test").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("live_metrics_test").exceptAll(L.live_metrics(source)).count() == 0


def test_jobs(spark):
    rows = [("a", 1, "queued", 0.0), ("a", 2, "completed", 1.0), ("a", 3, "running", 0.5), ("b", 1, "queued", 0.0), ("b", 5, "running", 0.2)]
    states = L.job_states(spark.createDataFrame(rows, "job string, us long, status string, progress double"))
    assert {r["job"]: (r["status"], r["progress"]) for r in states.collect()} == {"a": ("completed", 1.0), "b": ("running", 0.2)}
    assert [r["job"] for r in L.expired_jobs(states, 4_000_000_000_000).collect()] == ["a"]


def test_frames_decode(spark):
    pcm = A.float_to_pcm(np.array([0.5, -0.5]))
    assert R.decode_frame(R.encode_frame(7, pcm))[:2] == (7, 2) and R.decode_frame(pcm)[:2] == (None, 1)
    assert R.decode_frame(b"DTP2\x00\x00\x00\x00")[3] and R.decode_frame(b"abc")[3] and R.decode_frame(b"")[3]
    row = spark.createDataFrame([(bytearray(R.encode_frame(7, pcm)),), (None,)], "p binary").select(R.decoded_frames(F.col("p")).alias("f")).collect()
    assert row[0]["f"]["seq"] == 7 and len(row[0]["f"]["samples"]) == 2 and row[1]["f"]["error"]


def test_audio_files_and_dataset(spark, tmp_path):
    x = np.sin(np.arange(8000) / 9) * 0.3
    for name, rate in (("R1_M1_far.wav", 8000), ("R1_M1_N_SPK1.wav", 16000), ("R1_M1_N_SPK2.wav", 16000)):
        (tmp_path / name).write_bytes(A.to_wav(x, rate))
    (tmp_path / "R1_M1.TextGrid").write_text('item [1]:\nintervals [1]:\n xmin = 0\n xmax = 1.5\n text = "你好"\nintervals [2]:\n xmin = 1.5\n xmax = 2\n text = "sil"\nintervals [3]:\n xmin = 2\n xmax = 3\n text = "a ""b"""\n')
    audio = {os.path.basename(r["path"]): r for r in R.read_audio(spark, str(tmp_path)).collect()}
    assert audio["R1_M1_far.wav"]["duration_ms"] == 1000 and len(audio["R1_M1_far.wav"]["samples"]) == 16000 and len(audio["R1_M1_far.wav"]["sha256"]) == 64
    assert R.read_audio(spark, str(tmp_path), max_bytes=10).count() == 0
    grid = R.read_textgrids(spark, str(tmp_path)).collect()
    assert [(r["start_sec"], r["end_sec"], r["text"]) for r in grid] == [(0.0, 1.5, "你好"), (2.0, 3.0, 'a "b"')]
    row = R.scan_dataset(spark, str(tmp_path)).first()
    assert (row["meeting"], row["far_files"], row["near_files"], row["speakers"], row["has_textgrid"]) == ("R1_M1", 1, 2, ["SPK1", "SPK2"], True)
    assert R.audio_windows(R.read_audio(spark, str(tmp_path), "*far.wav"), 512, 16000).count() == 62


def test_text_sources(spark, tmp_path):
    (tmp_path / "c.tsv").write_text('idx\tcontent\n1\t{""sentences"": [{""s"": ""甲""}, {""s"": ""乙""}]}\n2\tbad\n'.replace('""', '"'))
    assert [(r["idx"], r["text"]) for r in R.read_corpus(spark, str(tmp_path / "c.tsv")).collect()] == [(0, "甲"), (1, "乙")]
    (tmp_path / "m.json").write_text('[{"audio": "a.wav", "reference": "x", "keywords": ["k"]}, {"audio": "", "reference": "y"}, {"audio": "/b.wav", "reference": "z"}]')
    assert sorted((r["audio"], len(r["keywords"])) for r in R.read_manifest(spark, str(tmp_path / "m.json")).collect()) == [("/b.wav", 0), (f"{tmp_path}/a.wav", 1)]
    import gzip

    for name in ("p", "q"):
        with gzip.open(tmp_path / f"{name}.jsonl.gz", "wt") as f:
            f.write('{"id": "1", "duration": 2.5, "num_frames": 250, "supervisions": [{"text": "t", "speaker": "s"}]}\n')
    assert sorted(r["source"] for r in R.read_cuts(spark, {n: str(tmp_path / f"{n}.jsonl.gz") for n in "pq"}).collect()) == ["p", "q"]
    assert R.choose_store({"store_url": "u", "store_key": "k"}) == "remote" and R.choose_store({"store_url": "u"}) == "local"


def test_recordings(spark, tmp_path):
    r = K.Recording(str(tmp_path), "a/b c")
    r.append(A.float_to_pcm(np.zeros(160)))
    assert not os.path.exists(r.path) and r.finalize().endswith("a_b_c.wav") and os.path.exists(r.path)
    with pytest.raises(FileExistsError):
        K.Recording(str(tmp_path), "a/b c")
    kept = K.Recording(str(tmp_path), "x").abort()
    assert kept.endswith(".part") and os.path.exists(kept)
    with pytest.raises(ValueError):
        K.safe_id("//")
    f = spark.createDataFrame([("s", 2, [0.5]), ("s", 1, [0.1, 0.2]), ("s", 3, None)], "stream string, seq long, samples array<double>")
    row = K.assemble_recordings(f).first()
    assert row["samples"] == 3 and A.from_wav(bytes(row["wav"]))[1] == 16000


def test_results_and_downloads(spark, tmp_path):
    segs = spark.createDataFrame([(1, "A", 0, 61_000, "hi"), (2, None, 61_000, 62_000, "yo")], "idx long, speaker string, start_ms long, end_ms long, text string")
    K.write_results(segs, str(tmp_path / "o"), ["idx"])
    assert [r[0] for r in spark.read.text(str(tmp_path / "o" / "transcript")).collect()] == ["[00:00 - 01:01] A: hi", "[01:01 - 01:02] UNKNOWN: yo"]
    assert spark.read.json(str(tmp_path / "o" / "results")).count() == 2
    head = spark.createDataFrame([("周会 a/b",)], "t string").select(K.disposition(F.col("t"), "md").alias("h"))
    row = head.select("h", K.parsed_filename(F.col("h"))).first()
    assert row[0].startswith('attachment; filename="__ a_b.md"') and row[1] == "周会 a_b.md"
    K.write_error_report(spark.createDataFrame([("b", 0.5), ("a", 0.25)], "g string, wer double"), str(tmp_path / "w"))
    assert spark.read.text(str(tmp_path / "w")).count() == 2


def test_plugins(spark):
    x = [0.0] * 8000 + [0.5] * 8000 + [0.0] * 8000
    audio = spark.createDataFrame([(1, x)], "record long, samples array<double>")
    regions = P.speech_regions(audio, P.factory("vad", "missing", "loudness"), 100, 200)
    assert [tuple(r) for r in regions.collect()] == [(1, 400, 1200)]
    assert [r["text"] for r in P.interval_text(audio, regions, P.LengthRecognizer).collect()] == ["800ms"]

    class Broken:
        def recognize(self, samples, rate):
            raise RuntimeError("down")

    row = audio.select(P.recognized(F.col("samples"), Broken, P.LengthRecognizer).alias("r")).first()["r"]
    assert row["text"] == "1500ms" and "down" in row["error"]
    pieces = spark.createDataFrame([(1, "a", x), (1, "b", []), (1, "c", None)], "record long, key string, samples array<double>")
    found = {r["key"]: r["embedding"] for r in P.voiceprints(pieces, P.StatisticsEmbedder).collect()}
    assert found["b"] is None and found["c"] is None and abs(np.linalg.norm(found["a"]) - 1) < 1e-9
    with pytest.raises(KeyError):
        P.factory("asr", "none")
