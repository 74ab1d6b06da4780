import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from confab.functions import acoustics as A
from confab.operators import evaluate as E
from confab.operators import logic as L
from confab.operators import voices as W


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_character_errors_by_code_point(spark):
    pairs, want = [], []

    @settings(max_examples=100, deadline=None)
    @given(st.text(alphabet="ab会议é", max_size=10), st.text(alphabet="ab会议é", max_size=10))
    def gather(a, b):
        pairs.append((a, b))
        want.append(distance(a, b) / len(a) if a else float(bool(b)))

    gather()
    found = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(E.cer(F.col("a"), F.col("b"))).collect()]
    assert found == pytest.approx(want)
    assert distance("abcd", "ab") / 4 == 0.5


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=8), st.lists(st.sampled_from("abc"), max_size=8))
def test_token_errors_sum_to_the_distance(a, b):
    i, d, s = E.token_errors(a, b)
    assert i + d + s == distance(a, b) and i - d == len(b) - len(a)


def test_corpus_rate_is_not_a_mean(spark):
    rows = spark.createDataFrame([("p", 0, "abcd", "ab"), ("p", 1, "x", "x")], "g string, o int, reference string, hypothesis string")
    assert tuple(E.corpus_cer(rows, "g", "o").first()) == ("p", 2, 5, 0.4)
    assert E.wer_report(rows, "g").first()["wer"] == 0.5


def test_conflicts_need_types(spark):
    rows = [(1, 1, "number", "100"), (1, 2, "number", "900"), (1, 3, "result", "100"), (1, 4, "result", "150元"), (1, 5, "result", "110"), (2, 1, "result", "x"), (2, 2, "result", None)]
    found = L.data_conflicts(spark.createDataFrame(rows, "meeting int, seq int, type string, value string")).collect()
    assert sorted((r["seq"], r["prev_seq"], round(r["percent"])) for r in found) == [(4, 3, 50), (5, 4, 27)]


def test_budgets(spark):
    rows = [(1, 1, "total_budget", "100万"), (1, 2, "dept_budget", "60万"), (1, 3, "dept_budget", "40万"), (1, 4, "dept_budget", "1万")]
    found = L.budget_checks(spark.createDataFrame(rows, "meeting int, seq int, type string, value string")).collect()
    assert [(r["seq"], r["state"]) for r in sorted(found, key=lambda r: r["seq"])] == [(3, "budget_resolved"), (4, "budget_overflow")]


def test_data_points(spark):
    row = spark.createDataFrame([("涨25%到5800元 第7版 共12人 3.5 万",)], "t string").select(L.data_points(F.col("t"))).first()[0]
    assert [(p["value"], p["type"]) for p in row] == [("25%", "percentage"), ("5800元", "amount"), ("3.5 万", "amount"), ("5800", "number"), ("12", "number")]


def test_uncertainty_bands(spark):
    rows = [(25.0, 0.3, 1.0), (10.0, 0.3, 1.0), (4.0, 0.3, 0.8), (4.0, 1.3, 0.4)]
    frame = spark.createDataFrame(rows, "s double, r double, c double")
    levels = [r[0]["level"][:2] for r in frame.select(A.uncertainty(F.col("s"), F.col("r"), F.lit(0.0), F.col("c"))).collect()]
    assert levels == ["L0", "L1", "L2", "L3"]


def test_noise_and_decay_agree_with_the_table_forms(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.3, 16000), rng.normal(0, 0.01, 16000)])
    assert 25 < A.estimate_snr(x) < 35 and A.estimate_snr(np.zeros(5)) == 30 and A.estimate_snr(np.zeros(2000)) == 30
    tail = np.exp(-np.arange(16000 * 2) / 16000 * 13.8)
    assert 0.4 < A.estimate_rt60(tail) < 0.62 and A.estimate_rt60(np.zeros(100)) == 0.3
    few = x[:6400]
    frame = spark.createDataFrame([("a", k, float(v)) for k, v in enumerate(few)], "stream string, i long, x double")
    levels = A.frame_levels(frame, 320)
    assert abs(A.snr_of_frames(levels).first()["snr"] - A.estimate_snr(few)) < 1e-6


def test_codecs_round_trip(spark):
    x = np.sin(np.arange(1600) / 20) * 0.5
    back, rate = A.from_wav(A.to_wav(x, normalize=False))
    assert rate == 16000 and np.abs(back - x).max() < 1e-3
    assert A.pcm_to_float(A.float_to_pcm(np.array([1.0, -1.0, 2.0]))).tolist() == pytest.approx([32767 / 32768, -32767 / 32768, 32767 / 32768])
    assert A.float_to_pcm(np.array([-1.0]), True) == b"\x00\x80"
    for resample in (A.resample_linear, A.resample_bucket_mean, A.resample_polyphase):
        y = resample(np.sin(np.arange(4800) / 100), 48000, 16000)
        assert len(y) == 1600 and np.abs(y[100:-100] - np.sin(np.arange(1600) * 3 / 100)[100:-100]).max() < 0.05
    row = spark.createDataFrame([("data:audio/mp3;base64,AAEC", "%%%")], "a string, b string").select(A.blob_of(F.col("a")), A.mime_of(F.col("a")), A.blob_of(F.col("b")), A.mime_of(F.col("b"))).first()
    assert tuple(row) == (bytearray([0, 1, 2]), "audio/mp3", None, "audio/wav")


def test_levels(spark):
    row = spark.createDataFrame([([0.25] * 2048, [1.0, float("nan")])], "x array<double>, y array<double>").select(A.rms(F.col("x")), A.peak(F.col("x")), F.size(A.windows(F.col("x"), 512)), A.valid_samples(F.col("y"))).first()
    assert tuple(row) == (0.25, 0.25, 4, None)
    up = spark.createDataFrame([([0.0, 1.0, 0.0],)], "l array<double>").select(A.smoothed_levels(F.col("l"))).first()[0]
    assert up == pytest.approx([0.0, 0.65, 0.65 * 0.86])


def test_clamping(spark):
    rows = [("99999",), ("-1",), ("x",), (None,)]
    found = [r[0] for r in spark.createDataFrame(rows, "v string").select(A.clamped(F.col("v"), 0, 5000, 800)).collect()]
    assert found == [5000, 0, 800, 800]


def brute_linkage(unit, cut):
    groups = [[k] for k in range(len(unit))]
    d = 1 - unit @ unit.T
    while len(groups) > 1:
        pairs = [(d[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
        best = min(pairs)
        if best[0] > cut:
            break
        groups[best[1]] += groups.pop(best[2])
    return {frozenset(g) for g in groups}


def test_average_linkage_equals_brute_force():
    rng = np.random.default_rng(3)
    for n in (1, 2, 12, 30):
        u = rng.normal(size=(n, 5))
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        for cut in (0.3, 0.7, 1.0):
            labels = W.average_linkage(u, cut)
            assert {frozenset(np.flatnonzero(labels == k).tolist()) for k in set(labels)} == brute_linkage(u, cut)
        assert len(set(W.average_linkage(u, clusters=2))) == min(2, n)
    assert len(W.average_linkage(np.zeros((0, 3)), 0.1)) == 0


def test_clusters_are_named_by_first_appearance(spark):
    rows = [(1, "1:b", 500, [0.0, 1.0]), (1, "0:a", 0, [1.0, 0.0]), (1, "1:a", 900, [0.99, 0.05]), (1, "2:x", 950, None)]
    frame = spark.createDataFrame(rows, "record long, key string, first_ms long, embedding array<double>")
    assert {r["key"]: r["name"] for r in W.cluster_prototypes(frame).collect()} == {"0:a": "SPEAKER_00", "1:a": "SPEAKER_00", "1:b": "SPEAKER_01", "2:x": "SPEAKER_02"}
    with pytest.raises(Exception, match="voiceprint"):
        W.cluster_prototypes(frame, clusters=2).collect()


def test_verification(spark, monkeypatch):
    probes = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    voices = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "speaker string, embedding array<double>")
    want = {1: ("a", 1.0), 2: ("b", 0.8), 3: (None, 0.0)}
    for most in (50_000, 1):
        monkeypatch.setattr(W, "MAX_BROADCAST_VOICES", most)
        assert {r["vec_id"]: (r["speaker"], round(r["similarity"], 6)) for r in W.verify_speaker(probes, voices).collect()} == want


def test_polyphase_equals_filtering_at_the_raised_rate():
    rng = np.random.default_rng(3)
    for rate, to, n in ((44_100, 16_000, 700), (8_000, 16_000, 301), (48_000, 16_000, 5), (11_025, 16_000, 64), (44_100, 16_000, 0)):
        x, g = rng.normal(size=n), np.gcd(rate, to)
        up, down = to // g, rate // g
        width = 16 * max(up, down)
        t = np.arange(-width, width + 1) / max(up, down)
        taps = np.sinc(t) * np.kaiser(len(t), 8.0) * up / max(up, down)
        spread = np.zeros(n * up)
        spread[::up] = x
        want = np.convolve(spread, taps)[width : width + len(spread)][::down] if n else spread
        assert np.allclose(A.resample_polyphase(x, rate, to), want, atol=1e-5)
    began = time.time()
    assert len(A.resample_polyphase(rng.normal(size=44_100 * 60), 44_100, 16_000)) == 960_000
    assert time.time() - began < 5


def test_verify_speaker_takes_messy_vectors(spark):
    kind = "vec_id int, embedding array<float>"
    probes = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, []), (4, [1.0]), (5, [None, 1.0]), (6, [0.0, -1.0])], kind)
    voices = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", None), (None, [0.0, -1.0])], "speaker string, embedding array<float>")
    found = {r["vec_id"]: (r["speaker"], r["similarity"]) for r in W.verify_speaker(probes, voices).collect()}
    assert found == {1: ("a", 1.0), **{k: (None, 0.0) for k in range(2, 7)}}
    assert W.verify_speaker(probes, voices.limit(0)).where("speaker is not null").count() == 0
    assert "Exchange" not in W.verify_speaker(probes, voices)._jdf.queryExecution().executedPlan().toString()


def test_candidates_are_ranked_without_gathering_them(spark):
    made = [("common", 260), ("often", 9), ("aa", 5), ("b" * 400 + "y", 5), ("b" * 400 + "x", 5), ("cc", 5), ("rare", 2)]
    words = spark.createDataFrame([(w, n, 1) for w, n in made], "word string, count long, df long").repartition(3)
    for most in range(len(made) + 1):
        want = [w for w, n in sorted(made, key=lambda r: (-r[1], r[0]))[:most] if 3 <= n <= 200]
        assert sorted(r["word"] for r in E.most_frequent(words, most, 3, 200).collect()) == sorted(want)
    texts = spark.createDataFrame([(k % 2, f"{w} 1") for w, n in made for k in range(n)], "meeting int, text string")
    mined = E.mine_hotwords(texts, candidates=5)
    assert "limit=5," not in mined._jdf.queryExecution().executedPlan().toString()  # the candidates of all tasks in one
    assert len(mined.collect()) == len({r["word"] for r in mined.collect()}) == 3
    assert E.mine_hotwords(texts.limit(0)).count() == 0
