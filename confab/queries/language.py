"""Queries of text, scores, logic, evaluation, voices and signals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from confab.functions import acoustics as A
from confab.functions import cleanup as C
from confab.operators import evaluate as E
from confab.operators import logic as L
from confab.operators import voices as W
from confab.plans import views as V
from confab.sources.tables import table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


ROOM = "room AS (SELECT event_id, user_id, value / 5.0 AS snr, (value * 7) % 100 / 60.0 AS rt60, (event_id % 10) / 20.0 AS overlap, 0.4 + (event_id % 60) / 100.0 AS conf, event_id % 9 = 0 AS ood FROM events)"


def _room(spark, sf):
    v, e = F.col("value"), F.col("event_id")
    return table(spark, sf, "events").select("event_id", "user_id", (v / 5).alias("snr"), ((v * 7) % 100 / 60).alias("rt60"), ((e % 10) / 20).alias("overlap"), (0.4 + (e % 60) / 100).alias("conf"), (e % 9 == 0).alias("ood"))


QUALITY = "0.5 * least(1.0, greatest(0.0, snr / 30)) + 0.3 * least(1.0, greatest(0.0, 1 - (rt60 - 0.2) / 1.8)) + 0.2 * (1 - overlap)"


@query(
    f"""WITH {ROOM} SELECT event_id, CASE WHEN rt60 > 1 THEN CASE WHEN snr < 10 THEN '大型会议室(高混响+噪声)' ELSE '报告厅(高混响)' END
  WHEN rt60 > 0.5 THEN CASE WHEN snr < 12 THEN '中型会议室(中混响+噪声)' ELSE '中型会议室' END
  WHEN snr < 8 THEN '嘈杂环境(低SNR)' WHEN snr < 18 THEN '普通室内(中SNR)' ELSE '安静室内' END AS scene FROM room"""
)
def acoustic_scene(spark, sf):
    return _room(spark, sf).select("event_id", A.scene(F.col("snr"), F.col("rt60")).alias("scene"))


@query(f"WITH {ROOM}, q AS (SELECT event_id, {QUALITY} AS q FROM room) SELECT event_id, round(q, 6) AS score, CASE WHEN q > 0.7 THEN 'high' WHEN q > 0.4 THEN 'medium' ELSE 'low' END AS label, round(greatest(0.4, q * 0.9), 6) AS confidence FROM q")
def quality_score(spark, sf):
    q = _room(spark, sf).select("event_id", A.quality_score(F.col("snr"), F.col("rt60"), F.col("overlap")).alias("q"))
    return q.select("event_id", F.round("q", 6).alias("score"), A.quality_label(F.col("q")).alias("label"), F.round(A.asr_confidence(F.col("q")), 6).alias("confidence"))


@query(
    f"""WITH {ROOM}, u AS (SELECT event_id, least(1.0, (CASE WHEN snr < 5 THEN 0.40 WHEN snr < 12 THEN 0.25 WHEN snr < 20 THEN 0.10 ELSE 0.0 END)::DOUBLE
  + (CASE WHEN rt60 > 1.2 THEN 0.15 WHEN rt60 > 0.7 THEN 0.08 ELSE 0.0 END)::DOUBLE + overlap::DOUBLE * 0.2::DOUBLE + (CASE WHEN ood THEN 0.2 ELSE 0.0 END)::DOUBLE + greatest(0.0, 1 - conf::DOUBLE) * 0.5::DOUBLE) AS t FROM room)
SELECT event_id, round(t, 6) AS total, CASE WHEN t < 0.15 THEN 'L0_高确信' WHEN t < 0.4 THEN 'L1_中确信' WHEN t < 0.65 THEN 'L2_低确信' ELSE 'L3_极低确信' END AS level, round(greatest(0.0, 1 - t), 6) AS calibrated FROM u"""
)
def uncertainty_bands(spark, sf):
    u = _room(spark, sf).select("event_id", A.uncertainty(F.col("snr"), F.col("rt60"), F.col("overlap"), F.col("conf"), F.col("ood")).alias("u"))
    return u.select("event_id", F.round("u.total", 6).alias("total"), "u.level", F.round("u.calibrated", 6).alias("calibrated"))


@query(
    """WITH p AS (SELECT doc_id, regexp_extract_all(text, '\\d+(?:\\.\\d+)?\\s*%') AS pc, regexp_extract_all(text, '\\d+(?:\\.\\d+)?\\s*[万亿元]') AS am FROM documents)
SELECT doc_id, len(pc) AS percentages, len(am) AS amounts, array_to_string(pc, ';') AS first_values FROM p"""
)
def data_points(spark, sf):
    p = table(spark, sf, "documents").select("doc_id", L.data_points(F.col("text")).alias("p"))
    of = lambda kind: F.filter("p", lambda x: x["type"] == kind)
    return p.select("doc_id", F.size(of("percentage")).cast("bigint").alias("percentages"), F.size(of("amount")).cast("bigint").alias("amounts"), F.array_join(F.transform(of("percentage"), lambda x: x["value"]), ";").alias("first_values"))


POINTS = """points AS (SELECT l_orderkey AS meeting, l_linenumber AS seq, CASE l_linenumber % 3 WHEN 0 THEN 'result' WHEN 1 THEN 'total' ELSE 'note' END AS type, 'about ' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || '万' AS value FROM lineitem)"""


def _points(spark, sf, types):
    li = table(spark, sf, "lineitem")
    kind = F.when(F.col("l_linenumber") % 3 == 0, types[0]).when(F.col("l_linenumber") % 3 == 1, types[1]).otherwise(types[2])
    return li.select(F.col("l_orderkey").alias("meeting"), F.col("l_linenumber").alias("seq"), kind.alias("type"), F.concat(F.lit("about "), F.col("l_quantity").cast("int").cast("string"), F.lit("万")).alias("value"))


@query(
    f"""WITH {POINTS}, v AS (SELECT meeting, seq, type, CAST(regexp_extract(value, '[\\d.]+') AS DOUBLE) AS value FROM points WHERE type IN ('result', 'total'))
SELECT a.meeting, a.seq, b.seq AS prev_seq, a.type, a.value, b.value AS prev_value, round(abs(a.value - b.value) / greatest(b.value, 1.0) * 100, 6) AS percent
FROM v a JOIN v b ON a.meeting = b.meeting AND a.type = b.type AND b.seq < a.seq WHERE abs(a.value - b.value) / greatest(b.value, 1.0) * 100 > 20"""
)
def data_conflicts(spark, sf):
    return L.data_conflicts(_points(spark, sf, ("result", "total", "note"))).withColumn("percent", F.round("percent", 6))


@query(
    """WITH p AS (SELECT l_orderkey AS meeting, l_linenumber AS seq, CASE l_linenumber % 3 WHEN 1 THEN 'total_budget' WHEN 2 THEN 'dept_budget' ELSE 'x' END AS type, CAST(CAST(l_quantity AS INTEGER) AS DOUBLE) AS v FROM lineitem),
d AS (SELECT meeting, seq, sum(v) OVER (PARTITION BY meeting ORDER BY seq, v ROWS UNBOUNDED PRECEDING) AS claimed FROM p WHERE type = 'dept_budget')
SELECT d.meeting, d.seq, t.seq AS total_seq, claimed, t.v AS budget, CASE WHEN claimed > t.v THEN 'budget_overflow' ELSE 'budget_resolved' END AS state FROM d JOIN p t ON t.meeting = d.meeting AND t.type = 'total_budget' AND t.seq < d.seq WHERE claimed >= t.v"""
)
def budget_checks(spark, sf):
    return L.budget_checks(_points(spark, sf, ("x", "total_budget", "dept_budget")))


@query("SELECT event_id, round(least(greatest(coalesce(TRY_CAST(v AS DOUBLE), 40), 10), 60), 3) AS vad FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'x' ELSE CAST(value AS VARCHAR) END AS v FROM events)")
def settings_clamp(spark, sf):
    v = F.when(F.col("event_id") % 7 == 0, "x").otherwise(F.col("value").cast("string"))
    return table(spark, sf, "events").select("event_id", A.clamped(v, 10, 60, 40).alias("vad"))


@query("SELECT event_id, coalesce(json_extract_string(CASE WHEN event_id % 5 = 0 THEN NULL ELSE props END, '$.k'), 'none') AS k FROM events")
def json_fallback(spark, sf):
    props = F.when(F.col("event_id") % 5 == 0, "{bad").otherwise(F.col("props"))
    return table(spark, sf, "events").select("event_id", F.coalesce(F.get_json_object(props, "$.k"), F.lit("none")).alias("k"))


@query("SELECT doc_id, regexp_replace(regexp_replace(text, '\\s{2,}', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS t FROM documents WHERE doc_id % 3 = 0")
def squeeze_text(spark, sf):
    d = table(spark, sf, "documents").where("doc_id % 3 = 0")
    return d.select("doc_id", F.regexp_replace(F.regexp_replace("text", r"\s{2,}", " "), r"^\s+|\s+$", "").alias("t"))


CJK = [
    "嗯金额额外看看那个那个我们开始", "大家好。，今天开始开会。。", "二零二六年百分之二十五下午三点半端口八零八零预算五千八百元", "好好好 那 么 就 是 说 开始吧", "他说3.5个点 在3:30开始", "哈哈哈哈哈 很好",
    "三月五号上午十点开会", "一共三千六百五十块钱 大概两小时", "版本二点五发布", "对对对这个这个可以吗", "<0xE4><0xBD><0xA0>好", "Open AI 很 好 2026年",
]


@query(None)
def clean_transcript(spark, sf):
    rows = spark.createDataFrame(list(enumerate(CJK)), "id long, text string")
    return rows.select("id", C.cleaned(F.col("text")).alias("clean"), C.normalized(F.col("text")).alias("spaced"), C.byte_fallback(F.col("text")).alias("bytes"), C.han_spacing(F.col("text")).alias("han"), C.display_width(F.col("text")).alias("width"))


@query(None)
def cleanup_details(spark, sf):
    return V.segments(spark, sf).select("record", "idx", C.cleanup_details(F.col("text")).alias("d")).select("record", "idx", "d.changed", F.size("d.repeats").alias("repeats"))


@query(
    f"""WITH {V.SEGMENTS}, b AS (SELECT record, idx, text, coalesce(lag(text) OVER (PARTITION BY record ORDER BY idx), '') AS p FROM (SELECT record, idx, CASE WHEN idx % 2 = 1 THEN right(lag(text) OVER (PARTITION BY record ORDER BY idx), 12) || text ELSE text END AS text FROM segments)),
m AS (SELECT *, list_max(list_filter(range(3, CAST(least(40, length(p), length(text)) AS BIGINT) + 1), lambda n: right(p, n) = left(text, n))) AS n FROM b)
SELECT record, idx, CASE WHEN n IS NULL THEN text ELSE ltrim(text[n + 1 :], ' ' || chr(10)) END AS text FROM m"""
)
def boundary_dedup(spark, sf):
    order = Window.partitionBy("record").orderBy("idx")
    s = V.segments(spark, sf)
    s = s.select("record", "idx", F.when(F.col("idx") % 2 == 1, F.concat(F.right(F.lag("text").over(order), F.lit(12)), F.col("text"))).otherwise(F.col("text")).alias("text"))
    return s.select("record", "idx", C.boundary_deduplicated(F.lag("text").over(order), F.col("text")).alias("text"))


@query(
    """WITH k AS (SELECT doc_id, regexp_replace(text, '[^a-zA-Z0-9]', '', 'g') AS t FROM documents WHERE doc_id % 4 = 0)
SELECT doc_id, len(regexp_extract_all(t, '[a-zA-Z]{2,}')) + len(regexp_extract_all(t, '[a-zA-Z0-9]{2,}')) AS n, lower(coalesce(regexp_extract_all(t, '[a-zA-Z]{2,}')[1], '')) AS first FROM k"""
)
def term_candidates(spark, sf):
    d = table(spark, sf, "documents").where("doc_id % 4 = 0")
    words = C.term_candidates(F.regexp_replace("text", "[^ -~]", ""))
    return d.select("doc_id", words.alias("w")).select("doc_id", F.size("w").cast("bigint").alias("n"), F.coalesce(F.get("w", F.lit(0)), F.lit("")).alias("first"))


FOLD = "regexp_replace({}, '[^ -~]', '?', 'g')"


@query(f"WITH {V.SEGMENTS}, p AS (SELECT record, idx, left({FOLD.format('text')}, 200) AS r, left({FOLD.format('lead(text) OVER (PARTITION BY record ORDER BY idx)')}, 200) AS h FROM segments) SELECT record, idx, CAST(levenshtein(r, coalesce(h, '')) AS BIGINT) AS errors, round(CASE WHEN r = '' THEN CASE WHEN coalesce(h, '') = '' THEN 0.0 ELSE 1.0 END ELSE levenshtein(r, coalesce(h, '')) / length(r) END, 6) AS cer FROM p")
def cer_ascii(spark, sf):
    fold = lambda c: F.substring(F.regexp_replace(c, "[^ -~]", "?"), 1, 200)
    order = Window.partitionBy("record").orderBy("idx")
    p = V.segments(spark, sf).select("record", "idx", fold(F.col("text")).alias("r"), fold(F.lead("text").over(order)).alias("h"))
    return p.select("record", "idx", F.levenshtein("r", F.coalesce("h", F.lit(""))).cast("bigint").alias("errors"), F.round(E.cer(F.col("r"), F.col("h")), 6).alias("cer"))


@query(None)
def wer_by_speaker(spark, sf):
    order = Window.partitionBy("record").orderBy("idx")
    s = V.segments(spark, sf).where("record < 40").withColumn("hypothesis", F.lead("text").over(order)).withColumnRenamed("text", "reference")
    cut = lambda c: F.array_join(F.slice(F.split(c, " "), 1, 40), " ")
    return E.wer_report(s.withColumn("reference", cut("reference")).withColumn("hypothesis", cut("hypothesis")), "speaker")


@query(
    f"""WITH {V.TIMELINE}, m AS (SELECT s.record, s.idx, s.text, min(t.turn) AS h FROM segments s JOIN timeline t ON t.record = s.record AND t.start_ms * 2 <= s.start_ms + s.end_ms AND s.start_ms + s.end_ms <= t.end_ms * 2 GROUP BY ALL)
SELECT s.record, count(*) AS total, count(*) FILTER (m.h = s.idx) AS same FROM segments s LEFT JOIN m ON m.record = s.record AND m.idx = s.idx GROUP BY s.record"""
)
def match_rate(spark, sf):
    s = V.segments(spark, sf)
    heard = V.timeline(spark, sf).select("record", F.col("turn").alias("idx"), "start_ms", "end_ms").join(s.select("record", "idx", "text"), ["record", "idx"])
    rate = E.match_rate(s, heard)
    found = E.midpoint_match(s, heard).where("heard_idx = idx").groupBy("record").agg(F.count("*").alias("same"))
    return rate.join(found, "record", "left").select("record", "total", F.coalesce("same", F.lit(0)).alias("same"))


@query(
    """WITH w AS (SELECT lang AS meeting, lower(unnest(regexp_extract_all(regexp_replace(text, '[^a-zA-Z0-9]', ' ', 'g'), '[a-zA-Z0-9]+'))) AS word FROM documents),
c AS (SELECT word, count(*) AS n, count(DISTINCT meeting) AS df FROM w GROUP BY word),
t AS (SELECT * FROM c ORDER BY n DESC, word LIMIT 5000),
s AS (SELECT word, n AS count, round(n * least(4.0 / df, 10.0), 1) AS score FROM t WHERE n BETWEEN 3 AND 200 AND length(word) >= 2)
SELECT * FROM s ORDER BY score DESC, word LIMIT 200"""
)
def mine_hotwords(spark, sf):
    d = table(spark, sf, "documents")
    words = d.select(F.col("lang").alias("meeting"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"))).alias("word"))
    per = words.groupBy("word", "meeting").agg(F.count("*").alias("c")).groupBy("word").agg(F.sum("c").alias("count"), F.count("*").alias("df"))
    top = E.most_frequent(per, 5000, 3, 200).where("length(word) >= 2")
    return top.select("word", "count", F.round(F.col("count") * F.least(4 / F.col("df"), F.lit(10.0)), 1).alias("score")).orderBy(F.desc("score"), "word").limit(200)


@query(
    """WITH k AS (SELECT source AS meeting, regexp_replace(text, '[^a-zA-Z0-9]', '', 'g') AS t FROM documents),
w AS (SELECT meeting, lower(unnest(regexp_extract_all(t, '[a-zA-Z]{2,}') || regexp_extract_all(t, '[a-zA-Z0-9]{2,}'))) AS word FROM k),
c AS (SELECT word, count(*) AS n, count(DISTINCT meeting) AS df FROM w GROUP BY word), t AS (SELECT * FROM c ORDER BY n DESC, word LIMIT 5000)
SELECT word, n AS count, round(n * least((SELECT count(DISTINCT source) FROM documents)::DOUBLE / df, 10.0), 1) AS score FROM t WHERE n BETWEEN 3 AND 200 ORDER BY score DESC, word LIMIT 200"""
)
def mine_terms(spark, sf):
    return E.mine_hotwords(table(spark, sf, "documents").select(F.col("source").alias("meeting"), "text"))


@query("SELECT lang AS profile, count(*) FILTER (contains(lower(text), lower(k))) AS hits, count(*) AS total FROM documents, (SELECT unnest(['the', 'QUE', 'ung', 'zz']) AS k) GROUP BY lang")
def keyword_recall(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("item"), F.col("lang").alias("profile"), "text")
    keys = d.select("item", F.explode(F.array(*map(F.lit, ("the", "QUE", "ung", "zz")))).alias("keyword"))
    return E.keyword_recall(d, keys, "profile")


@query("WITH p AS (SELECT lang AS profile, regexp_replace(substr(text, 1, 80), '[^ -~]', '?', 'g') AS r, regexp_replace(substr(text, 11, 80), '[^ -~]', '?', 'g') AS h, doc_id FROM documents) SELECT profile, count(*) AS items, CAST(sum(levenshtein(r, h)) AS BIGINT) AS errors, CAST(sum(length(r)) AS BIGINT) AS chars, CAST(sum(CASE WHEN contains(lower(h), 'the') THEN 1 ELSE 0 END) AS BIGINT) AS hits, count(*) AS keywords, CAST(sum(doc_id % 7) AS BIGINT) AS elapsed FROM p GROUP BY profile")
def profile_report(spark, sf):
    fold = lambda a: F.regexp_replace(F.substring("text", a, 80), "[^ -~]", "?")
    runs = table(spark, sf, "documents").select(F.col("lang").alias("profile"), fold(1).alias("reference"), fold(11).alias("hypothesis"), F.array(F.lit("the")).alias("keywords"), (F.col("doc_id") % 7).alias("elapsed"))
    return E.profile_report(runs)


VOICES = """voices AS (SELECT label AS speaker, embedding AS ref FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings) WHERE r = 1),
s AS (SELECT e.vec_id, v.speaker, list_sum(list_transform(list_zip(e.embedding, v.ref), lambda p: CAST(p[1] AS DOUBLE) * p[2])) AS sim FROM embeddings e CROSS JOIN voices v)"""


@query(f"WITH {VOICES}, b AS (SELECT vec_id, arg_min(speaker, (-sim, speaker)) AS speaker, max(sim) AS sim FROM s GROUP BY vec_id) SELECT vec_id, CASE WHEN sim > 0.3 THEN speaker ELSE -1 END AS speaker, round(greatest(sim, 0.0), 5) AS similarity FROM b")
def verify_speaker(spark, sf):
    e = table(spark, sf, "embeddings")
    first = e.withColumn("_r", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).where("_r = 1").select(F.col("label").alias("speaker"), "embedding")
    found = W.verify_speaker(e, first, 0.3)
    return found.select("vec_id", F.coalesce("speaker", F.lit(-1)).alias("speaker"), F.round("similarity", 5).alias("similarity"))


@query(None)
def cluster_speakers(spark, sf):
    e = table(spark, sf, "embeddings").where("vec_id < 600")
    return W.cluster_prototypes(e.select((F.col("vec_id") % 20).alias("record"), F.col("vec_id").cast("string").alias("key"), F.col("vec_id").alias("first_ms"), "embedding"), 0.25)


SAMPLES = V.FRAMES + ", samples AS (SELECT stream, seq - 1 AS i, rms / 100.0 - 0.5 AS x FROM frames)"


def _samples(spark, sf):
    return V.frames(spark, sf).select("stream", (F.col("seq") - 1).alias("i"), (F.col("rms") / 100 - 0.5).alias("x"))


@query(f"WITH {SAMPLES} SELECT stream, CAST(floor(i / 8) AS BIGINT) AS frame, round(sqrt(avg(x * x)), 6) AS rms, round(max(abs(x)), 6) AS peak FROM samples GROUP BY stream, floor(i / 8) HAVING count(*) = 8")
def rms_frames(spark, sf):
    return A.frame_levels(_samples(spark, sf), 8).select("stream", "frame", F.round("rms", 6).alias("rms"), F.round("peak", 6).alias("peak"))


@query(
    f"""WITH {SAMPLES}, f AS (SELECT stream, floor(i / 8) AS frame, avg(abs(x)) AS m, avg(x * x) AS p FROM samples GROUP BY ALL HAVING count(*) = 8),
g AS (SELECT *, median(m) OVER (PARTITION BY stream) AS mid FROM f), h AS (SELECT stream, avg(p) FILTER (m > mid) AS s, avg(p) FILTER (m <= mid) AS q, count(*) AS n FROM g GROUP BY stream)
SELECT stream, round(CASE WHEN n < 2 OR s IS NULL OR q IS NULL OR q < 1e-10 THEN 30.0 ELSE least(60.0, greatest(0.0, 10 * log10(s / q))) END, 5) AS snr FROM h"""
)
def snr_frames(spark, sf):
    return A.snr_of_frames(A.frame_levels(_samples(spark, sf), 8)).select("stream", F.round("snr", 5).alias("snr"))


@query(
    f"""WITH {SAMPLES}, f AS (SELECT stream, CAST(floor(i / 8) AS BIGINT) AS frame, avg(x * x) AS p FROM samples GROUP BY stream, floor(i / 8) HAVING count(*) = 8),
t AS (SELECT stream, arg_max(frame, (p, -frame)) AS top FROM f GROUP BY stream),
d AS (SELECT f.stream, frame, 10 * log10(greatest(sum(p) OVER (PARTITION BY f.stream ORDER BY frame DESC ROWS UNBOUNDED PRECEDING), 1e-10)) AS db FROM f JOIN t ON t.stream = f.stream AND frame >= top)
SELECT stream, frame, round(db - max(db) OVER (PARTITION BY stream), 5) AS db FROM d"""
)
def decay_frames(spark, sf):
    return A.decay_of_frames(A.frame_levels(_samples(spark, sf), 8)).select("stream", "frame", F.round("db", 5).alias("db"))


@query(None)
def array_acoustics(spark, sf):
    s = _samples(spark, sf).groupBy("stream").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda v: v["x"]).alias("x"))
    return s.select("stream", F.round(A.rms(F.col("x")), 6).alias("rms"), F.round(A.peak(F.col("x")), 6).alias("peak"), F.round(A.snr(F.col("x")), 4).alias("snr"), F.round(A.rt60(F.col("x")), 4).alias("rt60"), F.size(A.windows(F.col("x"), 16)).alias("windows"), F.size(A.smoothed_levels(F.col("x"))).alias("levels"))


@query(None)
def enhance_segments(spark, sf):
    s = V.segments(spark, sf).withColumn("is_final", F.col("idx") % 3 > 0).withColumn("snr", (F.col("record") * 37 % 300) / 10).withColumn("rt60", (F.col("record") * 11 % 15) / 10)
    out = L.enhance(s)
    return out.select("record", "idx", "text", "quality_label", F.round("quality_score", 2).alias("quality_score"), "uncertainty.level", F.size("uncertain_spans").alias("spans"), F.size("data_points").alias("points"))
