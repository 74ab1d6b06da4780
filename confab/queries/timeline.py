"""Timeline queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from confab.operators import meeting as M
from confab.operators import timeline as T
from confab.plans import ranges as R
from confab.plans import views as V

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


OV = "greatest(0, least(s.end_ms, t.end_ms) - greatest(s.start_ms, t.start_ms))"
ON = "t.record = s.record AND s.start_ms < t.end_ms AND t.start_ms < s.end_ms"


@query(
    f"""WITH {V.TIMELINE},
p AS (SELECT s.record, s.idx, t.speaker, sum({OV}) AS d, sum({OV} * t.confidence) AS dc FROM segments s JOIN timeline t ON {ON} AND s.end_ms > s.start_ms GROUP BY ALL),
r AS (SELECT *, sum(d) OVER w AS total, count(*) OVER w AS shares, row_number() OVER (PARTITION BY record, idx ORDER BY d DESC, speaker) AS r FROM p WINDOW w AS (PARTITION BY record, idx))
SELECT s.record, s.idx, coalesce(r.speaker, 'UNKNOWN') AS speaker, coalesce(CAST(floor(dc * 10.0 / total + 0.5) AS BIGINT), 0) AS confidence, coalesce(shares, 0) AS shares
FROM segments s LEFT JOIN r ON r.record = s.record AND r.idx = s.idx AND r.r = 1"""
)
def align_speakers(spark, sf):
    return T.align_speakers(V.segments(spark, sf), V.timeline(spark, sf))


WORDS = V.TIMELINE + """,
words AS (SELECT record, idx, w AS word, start_ms + w * 700 AS start_ms, start_ms + w * 700 + 600 AS end_ms FROM (SELECT *, unnest(range(0, (end_ms - start_ms) // 700)) AS w FROM segments))"""


def _words(spark, sf):
    s = V.segments(spark, sf).withColumn("w", F.expr("explode(filter(sequence(0, (end_ms - start_ms) div 700), x -> x < (end_ms - start_ms) div 700))"))
    return s.select("record", "idx", F.col("w").cast("bigint").alias("word"), (F.col("start_ms") + F.col("w") * 700).alias("start_ms"), (F.col("start_ms") + F.col("w") * 700 + 600).alias("end_ms"))


@query(f"WITH {WORDS} SELECT s.record, s.idx, s.word, arg_min(t.speaker, (-({OV}), t.speaker)) AS speaker FROM words s LEFT JOIN timeline t ON {ON} GROUP BY ALL")
def align_words(spark, sf):
    return T.align_words(_words(spark, sf), V.timeline(spark, sf))


MARKED = V.TIMELINE + """,
others AS (SELECT s.record, s.turn, list(t.speaker) AS l FROM timeline s JOIN timeline t ON t.record = s.record AND t.speaker <> s.speaker AND s.start_ms < t.end_ms AND t.start_ms < s.end_ms GROUP BY ALL),
marked AS (SELECT s.*, l IS NOT NULL AS overlap, CASE WHEN l IS NULL THEN [] ELSE list_sort(list_distinct(list_append(l, s.speaker))) END AS who FROM timeline s LEFT JOIN others o ON o.record = s.record AND o.turn = s.turn)"""


@query(f"WITH {MARKED} SELECT record, turn, speaker, start_ms, end_ms, overlap, array_to_string(who, ',') AS overlap_speakers FROM marked")
def mark_overlaps(spark, sf):
    marked = T.mark_overlaps(V.timeline(spark, sf))
    return marked.select("record", "turn", "speaker", "start_ms", "end_ms", "overlap", F.array_join("overlap_speakers", ",").alias("overlap_speakers"))


BOUND = V.SEGMENTS + """,
spans AS (SELECT record, idx // 3 AS idx, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM segments GROUP BY ALL),
turns AS (SELECT record, idx AS turn, speaker, start_ms, end_ms, 50 + idx AS confidence, record % 5 = 0 AS overlap FROM segments)"""


@query(
    f"""WITH {BOUND},
p AS (SELECT s.record, s.idx, t.speaker AS who, t.confidence, greatest(s.start_ms, t.start_ms) AS a, least(s.end_ms, t.end_ms) AS b, max(t.overlap::INT) OVER (PARTITION BY s.record, s.idx) AS o FROM spans s JOIN turns t ON {ON}),
n AS (SELECT *, CASE WHEN lag(who) OVER w = who AND a <= max(b) OVER (PARTITION BY record, idx ORDER BY a, b, who ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 50 THEN 0 ELSE 1 END AS new FROM p WHERE o = 0 WINDOW w AS (PARTITION BY record, idx ORDER BY a, b, who)),
c AS (SELECT *, sum(new) OVER (PARTITION BY record, idx ORDER BY a, b, who ROWS UNBOUNDED PRECEDING) AS clip FROM n),
m AS (SELECT record, idx, CAST(clip AS BIGINT) AS clip, who AS speaker, min(a) AS start_ms, max(b) AS end_ms, min(confidence) AS confidence FROM c GROUP BY record, idx, clip, who)
SELECT * FROM m WHERE (record, idx) IN (SELECT (record, idx) FROM m GROUP BY record, idx HAVING count(DISTINCT speaker) >= 2)"""
)
def boundary_clips(spark, sf):
    s = V.segments(spark, sf)
    spans = s.groupBy("record", F.floor(F.col("idx") / 3).alias("idx")).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    turns = s.select("record", F.col("idx").alias("turn"), "speaker", "start_ms", "end_ms", (F.col("idx") + 50).alias("confidence"), (F.col("record") % 5 == 0).alias("overlap"))
    return T.boundary_clips(spans, turns)


@query(
    f"""WITH {V.TIMELINE}
SELECT s.record, s.idx, min(t.turn) AS heard_idx FROM segments s JOIN timeline t ON t.record = s.record AND t.start_ms * 2 <= s.start_ms + s.end_ms AND s.start_ms + s.end_ms <= t.end_ms * 2 GROUP BY ALL"""
)
def midpoint_match(spark, sf):
    return T.midpoint_match(V.segments(spark, sf), V.timeline(spark, sf).withColumnRenamed("turn", "idx"))


REGIONS = V.FRAMES + ",\nregions AS (SELECT stream, us // 1000 AS start_ms, us // 1000 + 3600000 AS end_ms FROM frames)"


def _regions(spark, sf):
    f = V.frames(spark, sf)
    start = F.floor(F.col("us") / 1000)
    return f.select("stream", start.alias("start_ms"), (start + 3_600_000).alias("end_ms"))


def _islands(table_: str, gap: int, op: str) -> str:
    return f"""b AS (SELECT *, max(end_ms) OVER (PARTITION BY stream ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM {table_}),
i AS (SELECT *, sum(CASE WHEN p IS NULL OR start_ms - p {op} {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS i FROM b)
SELECT stream, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n FROM i GROUP BY stream, i"""


@query(f"WITH {REGIONS}, padded AS (SELECT stream, greatest(0, start_ms - 250000) AS start_ms, end_ms + 450000 AS end_ms FROM regions),\n{_islands('padded', 0, '>')}")
def vad_merge(spark, sf):
    return T.pad_and_merge(_regions(spark, sf), 250_000, 450_000, ["stream"])


@query(f"WITH {REGIONS},\n{_islands('regions', 20_000_000, '>=')}")
def silence_spans(spark, sf):
    return T.silence_spans(_regions(spark, sf), ["stream"], 20_000_000)


@query(f"WITH {V.FRAMES} SELECT stream, min(us) AS first_us, max(us) AS last_us, count(*) AS n FROM (SELECT *, sum(CASE WHEN p IS NULL OR us - p >= 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY us ROWS UNBOUNDED PRECEDING) AS i FROM (SELECT *, lag(us) OVER (PARTITION BY stream ORDER BY us) AS p FROM frames)) GROUP BY stream, i")
def session_islands(spark, sf):
    f = V.frames(spark, sf).select("stream", F.col("us").alias("first_us"), F.col("us").alias("last_us"))
    return R.merge_islands(f, ["stream"], "first_us", "last_us", 21_600_000_000, closed=False)


GAPS = V.FRAMES + ", kept AS (SELECT stream, seq, us, event_id FROM frames WHERE event_id % 5 <> 0)"


@query(f"WITH {GAPS} SELECT stream, count(*) AS frames, CAST(coalesce(sum(CASE WHEN d > 1 THEN d - 1 END), 0) AS BIGINT) AS dropped, count(*) FILTER (d <= 0) AS errors FROM (SELECT *, seq - lag(seq) OVER (PARTITION BY stream ORDER BY us, event_id) AS d FROM kept) GROUP BY stream")
def seq_gaps(spark, sf):
    return T.sequence_gaps(V.frames(spark, sf).where("event_id % 5 <> 0"))


@query(f"WITH {V.FRAMES} SELECT stream, seq, kind FROM (SELECT *, lag(kind) OVER (PARTITION BY stream ORDER BY seq) AS b FROM frames) WHERE b IS NULL OR b <> kind")
def emit_on_change(spark, sf):
    return T.emit_on_change(V.frames(spark, sf), ["stream"], "seq", "kind").select("stream", "seq", "kind")


LOCAL = V.SEGMENTS + """,
local AS (SELECT record, idx // 3 AS chunk, speaker, (idx // 3) * 60000 AS core_start_ms, (idx // 3) * 60000 + 60000 AS core_end_ms, greatest(0, (idx // 3) * 60000 - 2000) AS audio_start_ms, (end_ms - start_ms) % 50000 AS start_ms, (end_ms - start_ms) % 50000 + 15000 AS end_ms, 80 AS confidence FROM segments)"""
RESTORED = LOCAL + """,
restored AS (SELECT record, chunk, CAST(chunk AS VARCHAR) || ':' || speaker AS speaker, greatest(core_start_ms, audio_start_ms + start_ms) AS start_ms, least(core_end_ms, audio_start_ms + end_ms) AS end_ms, confidence FROM local
  WHERE least(core_end_ms, audio_start_ms + end_ms) - greatest(core_start_ms, audio_start_ms + start_ms) >= 100)"""


def _local(spark, sf):
    chunk = F.floor(F.col("idx") / 3)
    d = F.col("end_ms") - F.col("start_ms")
    return V.segments(spark, sf).select(
        "record", chunk.alias("chunk"), "speaker", (chunk * 60000).alias("core_start_ms"), (chunk * 60000 + 60000).alias("core_end_ms"), F.greatest(F.lit(0), chunk * 60000 - 2000).alias("audio_start_ms"),
        (d % 50000).alias("start_ms"), (d % 50000 + 15000).alias("end_ms"), F.lit(80).alias("confidence"),
    )


@query(f"WITH {RESTORED} SELECT * FROM restored")
def restore_global_time(spark, sf):
    return T.restore_global_time(_local(spark, sf))


@query(
    f"""WITH {RESTORED}, f AS (SELECT record, split_part(speaker, ':', 2) AS suffix, min((start_ms, speaker)) AS f FROM restored GROUP BY ALL),
n AS (SELECT record, suffix, 'SPEAKER_' || lpad(CAST(row_number() OVER (PARTITION BY record ORDER BY f) - 1 AS VARCHAR), 2, '0') AS name FROM f)
SELECT r.record, r.chunk, r.start_ms, r.end_ms, r.confidence, n.name AS speaker FROM restored r JOIN n ON n.record = r.record AND n.suffix = split_part(r.speaker, ':', 2)"""
)
def stitch_by_suffix(spark, sf):
    turns = T.restore_global_time(_local(spark, sf))
    return T.remap_speakers(turns, T.global_names(turns))


def _spread(spark, sf):
    """Segments twenty times as long with silences between, so that records need chunks."""
    s = V.segments(spark, sf)
    return s.select("record", (F.col("start_ms") * 20 + F.col("idx") * 15000).alias("start_ms"), (F.col("end_ms") * 20 + F.col("idx") * 15000).alias("end_ms"), F.lit(100_000_000).cast("bigint").alias("duration_ms"))


def _cut(at: str) -> str:
    near = f"list_filter(sil, lambda x: x > {at} + 500 AND x <= {at} + 480000 AND abs(x - ({at} + 300000)) <= 60000)"
    best = f"list_sort(list_transform({near}, lambda x: {{'d': abs(x - ({at} + 300000)), 'x': x}}))[1].x"
    return f"CASE WHEN z - {at} > 480000 THEN coalesce({best}, {at} + 300000) ELSE z END"


CHUNKS = V.SEGMENTS + f""",
regions AS (SELECT record, start_ms * 20 + idx * 15000 AS s, end_ms * 20 + idx * 15000 AS e FROM segments WHERE end_ms > start_ms),
gaps AS (SELECT *, lag(e) OVER (PARTITION BY record ORDER BY s, e) AS p FROM regions),
numbered AS (SELECT *, sum(CASE WHEN s - p >= 20000 THEN 1 ELSE 0 END) OVER (PARTITION BY record ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM gaps),
spans AS (SELECT record, island, min(s)::DOUBLE AS a, arg_max(e, (s, e))::DOUBLE AS z, coalesce(list((p + s) / 2.0 ORDER BY s) FILTER (s > p AND s - p < 20000), []) AS sil FROM numbered GROUP BY record, island),
cuts AS (SELECT record, island, a AS cur, z, sil, {_cut("a")} AS nxt FROM spans UNION ALL SELECT record, island, nxt AS cur, z, sil, {_cut("nxt")} AS nxt FROM cuts WHERE nxt < z),
chunks AS (SELECT record, row_number() OVER (PARTITION BY record ORDER BY island, cur) - 1 AS chunk, CAST(floor(cur) AS BIGINT) AS core_start_ms, CAST(floor(nxt) AS BIGINT) AS core_end_ms,
  CAST(greatest(0, floor(cur) - 2000) AS BIGINT) AS audio_start_ms, CAST(least(100000000, floor(nxt) + 2000) AS BIGINT) AS audio_end_ms FROM cuts)"""


@query(f"WITH RECURSIVE {CHUNKS} SELECT * FROM chunks")
def chunk_plan(spark, sf):
    return T.plan_chunks(_spread(spark, sf))


@query(
    f"""WITH RECURSIVE {CHUNKS}, t AS (SELECT record, count(*) AS chunks, CAST(sum(audio_end_ms - audio_start_ms) AS BIGINT) AS processed_ms, CAST(sum(core_end_ms - core_start_ms) AS BIGINT) AS core FROM chunks GROUP BY record)
SELECT r.record, coalesce(chunks, 0) AS chunks, coalesce(processed_ms, 0) AS processed_ms, greatest(0, 100000000 - coalesce(core, 0)) AS skipped_ms FROM (SELECT DISTINCT record FROM segments) r LEFT JOIN t ON t.record = r.record"""
)
def chunk_statistics(spark, sf):
    regions = _spread(spark, sf)
    return T.chunk_statistics(T.plan_chunks(regions), regions.select("record", "duration_ms").distinct())


@query(None)
def smooth_timeline(spark, sf):
    return T.smooth_timeline(V.timeline(spark, sf))


@query(
    f"""WITH RECURSIVE {V.SEGMENTS},
o AS (SELECT record, idx, length(text) AS n, row_number() OVER (PARTITION BY record ORDER BY idx) AS k FROM segments),
w AS (SELECT record, idx, n, k, 0 AS chunk, n AS size FROM o WHERE k = 1
  UNION ALL SELECT o.record, o.idx, o.n, o.k, CASE WHEN w.size > 0 AND w.size + o.n > 3000 THEN w.chunk + 1 ELSE w.chunk END, CASE WHEN w.size > 0 AND w.size + o.n > 3000 THEN o.n ELSE w.size + o.n END FROM w JOIN o ON o.record = w.record AND o.k = w.k + 1)
SELECT record, idx, CAST(chunk AS BIGINT) AS chunk, CAST(n AS BIGINT) AS chars FROM w"""
)
def pack_chunks(spark, sf):
    return T.pack_segments(V.segments(spark, sf), 3000)


ECHOED = V.SEGMENTS + """,
echoed AS (SELECT record, idx, row_number() OVER (PARTITION BY record ORDER BY idx) AS k, CASE WHEN idx % 2 = 1 THEN right(lag(text) OVER (PARTITION BY record ORDER BY idx), 12) || text ELSE text END AS text FROM segments)"""


@query(
    f"""WITH RECURSIVE {ECHOED},
r AS (SELECT record, idx, k, text FROM echoed WHERE k = 1
UNION ALL SELECT e.record, e.idx, e.k, CASE WHEN n IS NULL THEN e.text ELSE ltrim(e.text[n + 1 :], ' ' || chr(10)) END
  FROM (SELECT e.*, list_max(list_filter(range(3, CAST(least(40, length(r.text), length(e.text)) AS BIGINT) + 1), lambda x: right(r.text, x) = left(e.text, x))) AS n FROM r JOIN echoed e ON e.record = r.record AND e.k = r.k + 1) e)
SELECT record, idx, text FROM r"""
)
def deduplicate_adjacent(spark, sf):
    before = F.right(F.lag("text").over(Window.partitionBy("record").orderBy("idx")), F.lit(12))
    s = V.segments(spark, sf).withColumn("text", F.when(F.col("idx") % 2 == 1, F.concat(before, F.col("text"))).otherwise(F.col("text")))
    return T.deduplicate_adjacent(s)


@query(None)
def snapshot_timeline(spark, sf):
    s = V.segments(spark, sf).where("record < 20")
    both = s.select("record", "idx", (F.col("end_ms") / 1000).alias("second"), F.col("text").alias("t"))
    sofar = both.alias("a").join(both.alias("b"), (F.col("a.record") == F.col("b.record")) & (F.col("b.idx") <= F.col("a.idx")))
    text = F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("b.idx", "b.t"))), lambda x: x["t"]))
    return T.snapshot_timeline(sofar.groupBy("a.record", "a.idx", "a.second").agg(text.alias("text")).select("record", "second", "text"))


@query(None)
def meeting_pipeline(spark, sf):
    segments, turns = V.segments(spark, sf), M.speaker_timeline(V.timeline(spark, sf))
    heard = lambda record, start, end: F.concat_ws("-", record.cast("string"), start.cast("string"), end.cast("string"))
    return M.meeting_report(M.attribute(segments, turns, heard))
