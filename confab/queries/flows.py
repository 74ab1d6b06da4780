"""Queries of live audio, jobs, summaries, settings and codecs."""

from __future__ import annotations

from pyspark.sql import functions as F

from confab.functions import cleanup as C
from confab.functions import hotwords as H
from confab.functions import plugins as P
from confab.operators import settings as G
from confab.operators import summarize as Z
from confab.plans import views as V
from confab.sources import readers as R
from confab.sources import sinks as K
from confab.sources.tables import table
from confab.streaming import live as L
from confab.streaming import machines as M

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _live(spark, sf):
    f = V.frames(spark, sf)
    return f.select("stream", "seq", "us", (F.col("rms") / 1000).alias("rms"), F.lit(640).alias("samples"), F.concat(F.lit("t"), F.floor(F.col("seq") / 3).cast("string")).alias("text"), F.lit(False).alias("end"))


@query(f"WITH {V.FRAMES} SELECT stream, count(*) AS frames, count(*) * 640 AS samples, min(us) AS first_us, max(us) AS last_us, max(seq) AS last_seq FROM frames GROUP BY stream")
def live_metrics(spark, sf):
    return L.live_metrics(_live(spark, sf))


@query(
    f"""WITH RECURSIVE {V.FRAMES}, f AS (SELECT stream, seq, rms / 1000 >= 0.03 AS v FROM frames),
r AS (SELECT DISTINCT stream, CAST(0 AS BIGINT) AS seq, false AS a, 0 AS sp, 0 AS si, false AS started, false AS ended FROM f
UNION ALL SELECT f.stream, f.seq,
  CASE WHEN r.a THEN NOT (NOT f.v AND r.si + 640 >= 1280) ELSE f.v AND r.sp + 640 >= 1280 END,
  CASE WHEN r.a THEN CASE WHEN NOT f.v AND r.si + 640 >= 1280 THEN 0 ELSE r.sp END WHEN f.v THEN r.sp + 640 ELSE 0 END,
  CASE WHEN r.a AND NOT f.v AND r.si + 640 < 1280 THEN r.si + 640 ELSE 0 END,
  NOT r.a AND f.v AND r.sp + 640 >= 1280, r.a AND NOT f.v AND r.si + 640 >= 1280
  FROM r JOIN f ON f.stream = r.stream AND f.seq = r.seq + 1)
SELECT CAST(stream AS VARCHAR) AS stream, seq, a AS speaking, started, ended FROM r WHERE seq > 0"""
)
def energy_vad(spark, sf):
    return L.energy_vad(_live(spark, sf), M.VadParams(threshold=0.03, min_speech=1280, min_silence=1280))


@query(None)
def live_sessions(spark, sf):
    return L.live_sessions(_live(spark, sf), M.SessionParams(M.VadParams(0.03, 1280, 1280), pre_roll=1280, grace=640))


@query(f"WITH {V.FRAMES}, b AS (SELECT stream, us, lag(us) OVER (PARTITION BY stream ORDER BY us) AS p FROM frames), i AS (SELECT stream, us, sum(CASE WHEN p IS NULL OR us - p > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY us ROWS UNBOUNDED PRECEDING) AS i FROM b) SELECT stream, min(us) AS start_us, max(us) + 21600000000 AS end_us, count(*) AS n FROM i GROUP BY stream, i")
def session_windows(spark, sf):
    w = L.session_windows(_live(spark, sf), "6 hours")
    return w.select("stream", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query(f"WITH {V.FRAMES} SELECT stream, seq FROM frames WHERE seq = 1 OR seq % 5 = 0")
def sampled_chunks(spark, sf):
    return L.sampled_chunks(_live(spark, sf)).select("stream", "seq")


JOBS = V.FRAMES + ", jobs AS (SELECT stream AS job, us, CASE kind WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS status, rms AS progress FROM frames)"


def _jobs(spark, sf):
    status = F.when(F.col("kind") == "purchase", "completed").when(F.col("kind") == "error", "failed").otherwise("running")
    return V.frames(spark, sf).select(F.col("stream").alias("job"), "us", status.alias("status"), F.col("rms").alias("progress"))


@query(
    f"""WITH {JOBS}, r AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY (status IN ('completed', 'failed')) DESC, CASE WHEN status IN ('completed', 'failed') THEN -us ELSE us END DESC) AS r, max(us) OVER (PARTITION BY job) AS last_us, count(*) OVER (PARTITION BY job) AS events FROM jobs)
SELECT job, status, progress, last_us, events FROM r WHERE r = 1"""
)
def job_states(spark, sf):
    return L.job_states(_jobs(spark, sf))


@query(f"WITH {V.FRAMES} SELECT stream, segment, us, is_canonical FROM (SELECT stream, seq // 4 AS segment, us, seq % 4 = 2 AS is_canonical, row_number() OVER (PARTITION BY stream, seq // 4 ORDER BY (seq % 4 = 2) DESC, us DESC) AS r FROM frames) WHERE r = 1")
def canonical_text(spark, sf):
    f = _live(spark, sf).select("stream", F.floor(F.col("seq") / 4).alias("segment"), "us", (F.col("seq") % 4 == 2).alias("is_canonical"), "text")
    return L.canonical_text(f).drop("text")


@query(f"WITH {V.FRAMES} SELECT service, us FROM (SELECT stream AS service, us, lag(us) OVER (PARTITION BY stream ORDER BY us) AS b FROM frames) WHERE b IS NULL OR us - b >= 7200000000")
def coalesced_reloads(spark, sf):
    return L.coalesced_reloads(V.frames(spark, sf).select(F.col("stream").alias("service"), "us"), 7_200_000_000)


@query(None)
def microphone_events(spark, sf):
    names = list(M.MICROPHONE)
    event = F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % len(names)).cast("int") + 1)
    return L.legal_transitions(V.frames(spark, sf).select(F.col("stream").alias("client"), "us", event.alias("event"), F.floor(F.col("seq") / 10).alias("token")))


@query(
    f"""WITH {V.SEGMENTS} SELECT record, string_agg('[' || lpad(CAST(start_ms // 60000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(start_ms // 1000 % 60 AS VARCHAR), 2, '0') || '] ' || speaker || ': ' || text, chr(10) ORDER BY idx) AS transcript FROM segments GROUP BY record"""
)
def transcript_lines(spark, sf):
    return Z.transcript_lines(V.segments(spark, sf))


@query("WITH l AS (SELECT doc_id AS record, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents) SELECT record, i - 1 AS idx, (i - 1) * 10000 AS start_ms, l[i] AS text FROM (SELECT record, l, unnest(range(1, len(l) + 1)) AS i FROM l)")
def text_to_segments(spark, sf):
    return Z.text_to_segments(table(spark, sf, "documents").select(F.col("doc_id").alias("record"), "text"))


@query(
    """WITH t AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(trim(x), '^\\[[^\\]]*\\]', ''))), lambda x: x <> ''), ' ') AS j FROM documents),
h AS (SELECT doc_id, j, regexp_extract(left(j, 360), '(?s)^(.*[。！？.!?])', 1) AS head FROM t)
SELECT doc_id, CASE WHEN length(j) <= 360 THEN j ELSE rtrim(CASE WHEN length(head) > 180 THEN head ELSE left(j, 360) END) || '…' END AS overview FROM h"""
)
def overview(spark, sf):
    return table(spark, sf, "documents").select("doc_id", Z.overview(F.col("text")).alias("overview"))


@query(None)
def summarize_records(spark, sf):
    return Z.summarize_records(V.segments(spark, sf), P.factory("summarizer", "first-lines"), 3000)


@query(None)
def summarize_many(spark, sf):
    r = V.records(spark, sf).where("id < 200")
    items = r.select((F.col("id") % 10).alias("summary_id"), F.col("id").alias("record_id"), F.col("id").alias("sort_order"))
    return Z.summarize_many(items, r, P.factory("summarizer", "first-lines"))


@query(None)
def summary_sections(spark, sf):
    answers = Z.summarize_records(V.segments(spark, sf).where("record < 30"), P.factory("summarizer", "first-lines"), 3000)
    return answers.select("record", Z.rendered(F.col("answer")).alias("markdown"), F.size(Z.schema_errors(F.col("answer"), Z.SINGLE_SCHEMA)).alias("errors"))


NODES = "nodes AS (SELECT n_regionkey AS diagram, 'n' || CAST(n_nationkey AS VARCHAR) AS id, CASE WHEN n_nationkey < 8 THEN NULL ELSE 'n' || CAST((n_nationkey * 7 + 3) % n_nationkey AS VARCHAR) END AS parent, n_nationkey AS pos FROM nation)"


@query(
    f"""WITH RECURSIVE {NODES}, own AS (SELECT 1 AS diagram, id, parent, pos FROM nodes),
w AS (SELECT diagram, id, 0 AS depth, lpad(CAST(pos AS VARCHAR), 6, '0') AS path FROM own WHERE parent IS NULL
UNION ALL SELECT o.diagram, o.id, w.depth + 1, w.path || '/' || lpad(CAST(o.pos AS VARCHAR), 6, '0') FROM w JOIN own o ON o.diagram = w.diagram AND o.parent = w.id)
SELECT diagram, id, depth, path FROM w"""
)
def diagram_tree(spark, sf):
    n = F.col("n_nationkey")
    parent = F.when(n >= 8, F.concat(F.lit("n"), ((n * 7 + 3) % n).cast("string")))
    return Z.tree_paths(table(spark, sf, "nation").select(F.lit(1).alias("diagram"), F.concat(F.lit("n"), n.cast("string")).alias("id"), parent.alias("parent"), n.alias("pos")))


@query(
    "SELECT o_orderkey AS id, CASE WHEN p IN ('meeting', 'balanced', 'low-latency', 'quality') THEN p ELSE 'meeting' END AS profile FROM (SELECT o_orderkey, CASE l WHEN 'fast' THEN 'low-latency' WHEN 'high' THEN 'quality' WHEN 'default' THEN 'meeting' WHEN 'low-latency' THEN 'low-latency' ELSE l END AS p FROM (SELECT o_orderkey, replace(lower(trim([' Fast', 'low_latency', 'quality', 'none', 'HIGH'][1 + o_orderkey % 5])), '_', '-') AS l FROM orders))"
)
def resolved_profile(spark, sf):
    names = F.array(*map(F.lit, (" Fast", "low_latency", "quality", "none", "HIGH")))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), G.resolved_profile(F.element_at(names, (F.col("o_orderkey") % 5).cast("int") + 1)).alias("profile"))


@query("SELECT p_brand AS model, p_type AS file FROM part GROUP BY ALL EXCEPT SELECT p_brand, p_type FROM part WHERE p_size > 47")
def missing_files(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_brand").alias("model"), F.col("p_type").alias("file"), "p_size")
    return G.missing_files(part.select("model", "file").distinct(), part.where("p_size > 47"))


@query("SELECT event_id, round(least(greatest(value / 50, 0.05), 0.95), 3) AS vad_threshold, CASE WHEN event_type = 'click' THEN 'dark' ELSE 'system' END AS theme FROM events")
def normalized_settings(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.col("value") / 50).alias("vad_threshold"), F.when(F.col("event_type") == "click", " Dark").otherwise(F.col("event_type")).alias("theme"))
    return G.normalized_settings(e)


@query(None)
def decoded_frames(spark, sf):
    payload = F.concat(F.encode(F.lit("DTP2"), "utf-8"), F.unhex(F.lit("07000000")), F.encode(F.repeat(F.lit("ab"), (F.col("event_id") % 5).cast("int")), "utf-8"))
    e = table(spark, sf, "events").select("event_id", R.decoded_frames(payload).alias("f"))
    return e.select("event_id", "f.seq", "f.version", F.size("f.samples").alias("n"), "f.error")


@query(None)
def assembled_recordings(spark, sf):
    f = V.frames(spark, sf).where("stream < 20").select("stream", "seq", F.array(F.col("rms") / 100, F.col("rms") / 200).alias("samples"))
    return K.assemble_recordings(f).select("stream", "samples", F.length("wav").alias("bytes"))


@query("SELECT doc_id, 'attachment; filename=\"doc ' || CAST(doc_id AS VARCHAR) || '.md\"; filename*=UTF-8''''doc%20' || CAST(doc_id AS VARCHAR) || '.md' AS header FROM documents")
def download_headers(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", K.disposition(F.concat(F.lit("doc "), F.col("doc_id").cast("string")), "md").alias("header"))


@query(None)
def hotword_rewrite(spark, sf):
    words = H.HotwordRewriter(["The", "OpenAI", "BERT", "世界银行"])
    s = V.segments(spark, sf)
    return s.select("record", "idx", words.rewrite(F.col("text")).alias("r"), words.matched_terms(F.col("text")).alias("terms")).select("record", "idx", "r.text", F.size("r.corrections").alias("edits"), "terms")


@query("SELECT doc_id, array_to_string(list_filter(['and the', 'tion', 'que', 'ung'], lambda w: contains(lower(text), w)), ',') AS terms FROM documents")
def term_match(spark, sf):
    words = H.HotwordRewriter(["tion", "que", "ung", "and the"])
    return table(spark, sf, "documents").select("doc_id", F.array_join(words.matched_terms(F.col("text")), ",").alias("terms"))


@query(
    "SELECT s_suppkey AS id, regexp_replace(regexp_replace(regexp_replace(r, '^([zcs])h', '\\1'), '^n', 'l'), '(i|e|a)ng$', '\\1n') AS key FROM (SELECT s_suppkey, ['shi', 'niu', 'jing', 'zhang', 'chuan', 'neng'][1 + s_suppkey % 6] AS r FROM supplier)"
)
def fuzzy_keys(spark, sf):
    r = F.element_at(F.array(*map(F.lit, ("shi", "niu", "jing", "zhang", "chuan", "neng"))), (F.col("s_suppkey") % 6).cast("int") + 1)
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), H.fuzzy_key_column(r).alias("key"))


@query(f"WITH {V.SEGMENTS} SELECT record, idx, upper(left(text, 1)) || lower(substr(text, 2)) AS text FROM segments")
def capitalized(spark, sf):
    return V.segments(spark, sf).select("record", "idx", C.cased(F.col("text"), "capitalize").alias("text"))
