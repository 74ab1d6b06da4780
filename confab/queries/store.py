"""Store and search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from confab.operators import store as S
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


@query(
    f"""WITH {V.SEGMENTS},
t AS (SELECT record, speaker, sum(end_ms - start_ms) AS d FROM segments GROUP BY ALL),
top AS (SELECT record, count(*) AS n_speakers, arg_min(speaker, (-d, speaker)) AS top_speaker FROM t GROUP BY record),
f AS (SELECT record, count(*) AS n_segments, max(end_ms) AS duration_ms,
             coalesce(string_agg('[' || coalesce(nullif(trim(speaker), ''), 'UNKNOWN') || '] ' || trim(text), chr(10) ORDER BY idx) FILTER (trim(text) <> ''), '') AS full_text FROM segments GROUP BY record)
SELECT record AS conv_id, n_segments, duration_ms, n_speakers, top_speaker, full_text FROM f JOIN top USING (record)"""
)
def record_report(spark, sf):
    return S.record_report(V.segments(spark, sf))


@query(f"WITH {V.RECORDS} SELECT id, title, filename, substr(full_text, 1, 500) AS preview, coalesce(created_by, -1) AS created_by, status, updated_at, n_chars, lang FROM records WHERE title ILIKE '%the%' OR filename ILIKE '%the%' OR full_text ILIKE '%the%'")
def search_records(spark, sf):
    found = S.record_preview(S.search(V.records(spark, sf), "the", ["title", "filename", "full_text"]))
    return found.withColumn("created_by", F.coalesce("created_by", F.lit(-1)))


@query(f"WITH {V.RECORDS}, f AS (SELECT * FROM records WHERE (created_by IS NULL OR created_by = 7) AND lang = 'en') SELECT id, title, updated_at, (SELECT count(*) FROM f) AS total FROM f ORDER BY updated_at DESC, id LIMIT 20 OFFSET 20")
def page_records(spark, sf):
    own = S.owned_by(V.records(spark, sf), 7).where("lang = 'en'").select("id", "title", "updated_at")
    return S.page(own, [F.desc("updated_at"), F.col("id")], 20, 20)


@query(f"WITH {V.USERS} SELECT id, username, display_name, role, status FROM users WHERE status <> 'deleted' AND username ILIKE '%00001%' AND id <> 11 ORDER BY id DESC LIMIT 20")
def search_users(spark, sf):
    return S.search_users(V.users(spark, sf), "00001", 11)


@query(f"WITH {V.USERS} SELECT id, username, display_name, role, status FROM users WHERE status = 'active'")
def active_users(spark, sf):
    return S.public_user(S.active(V.users(spark, sf)))


@query(f"WITH {V.RESERVATIONS},\n{V.PARTICIPANTS} SELECT id, title, organizer, status FROM reservations r WHERE organizer = 7 OR EXISTS (SELECT 1 FROM participants p WHERE p.meeting = r.id AND p.person = 7)")
def visible_reservations(spark, sf):
    return S.visible_reservations(V.reservations(spark, sf), V.participants(spark, sf), 7).select("id", "title", "organizer", "status")


@query(
    f"""WITH {V.USERS},\n{V.RESERVATIONS},\n{V.PARTICIPANTS}
SELECT r.id, r.organizer, o.display_name AS organizer_name, coalesce(p.n, 0) AS n_people, coalesce(p.names, '') AS names
FROM reservations r LEFT JOIN users o ON o.id = r.organizer
LEFT JOIN (SELECT meeting, count(*) AS n, string_agg(display_name, ';' ORDER BY display_name, username, person) AS names FROM participants JOIN users u ON u.id = person GROUP BY meeting) p ON p.meeting = r.id"""
)
def reservation_people(spark, sf):
    joined = S.reservation_people(V.reservations(spark, sf), V.participants(spark, sf), V.users(spark, sf))
    return joined.select("id", "organizer", "organizer_name", F.size("people").cast("bigint").alias("n_people"), F.array_join("people.display_name", ";").alias("names"))


@query(
    f"""WITH {V.PEOPLE}
SELECT p.meeting, p.person FROM participants p JOIN reservations r ON r.id = p.meeting
WHERE p.person <> r.organizer AND NOT EXISTS (SELECT 1 FROM friends f JOIN users u ON u.id = f.friend WHERE f."user" = r.organizer AND f.friend = p.person AND u.status = 'active')"""
)
def invalid_participants(spark, sf):
    return S.invalid_participants(V.reservations(spark, sf), V.participants(spark, sf), V.users(spark, sf), V.friends(spark, sf))


@query(f'WITH {V.PEOPLE} SELECT f."user", f.friend, u.username, u.display_name FROM friends f JOIN users u ON u.id = f.friend WHERE u.status <> \'deleted\'')
def friends_of(spark, sf):
    return S.friends_of(V.friends(spark, sf), V.users(spark, sf))


@query(f'WITH {V.PEOPLE} SELECT f."user", f.friend, coalesce(u.username, \'\') AS username, coalesce(u.display_name, \'\') AS display_name FROM friends f LEFT JOIN users u ON u.id = f.friend')
def friends_of_remote(spark, sf):
    return S.friends_of(V.friends(spark, sf), V.users(spark, sf), keep_missing=True)


@query(f"WITH {V.USERS}, s AS (SELECT DISTINCT user_id FROM events) SELECT u.id AS user_id, u.username, u.role FROM s JOIN users u ON u.id = s.user_id WHERE u.status = 'active'")
def session_users(spark, sf):
    sessions = table(spark, sf, "events").select("user_id").distinct()
    return S.session_users(sessions, V.users(spark, sf)).select("user_id", "username", "role")


@query(
    f"""WITH {V.RECORDS}, items AS (SELECT id AS record_id, CASE WHEN id % 3 = 0 THEN updated_at - 1 ELSE updated_at END AS snapshot FROM records)
SELECT record_id, snapshot, updated_at AS current_version FROM items JOIN records ON id = record_id WHERE snapshot <> updated_at"""
)
def stale_summaries(spark, sf):
    r = V.records(spark, sf)
    items = r.select(F.col("id").alias("record_id"), F.when(F.col("id") % 3 == 0, F.col("updated_at") - 1).otherwise(F.col("updated_at")).alias("snapshot"))
    return S.stale(items, r)


@query(
    f"""WITH {V.RECORDS}, w AS (SELECT DISTINCT id * 3 AS id FROM records WHERE id BETWEEN 1 AND 19)
SELECT w.id, CASE WHEN (SELECT count(*) FROM w) > 20 THEN 'too many' WHEN r.id IS NULL THEN 'missing' WHEN created_by IS NOT NULL AND created_by <> 9 THEN 'forbidden'
  WHEN status <> 'completed' THEN 'not completed' WHEN trim(coalesce(full_text, '')) = '' THEN 'empty' ELSE 'ok' END AS reason
FROM w LEFT JOIN records r ON r.id = w.id"""
)
def summary_eligibility(spark, sf):
    r = V.records(spark, sf)
    wanted = r.where("id between 1 and 19").select((F.col("id") * 3).alias("id"))
    return S.summary_eligibility(wanted, r, 9)


NOW = 796_000_000_000_000  # microseconds, in the middle of the order dates


@query(f"WITH {V.RESERVATIONS} SELECT id, CASE WHEN {NOW} < start_us THEN 'upcoming' WHEN {NOW} > end_us THEN 'ended' ELSE 'running' END AS time_status FROM reservations")
def time_status(spark, sf):
    return V.reservations(spark, sf).select("id", S.time_status(F.col("start_us"), F.col("end_us"), F.lit(NOW)).alias("time_status"))


PRESETS = "presets AS (SELECT DISTINCT p_brand AS preset, p_type AS word FROM part), enabled AS (SELECT DISTINCT p_type AS word FROM part WHERE p_size < 30)"


def _presets(spark, sf):
    p = table(spark, sf, "part").withColumn("word", F.col("p_type"))
    return p.select(F.col("p_brand").alias("preset"), "word").distinct(), p.where("p_size < 30").select("word").distinct()


@query(f"WITH {PRESETS} SELECT preset, count(*) AS words FROM presets GROUP BY preset HAVING count(*) = count(*) FILTER (word IN (SELECT word FROM enabled))")
def preset_selected(spark, sf):
    return S.complete_presets(*_presets(spark, sf))


@query(f"WITH {PRESETS}, o AS (SELECT word FROM presets WHERE preset = 'Brand#11') SELECT word FROM enabled UNION SELECT word FROM o")
def preset_toggle_on(spark, sf):
    presets, enabled = _presets(spark, sf)
    return S.toggle_preset(enabled, presets, "Brand#11", True)


@query(
    """SELECT c_mktsegment AS list, lower(split_part(c_name, '#', 1)) AS key, min(c_custkey) AS pos FROM customer
GROUP BY ALL"""
)
def hotword_first_wins(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("list"), F.lower(F.split_part("c_name", F.lit("#"), F.lit(1))).alias("key"), F.col("c_custkey").alias("pos"))
    return S.first_of_each(c, F.concat_ws("|", "list", "key"), "pos")


@query(f"WITH {V.SEGMENTS} SELECT record, count(*) AS n_segments, max(end_ms) AS duration_ms, max(idx) + 1 AS next_idx FROM segments GROUP BY record")
def record_stats(spark, sf):
    return S.record_stats(V.segments(spark, sf))


@query(f"WITH {V.TIMELINE} SELECT record, speaker, CAST(sum(end_ms - start_ms) AS BIGINT) AS duration_ms, count(*) AS turns, CAST(floor(sum(confidence) * 1000.0 / count(*) + 0.5) AS BIGINT) AS confidence_milli FROM timeline GROUP BY ALL")
def speaker_roster(spark, sf):
    return S.speaker_roster(V.timeline(spark, sf))


@query(f"WITH {V.FRAMES} SELECT kind, count(*) AS n FROM frames GROUP BY kind")
def type_counts(spark, sf):
    return S.type_counts(V.frames(spark, sf))


@query("SELECT count(*) FILTER (o_orderstatus = 'O') AS queued, count(*) FILTER (o_orderstatus = 'P') AS running, count(*) AS total FROM orders")
def job_counts(spark, sf):
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "F", "completed").otherwise("decoding")
    return S.jobs_by_class(table(spark, sf, "orders").select(status.alias("status")))


@query("SELECT l_suppkey AS utt, l_returnflag || '_' || l_linestatus AS ys, count(*) AS merged, round(max(x) + ln(sum(exp(x - m))), 6) AS log_prob FROM (SELECT *, -l_quantity AS x, max(-l_quantity) OVER (PARTITION BY l_suppkey, l_returnflag, l_linestatus) AS m FROM lineitem) GROUP BY ALL")
def merge_hypotheses(spark, sf):
    h = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("utt"), F.concat_ws("_", "l_returnflag", "l_linestatus").alias("ys"), (-F.col("l_quantity")).alias("log_prob"))
    return S.merge_hypotheses(h).withColumn("log_prob", F.round("log_prob", 6))


@query("SELECT utt, ys, rank FROM (SELECT l_suppkey AS utt, CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR) AS ys, row_number() OVER (PARTITION BY l_suppkey ORDER BY -l_quantity DESC, CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR)) AS rank FROM lineitem) WHERE rank <= 4")
def beam_top_k(spark, sf):
    h = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("utt"), F.concat_ws("_", "l_orderkey", "l_linenumber").alias("ys"), (-F.col("l_quantity")).alias("log_prob"))
    return S.beam(h, 4).select("utt", "ys", F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {V.FRAMES} SELECT stream, seq, event_id FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY seq DESC) AS r FROM frames) WHERE r <= 20")
def event_replay(spark, sf):
    return S.last_per_key(V.frames(spark, sf).select("stream", "seq", "event_id"), "stream", [F.desc("seq")], 20)


@query(f"WITH {V.FRAMES} SELECT event_id, us, kind FROM frames ORDER BY us DESC, event_id DESC LIMIT 500")
def recent_log(spark, sf):
    f = V.frames(spark, sf).select("event_id", "us", "kind")
    return f.orderBy(F.desc("us"), F.desc("event_id")).limit(500)


@query(
    f"""WITH {V.SEGMENTS}, s AS (SELECT *, end_ms - start_ms AS d FROM segments),
b AS (SELECT *, coalesce(sum(d) OVER (PARTITION BY speaker ORDER BY d DESC, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT *, record * 100 + idx AS k FROM s))
SELECT record, idx, speaker, CAST(least(d, 1000000 - before) AS BIGINT) AS taken FROM b WHERE before < 1000000"""
)
def prototype_candidates(spark, sf):
    s = V.segments(spark, sf).withColumn("d", F.col("end_ms") - F.col("start_ms")).withColumn("k", F.col("record") * 100 + F.col("idx"))
    return S.greedy_budget(s, "speaker", "d", 1_000_000, "k").select("record", "idx", "speaker", "taken")


UP = """old AS (SELECT c_custkey AS id, c_name AS title, 'c' || CAST(c_custkey AS VARCHAR) AS created_by, c_nationkey AS n FROM customer),
new AS (SELECT s_suppkey * 2 AS id, s_name AS title, 's' AS created_by, s_nationkey AS n FROM supplier)"""


def _upsert_inputs(spark, sf):
    old = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("created_by"), F.col("c_nationkey").alias("n"))
    new = table(spark, sf, "supplier").select((F.col("s_suppkey") * 2).alias("id"), F.col("s_name").alias("title"), F.lit("s").alias("created_by"), F.col("s_nationkey").alias("n"))
    return old, new


@query(f"WITH {UP} SELECT id, title, created_by, n FROM old WHERE id NOT IN (SELECT id FROM new) UNION ALL SELECT new.id, new.title, coalesce(old.created_by, new.created_by), new.n FROM new LEFT JOIN old USING (id)")
def upsert_records(spark, sf):
    return S.upsert(*_upsert_inputs(spark, sf))


@query(f"WITH {UP} SELECT * FROM old UNION ALL SELECT id * 10 AS id, title, created_by, n FROM new WHERE id * 10 NOT IN (SELECT id FROM old)")
def insert_ignore(spark, sf):
    old, new = _upsert_inputs(spark, sf)
    return S.insert_ignore(old, new.withColumn("id", F.col("id") * 10), ["id"])


@query(f"WITH {UP} SELECT old.id, coalesce(new.title, old.title) AS title, old.created_by, old.n + CASE WHEN new.id IS NULL THEN 0 ELSE 1 END AS n FROM old LEFT JOIN new USING (id)")
def patch_records(spark, sf):
    old, new = _upsert_inputs(spark, sf)
    return S.patch(old, new.select("id", "title", "created_by"), ["title"], version="n")


@query("SELECT l_orderkey AS record, l_linenumber AS idx, l_partkey AS part FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def cascade_delete(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    children = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("record"), F.col("l_linenumber").alias("idx"), F.col("l_partkey").alias("part"))
    return S.cascade_delete(orders, children, orders.where("o_orderstatus = 'P'"), "record")[1]


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 10 = 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def delete_restricted(spark, sf):
    gone = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")).where("id % 10 = 0")
    return S.restricted(gone, table(spark, sf, "lineitem"), "l_orderkey")


@query(
    f"""WITH {V.SEGMENTS}, old AS (SELECT record, idx, start_ms, end_ms, text FROM segments WHERE idx < 3), new AS (SELECT record, start_ms, end_ms, text FROM segments WHERE idx >= 3)
SELECT record, idx, start_ms, end_ms, text FROM old UNION ALL
SELECT n.record, coalesce(t.top, 0) + row_number() OVER (PARTITION BY n.record ORDER BY start_ms, end_ms, text) AS idx, start_ms, end_ms, text FROM new n LEFT JOIN (SELECT record, max(idx) AS top FROM old GROUP BY record) t ON t.record = n.record"""
)
def append_segments(spark, sf):
    s = V.segments(spark, sf).drop("speaker")
    return S.append_segments(s.where("idx < 3"), s.where("idx >= 3").drop("idx"))


@query(
    """WITH l AS (SELECT o_custkey AS id, o_orderpriority AS name, arg_max(o_orderstatus, o_orderkey) AS v1, max(CAST(o_orderkey AS VARCHAR)) FILTER (o_orderkey % 2 = 0) AS v2 FROM orders GROUP BY ALL)
SELECT id, name, coalesce(nullif(v2, ''), v1) AS value, CASE WHEN v2 IS NULL THEN 1 ELSE 0 END AS layer FROM l"""
)
def config_layers(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("name"), "o_orderstatus", "o_orderkey")
    user = o.groupBy("id", "name").agg(F.max(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey").cast("string"))).alias("value"))
    env = o.groupBy("id", "name").agg(F.max_by("o_orderstatus", "o_orderkey").alias("value"))
    return S.layered("id", user, env)


@query(f"WITH {V.SEGMENTS}, {V.RECORDS} SELECT r.id, r.title, count(s.record) AS n_segments, coalesce(string_agg(CAST(s.idx AS VARCHAR), ',' ORDER BY s.idx), '') AS order_of FROM records r LEFT JOIN segments s ON s.record = r.id GROUP BY r.id, r.title")
def nested_records(spark, sf):
    nested = S.nested_record(V.records(spark, sf).select("id", "title"), V.segments(spark, sf))
    idx = F.coalesce(F.transform("segments", lambda x: x["idx"].cast("string")), F.array())
    return nested.select("id", "title", F.size(idx).cast("bigint").alias("n_segments"), F.array_join(idx, ",").alias("order_of"))


@query("SELECT l_orderkey, l_linenumber, 'segment' AS kind FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 3)")
def foreign_key_violations(spark, sf):
    part = table(spark, sf, "part").where("p_size > 3").select(F.col("p_partkey").alias("id"))
    return S.foreign_key_violations(table(spark, sf, "lineitem"), part, "l_partkey").select("l_orderkey", "l_linenumber", F.lit("segment").alias("kind"))


@query("SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def unique_violations(spark, sf):
    return S.unique_violations(table(spark, sf, "lineitem"), ["l_orderkey", "l_suppkey"])


@query(
    f"""WITH {V.PEOPLE} SELECT r.id AS meeting, p.person FROM reservations r JOIN participants p ON p.meeting = r.id JOIN users u ON u.id = p.person WHERE p.person <> r.organizer"""
)
def unnest_participants(spark, sf):
    ids = V.participants(spark, sf).groupBy("meeting").agg(F.to_json(F.collect_list(F.col("person").cast("string"))).alias("participant_user_ids"))
    r = V.reservations(spark, sf)
    found = S.unnest_participants(r.join(ids, r["id"] == ids["meeting"]).drop("meeting"), V.users(spark, sf))
    return found.select("meeting", F.col("person").cast("bigint").alias("person"))


@query(f"WITH {V.SEGMENTS} SELECT record, idx, speaker, CASE WHEN speaker = 'user' THEN 'U' || CAST(record AS VARCHAR) ELSE speaker END AS name FROM segments")
def rename_speakers(spark, sf):
    s = V.segments(spark, sf).select("record", "idx", "speaker")
    names = s.where("speaker = 'user'").select("record", "speaker", F.concat(F.lit("U"), F.col("record").cast("string")).alias("name")).distinct()
    return S.rename_speakers(s, names)


@query(f"WITH {V.SEGMENTS}, {V.RECORDS}, m AS (SELECT record, max(end_ms) AS d, count(*) AS n FROM segments GROUP BY record) SELECT id, coalesce(n, 0) AS n_segments, coalesce(d, 0) AS duration_ms, 'completed' AS status FROM records LEFT JOIN m ON record = id")
def finalize_records(spark, sf):
    return S.finalize(V.records(spark, sf), V.segments(spark, sf)).drop("full_text")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'x' ELSE substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12) END AS segment_uuid FROM (SELECT o_orderkey, md5('segment_uuid' || CAST(o_orderkey AS VARCHAR)) AS m FROM orders)")
def backfill_uuid(spark, sf):
    return S.backfill_uuid(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "x").otherwise("").alias("segment_uuid")))


@query(f"WITH {V.RESERVATIONS} SELECT id, title, join_code FROM reservations WHERE CAST(id AS VARCHAR) = 'j7' OR upper(join_code) = 'J7'")
def join_by_code(spark, sf):
    return S.join_meeting(V.reservations(spark, sf), "j7").select("id", "title", "join_code")


@query(f"WITH {V.SEGMENTS}, t AS (SELECT record, (length(text) * 5 + 13) AS num_frames, length(text) // 2 AS num_tokens, length(text) / 20.0 AS duration, idx FROM segments) SELECT record, idx FROM t WHERE duration >= 1 AND ((num_frames - 7) // 2 + 1) // 2 > 0 AND ((num_frames - 7) // 2 + 1) // 2 >= num_tokens")
def usable_utterances(spark, sf):
    s = V.segments(spark, sf).select("record", "idx", (F.length("text") * 5 + 13).alias("num_frames"), F.floor(F.length("text") / 2).alias("num_tokens"), (F.length("text") / 20).alias("duration"))
    return S.usable_utterances(s).select("record", "idx")


@query(f"WITH {V.SEGMENTS} SELECT record, count(*) AS segments_count, CAST(sum(greatest(0, end_ms - start_ms)) AS BIGINT) AS talk_ms, CAST(sum(idx % 3) AS BIGINT) AS flags_count, CAST(sum(CASE WHEN speaker = 'user' THEN 2 ELSE 0 END) AS BIGINT) AS corrections_count, count(*) FILTER ((record % 10) / 10.0 < 0.6) AS low_confidence_count FROM segments GROUP BY record")
def analysis_counters(spark, sf):
    s = V.segments(spark, sf)
    flags = F.array_repeat(F.lit("f"), (F.col("idx") % 3).cast("int"))
    return S.analysis_counters(s.withColumn("flags", flags).withColumn("corrections", F.when(F.col("speaker") == "user", F.array(F.lit(1), F.lit(2)))).withColumn("confidence", (F.col("record") % 10) / 10))


@query(
    f"""WITH {V.SEGMENTS} SELECT count(*) AS results, CAST(sum(length(text)) AS BIGINT) AS chars, round(avg(record % 7), 6) AS mean_confidence, round(avg(idx), 6) AS mean_snr, count(*) FILTER (idx = 0) AS high_quality, count(*) FILTER (idx = 1) AS medium_quality, count(*) FILTER (idx > 1) AS low_quality,
CAST(count(*) * 2 AS BIGINT) AS terms, (SELECT count(*) FROM (SELECT speaker FROM segments UNION SELECT CAST(record AS VARCHAR) FROM segments)) AS distinct_terms FROM segments"""
)
def file_stats(spark, sf):
    label = F.when(F.col("idx") == 0, "high").when(F.col("idx") == 1, "medium").otherwise("low")
    r = V.segments(spark, sf).select("text", (F.col("record") % 7).alias("confidence"), F.col("idx").alias("snr"), label.alias("quality_label"), F.array("speaker", F.col("record").cast("string")).alias("terms"))
    return S.file_stats(r).withColumn("mean_confidence", F.round("mean_confidence", 6)).withColumn("mean_snr", F.round("mean_snr", 6))


@query(f"WITH {V.SEGMENTS} SELECT record, count(*) AS segments_count, CAST(sum(end_ms - start_ms) AS BIGINT) AS duration_ms FROM segments GROUP BY record")
def analysis_payload(spark, sf):
    return S.analysis_payload(V.segments(spark, sf).withColumn("display_text", F.lit(" "))).drop("transcript_json")


@query("SELECT o_orderkey AS id, CASE WHEN s >= 3600 THEN CAST(s // 3600 AS VARCHAR) || ':' || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') ELSE CAST(s // 60 AS VARCHAR) END || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS d FROM (SELECT o_orderkey, CAST(floor(o_totalprice / 20) AS BIGINT) AS s FROM orders)")
def durations(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), S.format_duration(F.col("o_totalprice") / 20).alias("d"))
