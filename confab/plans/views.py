"""Meeting views over the driver tables, in Spark and, word for word, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from confab.sources.tables import table


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript rows (record, idx, speaker, start_ms, end_ms, text); a character lasts 100 ms."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    dur = F.length("text").cast("bigint") * 100
    return (
        table(spark, sf_dir, "conversations")
        .withColumn("dur", dur)
        .withColumn("end_ms", F.sum("dur").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .select(F.col("conv_id").alias("record"), F.col("turn").alias("idx"), F.col("role").alias("speaker"), (F.col("end_ms") - F.col("dur")).alias("start_ms"), "end_ms", "text")
    )


SEGMENTS = """segments AS (
  SELECT record, idx, speaker, e - d AS start_ms, e AS end_ms, text FROM (
    SELECT conv_id AS record, turn AS idx, role AS speaker, text, CAST(length(text) AS BIGINT) * 100 AS d,
           CAST(sum(CAST(length(text) AS BIGINT) * 100) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e
    FROM conversations))"""


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speaker turns (record, turn, speaker, start_ms, end_ms, confidence), padded so that neighbours overlap."""
    s = segments(spark, sf_dir)
    return s.select("record", F.col("idx").alias("turn"), "speaker", (F.col("start_ms") - 2500).alias("start_ms"), (F.col("end_ms") + 4500).alias("end_ms"), (F.lit(50) + F.pmod(F.col("idx") * 7 + F.col("record"), F.lit(50))).alias("confidence"))


TIMELINE = SEGMENTS + """,
timeline AS (SELECT record, idx AS turn, speaker, start_ms - 2500 AS start_ms, end_ms + 4500 AS end_ms, 50 + (idx * 7 + record) % 50 AS confidence FROM segments)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audio frames (stream, seq, us, rms, kind): an event is a frame of its user's stream."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("stream"), F.row_number().over(order).cast("bigint").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("value").alias("rms"), F.col("event_type").alias("kind"), "event_id", "props"
    )


FRAMES = """frames AS (
  SELECT user_id AS stream, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, epoch_us(ts) AS us, value AS rms, event_type AS kind, event_id, props FROM events)"""


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People (id, username, display_name, role, status, password_salt, password_hash)."""
    c = table(spark, sf_dir, "customer")
    status = F.when(F.col("c_acctbal") < -900, "deleted").when(F.col("c_acctbal") < 0, "disabled").otherwise("active")
    return c.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), F.concat(F.col("c_mktsegment"), F.lit(" "), F.col("c_custkey").cast("string")).alias("display_name"),
        F.when(F.col("c_custkey") % 100 == 0, "admin").otherwise("user").alias("role"), status.alias("status"), F.lit("salt").alias("password_salt"), F.lit("hash").alias("password_hash"),
    )


USERS = """users AS (
  SELECT c_custkey AS id, c_name AS username, c_mktsegment || ' ' || CAST(c_custkey AS VARCHAR) AS display_name,
         CASE WHEN c_custkey % 100 = 0 THEN 'admin' ELSE 'user' END AS role,
         CASE WHEN c_acctbal < -900 THEN 'deleted' WHEN c_acctbal < 0 THEN 'disabled' ELSE 'active' END AS status FROM customer)"""


def reservations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meetings (id, title, organizer, start_us, end_us, status, join_code)."""
    o = table(spark, sf_dir, "orders")
    start = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_custkey").alias("organizer"), start.alias("start_us"),
        (start + (1 + F.col("o_orderkey") % 4) * 3_600_000_000).alias("end_us"), F.col("o_orderstatus").alias("status"), F.concat(F.lit("J"), F.col("o_orderkey").cast("string")).alias("join_code"),
    )


RESERVATIONS = """reservations AS (
  SELECT o_orderkey AS id, o_orderpriority AS title, o_custkey AS organizer, epoch_us(o_orderdate) AS start_us,
         epoch_us(o_orderdate) + (1 + o_orderkey % 4) * 3600000000 AS end_us, o_orderstatus AS status, 'J' || CAST(o_orderkey AS VARCHAR) AS join_code FROM orders)"""


def participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bridge (meeting, person): suppliers' keys stand for people's."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("meeting"), F.col("l_suppkey").alias("person")).distinct()


PARTICIPANTS = "participants AS (SELECT DISTINCT l_orderkey AS meeting, l_suppkey AS person FROM lineitem)"


def friends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed edges (user, friend): an organizer befriends the people of every third meeting."""
    r = reservations(spark, sf_dir).where("id % 3 = 0").select("id", F.col("organizer").alias("user"))
    return r.join(participants(spark, sf_dir), F.col("id") == F.col("meeting")).select("user", F.col("person").alias("friend")).where("user <> friend").distinct()


FRIENDS = """friends AS (
  SELECT DISTINCT r.organizer AS "user", p.person AS friend FROM reservations r JOIN participants p ON r.id = p.meeting WHERE r.id % 3 = 0 AND r.organizer <> p.person)"""

PEOPLE = ",\n".join([USERS, RESERVATIONS, PARTICIPANTS, FRIENDS])


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record headers over documents: (id, title, filename, full_text, created_by, status, updated_at)."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"), F.substring("text", 1, 24).alias("title"), F.concat(F.col("source"), F.lit("-"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("filename"), F.col("text").alias("full_text"),
        F.when(F.col("doc_id") % 7 == 0, F.lit(None).cast("bigint")).otherwise(F.col("doc_id") % 50).alias("created_by"), F.when(F.col("doc_id") % 5 == 0, "processing").otherwise("completed").alias("status"), (F.col("doc_id") * 7919 % 10007).alias("updated_at"), "n_chars", "lang",
    )


RECORDS = """records AS (
  SELECT doc_id AS id, substr(text, 1, 24) AS title, source || '-' || CAST(doc_id AS VARCHAR) || '.wav' AS filename, text AS full_text,
         CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 50 END AS created_by, CASE WHEN doc_id % 5 = 0 THEN 'processing' ELSE 'completed' END AS status,
         doc_id * 7919 % 10007 AS updated_at, n_chars, lang FROM documents)"""
