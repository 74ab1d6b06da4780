"""Readers: audio files, TextGrids, corpora, manifests, framed live audio."""

from __future__ import annotations

import os
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from confab.functions import acoustics as A

MAX_UPLOAD_BYTES = 2048 << 20
SILENT = ("sil", "sp", "spn", "<unk>")


def read_audio(spark: SparkSession, path: str, glob: str = "*.wav", max_bytes: int = MAX_UPLOAD_BYTES, rate: int = A.RATE) -> DataFrame:
    """(path, length, samples, duration_ms, sha256): mono samples at one rate; files over the limit are skipped unread."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).where(F.col("length") <= max_bytes)
    decoded = files.select("path", "length", A.decoded_wav(F.col("content"), rate).alias("samples"), F.sha2("content", 256).alias("sha256"))
    return decoded.withColumn("duration_ms", F.round(F.size("samples") * 1000 / rate).cast("bigint"))


def audio_windows(audio: DataFrame, size: int = 512, tail: int = A.RATE) -> DataFrame:
    """(path, window, samples): fixed windows after a second of zeros; the remainder is dropped."""
    return audio.select("path", F.posexplode(A.windows(F.col("samples").cast("array<double>"), size, tail)).alias("window", "samples"))


def textgrid_intervals(text: Column) -> Column:
    """array<struct<start,end,text>> of a TextGrid's spoken intervals."""
    part = lambda k: F.regexp_extract_all(text, F.lit(r'intervals\s*\[\d+\]:?\s*xmin\s*=\s*([\d.]+)\s*xmax\s*=\s*([\d.]+)\s*text\s*=\s*"((?:[^"]|"")*)"'), k)
    rows = F.arrays_zip(part(1).alias("start"), part(2).alias("end"), part(3).alias("text"))
    typed = F.transform(rows, lambda r: F.struct(r["start"].cast("double").alias("start"), r["end"].cast("double").alias("end"), F.trim(F.replace(r["text"], F.lit('""'), F.lit('"'))).alias("text")))
    return F.filter(typed, lambda r: (r["text"] != "") & ~F.lower(r["text"]).isin(*SILENT))


def read_textgrids(spark: SparkSession, path: str) -> DataFrame:
    """(path, idx, start_sec, end_sec, duration_sec, text)."""
    files = spark.read.option("pathGlobFilter", "*.TextGrid").option("recursiveFileLookup", "true").text(path, wholetext=True).withColumn("path", F.input_file_name())
    rows = files.select("path", F.posexplode(textgrid_intervals(F.col("value"))).alias("idx", "r"))
    return rows.select("path", "idx", F.col("r.start").alias("start_sec"), F.col("r.end").alias("end_sec"), (F.col("r.end") - F.col("r.start")).alias("duration_sec"), F.col("r.text").alias("text"))


def scan_dataset(spark: SparkSession, path: str, far: bool = True, near: bool = True) -> DataFrame:
    """(meeting, far_files, near_files, speakers, has_textgrid, hours) from file names and sizes; nothing is read.

    Far files are ``<meeting>_<device>.wav``, near ones ``<meeting>_N_<speaker>.wav``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length")
    stem = F.regexp_replace("name", r"\.(wav|TextGrid)$", "")
    close = F.col("name").contains("_N_")
    wav = F.col("name").endswith(".wav")
    meeting = F.when(close, F.regexp_extract(stem, r"^(.*?)_N_", 1)).when(wav, F.regexp_replace(stem, r"_[^_]*$", "")).otherwise(stem)
    kept = files.withColumn("meeting", meeting).withColumn("close", close & wav).withColumn("far", wav & ~close).withColumn("speaker", F.when(close, F.regexp_extract(stem, r"_N_(.*)$", 1))).withColumn("grid", F.col("name").endswith(".TextGrid"))
    kept = kept.where(F.col("grid") | (F.col("far") & F.lit(far)) | (F.col("close") & F.lit(near)))
    return kept.groupBy("meeting").agg(
        F.count_if("far").alias("far_files"), F.count_if("close").alias("near_files"), F.array_sort(F.collect_set("speaker")).alias("speakers"), F.max("grid").alias("has_textgrid"),
        F.round(F.sum(F.when(F.col("far"), F.col("length")).otherwise(0)) / (A.RATE * 2 * 3600), 3).alias("hours"),
    )


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(meeting, idx, text) from a tab-separated file whose ``content`` is JSON with sentences; bad rows are skipped."""
    rows = spark.read.csv(path, sep="\t", header=True, multiLine=True, escape='"').withColumn("meeting", F.monotonically_increasing_id())
    parsed = rows.select("meeting", F.from_json("content", "sentences array<struct<s:string>>").alias("c"))
    return parsed.select("meeting", F.posexplode("c.sentences").alias("idx", "s")).select("meeting", "idx", F.col("s.s").alias("text"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(audio, reference, keywords) of a JSON array; items without audio or reference are skipped, paths resolved."""
    kind = "audio string, reference string, keywords array<string>"
    base = os.path.dirname(path)
    rows = spark.read.schema(kind).json(path, multiLine=True).where("trim(coalesce(audio, '')) <> '' and trim(coalesce(reference, '')) <> ''")
    return rows.select(F.when(F.col("audio").startswith("/"), F.col("audio")).otherwise(F.concat(F.lit(base + "/"), F.col("audio"))).alias("audio"), "reference", F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"))


def read_cuts(spark: SparkSession, sources: dict[str, str], seed: int = 0, weights: dict[str, float] | None = None) -> DataFrame:
    """Manifests of several corpora as one, mixed; gzip files are one task each.

    Rows are spread by hash, so every partition holds all corpora in proportion, and each
    partition is put in random order by itself: no global sort. A corpus of twice the weight
    (1 unless named) is drawn from twice as often while it lasts.
    """
    kind = "id string, duration double, num_frames long, supervisions array<struct<text:string,speaker:string>>"
    out = None
    for name, path in sources.items():
        part = spark.read.schema(kind).json(path).withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part)
    weight = F.lit(1.0)
    for name, value in (weights or {}).items():
        weight = F.when(F.col("source") == name, float(value)).otherwise(weight)
    spread = out.repartition(F.xxhash64(F.lit(seed), "source", "id"))
    return spread.withColumn("_turn", -F.log1p(-F.rand(seed)) / weight).sortWithinPartitions("_turn").drop("_turn")


MAGIC = b"DTP2"
MAX_FRAME_BYTES = 512 * 1024
FRAME = T.StructType([T.StructField("seq", T.LongType()), T.StructField("version", T.IntegerType()), T.StructField("samples", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType())])


def encode_frame(seq: int, pcm: bytes) -> bytes:
    return struct.pack("<4sI", MAGIC, seq) + pcm


def decode_frame(payload: bytes) -> tuple[int | None, int, list[float] | None, str | None]:
    """(sequence, version, samples, error) of a framed or plain 16-bit payload."""
    seq, version = None, 1
    if payload[:4] == MAGIC:
        if len(payload) <= 8:
            return None, 2, None, "frame without samples"
        seq, version, payload = struct.unpack_from("<4sI", payload)[1], 2, payload[8:]
    if not payload or len(payload) % 2:
        return seq, version, None, "incomplete samples"
    if len(payload) > MAX_FRAME_BYTES:
        return seq, version, None, "frame too large"
    return seq, version, A.pcm_to_float(payload).tolist(), None


def decoded_frames(payload: Column) -> Column:
    """struct(seq, version, samples, error) of binary frames."""

    @pandas_udf(FRAME)
    def run(frames: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decode_frame(bytes(f)) if f is not None else (None, None, None, "no frame") for f in frames], columns=FRAME.names)

    return run(payload)


def stream_frames(spark: SparkSession, path: str) -> DataFrame:
    """Streaming (stream, us, payload) from a folder that frames are dropped into as Parquet."""
    return spark.readStream.schema("stream string, us long, payload binary").parquet(path)


def read_store(spark: SparkSession, location: str, name: str, predicate: str | None = None, properties: dict | None = None) -> DataFrame:
    """Table of the Parquet store or, for ``jdbc:`` locations, of a database; filters are pushed down by either."""
    df = spark.read.jdbc(location, name, properties=properties or {}) if location.startswith("jdbc:") else spark.read.parquet(f"{location.rstrip('/')}/{name}")
    return df.where(predicate) if predicate else df


def choose_store(settings: dict[str, str]) -> str:
    """Remote store if both its address and key are set, else the local one."""
    return "remote" if settings.get("store_url", "").strip() and settings.get("store_key", "").strip() else "local"
