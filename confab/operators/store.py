"""Relational store and search: projections, filters, joins, aggregates, ordering, sets.

Every function takes and returns DataFrames; nothing here collects. Tables follow the
store's own column names (id, status, created_by, updated_at, ...), given by parameter
where callers may differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECRET_COLUMNS = ("password_salt", "password_hash")


# Projections


def public_user(users: DataFrame) -> DataFrame:
    """People without credentials."""
    return users.drop(*SECRET_COLUMNS)


def record_preview(records: DataFrame, chars: int = 500) -> DataFrame:
    """List view: the full text cut to a preview and never carried whole."""
    others = [c for c in records.columns if c != "full_text"]
    return records.select(*others, F.substring("full_text", 1, chars).alias("preview"))


def residual_metadata(metadata: Column, promoted: list[str]) -> Column:
    """JSON object without the keys that have columns of their own; bad JSON gives {}."""
    parsed = F.from_json(metadata, "map<string,string>")
    kept = F.map_filter(parsed, lambda k, v: ~k.isin(promoted))
    return F.coalesce(F.to_json(kept), F.lit("{}"))


def first_text(*columns: Column) -> Column:
    """First value that is not blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in columns])


def number_or(column: Column, default: float) -> Column:
    """Tolerant cast of anything to double."""
    return F.coalesce(column.cast("string").try_cast("double"), F.lit(float(default)))


# Filters


def search(df: DataFrame, query: str | None, columns: list[str]) -> DataFrame:
    """Rows of which some column matches ``%query%``, ignoring case; ``%`` and ``_`` stay wild."""
    if not query:
        return df
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.col(c).ilike(f"%{query}%"), F.lit(False))
    return df.where(found)


def active(df: DataFrame, status: str = "active") -> DataFrame:
    return df.where(F.col("status") == status)


def not_deleted(df: DataFrame) -> DataFrame:
    return df.where(F.col("status") != "deleted")


def search_users(users: DataFrame, keyword: str, exclude: object = None, limit: int = 20) -> DataFrame:
    """Public view of matching people, newest id first."""
    found = search(not_deleted(users), keyword, ["username"])
    if exclude is not None:
        found = found.where(F.col("id") != exclude)
    return public_user(found).orderBy(F.desc("id")).limit(limit)


def owned_by(df: DataFrame, user: object, is_admin: bool = False, owner: str = "created_by") -> DataFrame:
    """Row-level guard: rows without an owner, one's own, or all for an admin."""
    return df if is_admin else df.where(F.col(owner).isNull() | (F.col(owner) == user))


def visible_reservations(reservations: DataFrame, participants: DataFrame, user: object, status: str | None = None) -> DataFrame:
    """Meetings one organizes or takes part in; an existence test, so no row doubles."""
    mine = participants.where(F.col("person") == user).select("meeting").distinct().withColumn("_in", F.lit(True))
    joined = reservations.join(mine, reservations["id"] == mine["meeting"], "left")
    seen = joined.where((F.col("organizer") == user) | F.col("_in")).drop("meeting", "_in")
    return seen if status is None else seen.where(F.col("status") == status)


def time_status(start: Column, end: Column, now: Column) -> Column:
    """upcoming, running (both ends inclusive), ended, or unknown where a time is missing."""
    return F.when(start.isNull() | end.isNull(), "unknown").when(now < start, "upcoming").when(now > end, "ended").otherwise("running")


def valid_span(start: Column, end: Column) -> Column:
    """Do both texts parse as ISO times, and does the end come after the start?"""
    a, b = F.try_to_timestamp(F.regexp_replace(start, "Z$", "+00:00")), F.try_to_timestamp(F.regexp_replace(end, "Z$", "+00:00"))
    return F.coalesce(b > a, F.lit(False))


def valid_profile(display_name: Column, email: Column, phone: Column, avatar: Column, max_avatar: int = 256 * 1024) -> Column:
    """Lengths, an @ in the mail address, and the decoded size of an inline picture."""
    picture = F.try_to_binary(F.regexp_replace(avatar, r"^data:image/[\w.+-]+;base64,", ""), F.lit("base64"))
    ok_avatar = avatar.isNull() | (avatar == "") | (avatar.rlike(r"^data:image/[\w.+-]+;base64,") & (F.length(picture) <= max_avatar))
    within = lambda c, n: F.coalesce(F.length(c), F.lit(0)) <= n
    return within(display_name, 60) & within(email, 254) & within(phone, 32) & (F.coalesce(email, F.lit("")).contains("@") | (F.coalesce(email, F.lit("")) == "")) & F.coalesce(ok_avatar, F.lit(False))


def summary_eligibility(wanted: DataFrame, records: DataFrame, user: object, is_admin: bool = False, most: int = 20) -> DataFrame:
    """(id, reason): why a wanted record can't be summarised; 'ok' where it can."""
    ids = wanted.select("id").distinct()
    many = F.broadcast(ids.agg(F.count("*").alias("_n")))
    found = ids.join(records.select("id", "created_by", "status", "full_text", F.lit(True).alias("_found")), "id", "left").crossJoin(many)
    foreign = F.lit(False) if is_admin else F.col("created_by").isNotNull() & (F.col("created_by") != user)
    reason = (
        F.when(F.col("_n") > most, "too many").when(F.col("_found").isNull(), "missing").when(foreign, "forbidden").when(F.col("status") != "completed", "not completed")
        .when(F.trim(F.coalesce("full_text", F.lit(""))) == "", "empty").otherwise("ok")
    )
    return found.select("id", reason.alias("reason"))


def hide_flags(flags: Column, hidden: list[str]) -> Column:
    """Array of flags without those of the hidden types."""
    return F.filter(flags, lambda f: ~f["type"].isin(hidden))


def usable_utterances(df: DataFrame, least: float = 1.0, most: float | None = None) -> DataFrame:
    """Utterances long enough, and with no more tokens than subsampled frames."""
    subsampled = F.floor((F.floor((F.col("num_frames") - 7) / 2) + 1) / 2)
    kept = df.where((F.col("duration") >= least) & (subsampled > 0) & (subsampled >= F.col("num_tokens")))
    return kept if most is None else kept.where(F.col("duration") <= most)


# Joins


def session_users(sessions: DataFrame, users: DataFrame) -> DataFrame:
    """Tokens with their people; people no longer active drop out."""
    return sessions.join(public_user(active(users)), sessions["user_id"] == F.col("id")).drop("id")


def friends_of(friends: DataFrame, users: DataFrame, keep_missing: bool = False) -> DataFrame:
    """Friend lists (user, friend, username, display_name).

    Deleted people drop out; ``keep_missing`` is the remote store's variant, which keeps
    every edge once, with empty names for people it can't find.
    """
    people = users.select(F.col("id").alias("friend"), "username", "display_name", "status")
    if not keep_missing:
        return friends.join(people.where("status <> 'deleted'"), "friend").select("user", "friend", "username", "display_name")
    joined = friends.select("user", "friend").distinct().join(people, "friend", "left")
    return joined.select("user", "friend", F.coalesce("username", F.lit("")).alias("username"), F.coalesce("display_name", F.lit("")).alias("display_name"))


def reservation_people(reservations: DataFrame, participants: DataFrame, users: DataFrame) -> DataFrame:
    """Each meeting with its organizer's name (null if unknown) and sorted people, in one join each."""
    people = participants.join(users.select(F.col("id").alias("person"), "display_name", "username"), "person")
    nested = people.groupBy("meeting").agg(F.array_sort(F.collect_set(F.struct("display_name", "username", F.col("person").alias("id")))).alias("people"))
    named = reservations.join(users.select(F.col("id").alias("organizer"), F.col("display_name").alias("organizer_name")), "organizer", "left")
    joined = named.join(nested, named["id"] == nested["meeting"], "left").drop("meeting")
    return joined.withColumn("people", F.coalesce("people", F.array().cast(nested.schema["people"].dataType)))


def invalid_participants(reservations: DataFrame, participants: DataFrame, users: DataFrame, friends: DataFrame) -> DataFrame:
    """(meeting, person): people who are not active or not befriended by the organizer; organizers themselves pass."""
    wanted = participants.join(reservations.select(F.col("id").alias("meeting"), "organizer"), "meeting").where("person <> organizer")
    good = friends.join(active(users).select(F.col("id").alias("friend")), "friend", "left_semi").select(F.col("user").alias("organizer"), F.col("friend").alias("person"))
    return wanted.join(good, ["organizer", "person"], "left_anti").select("meeting", "person")


def resolve_participants(wanted: Column, organizer: Column, active_ids: Column, friend_ids: Column) -> Column:
    """struct(valid, invalid): distinct wanted people who are active friends, and the others; the organizer drops out."""
    distinct = F.array_remove(F.array_distinct(wanted), organizer)
    valid = F.filter(distinct, lambda p: F.array_contains(active_ids, p) & F.array_contains(friend_ids, p))
    return F.struct(valid.alias("valid"), F.array_except(distinct, valid).alias("invalid"))


def unnest_participants(reservations: DataFrame, users: DataFrame, column: str = "participant_user_ids") -> DataFrame:
    """(meeting, person) from a JSON array column; unknown people, organizers and non-arrays give no row."""
    ids = F.from_json(F.col(column), "array<string>")
    rows = reservations.select(F.col("id").alias("meeting"), F.col("organizer").cast("string").alias("organizer"), F.explode(F.array_distinct(ids)).alias("person"))
    return rows.where("person <> organizer").join(users.select(F.col("id").cast("string").alias("person")), "person", "left_semi").select("meeting", "person")


def stale(items: DataFrame, records: DataFrame) -> DataFrame:
    """Bridge rows whose version snapshot is no longer the record's version."""
    current = records.select(F.col("id").alias("record_id"), F.col("updated_at").alias("current_version"))
    return items.join(current, "record_id").where(F.col("snapshot") != F.col("current_version"))


def rename_speakers(segments: DataFrame, names: DataFrame) -> DataFrame:
    """Segments with new names where the map (record, speaker, name) has one."""
    return segments.join(names, ["record", "speaker"], "left").withColumn("name", F.coalesce("name", "speaker"))


def zip_by_position(left: DataFrame, right: DataFrame, key: str, array: str, other: str) -> DataFrame:
    """Items of two arrays joined by ordinal; left items without a partner stay."""
    a = left.select(key, F.posexplode(array).alias("pos", "left_item"))
    b = right.select(key, F.posexplode(other).alias("pos", "right_item"))
    return a.join(b, [key, "pos"], "left")


def nested_record(records: DataFrame, segments: DataFrame) -> DataFrame:
    """Headers with their segments as one ordered array."""
    item = F.struct("idx", "speaker", "start_ms", "end_ms", "text")
    nested = segments.groupBy("record").agg(F.array_sort(F.collect_list(item)).alias("segments"))
    return records.join(nested, records["id"] == nested["record"], "left").drop("record")


def by_id(df: DataFrame, value: object, column: str = "id") -> DataFrame:
    """Point lookup."""
    return df.where(F.col(column) == value)


def join_meeting(reservations: DataFrame, key: str) -> DataFrame:
    """Meeting by id or, failing that, by join code in any case."""
    return reservations.where((F.col("id").cast("string") == key) | (F.upper("join_code") == key.upper()))


# Aggregates


def record_stats(segments: DataFrame) -> DataFrame:
    """Per record: segments, duration (greatest end, 0 if none) and the next free index."""
    return segments.groupBy("record").agg(F.count("*").alias("n_segments"), F.coalesce(F.max("end_ms"), F.lit(0)).alias("duration_ms"), (F.coalesce(F.max("idx"), F.lit(0)) + 1).alias("next_idx"))


def full_text(segments: DataFrame) -> DataFrame:
    """``[speaker] text`` lines of a record in order; blank texts are left out."""
    line = F.concat(F.lit("["), F.coalesce(F.when(F.trim("speaker") != "", F.col("speaker")), F.lit("UNKNOWN")), F.lit("] "), F.trim("text"))
    items = F.collect_list(F.when(F.trim("text") != "", F.struct("idx", line.alias("line"))))
    return segments.groupBy("record").agg(F.array_join(F.transform(F.array_sort(items), lambda x: x["line"]), "\n").alias("full_text"))


def speaker_roster(timeline: DataFrame) -> DataFrame:
    """Per record and speaker: total time, turns and mean confidence (times 1000, half up)."""
    return timeline.groupBy("record", "speaker").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), F.count("*").alias("turns"), F.floor(F.sum("confidence") * 1000 / F.count("*") + 0.5).cast("bigint").alias("confidence_milli"))


def record_report(segments: DataFrame) -> DataFrame:
    """Who spoke how long in each meeting, with the ordered transcript."""
    talk = segments.groupBy("record", "speaker").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("d"))
    top = talk.groupBy("record").agg(F.count("*").alias("n_speakers"), F.min(F.struct(-F.col("d"), "speaker")).getField("speaker").alias("top_speaker"))
    stats = record_stats(segments).select("record", "n_segments", "duration_ms")
    return stats.join(top, "record").join(full_text(segments), "record").select(F.col("record").alias("conv_id"), "n_segments", "duration_ms", "n_speakers", "top_speaker", "full_text")


def analysis_counters(segments: DataFrame) -> DataFrame:
    """Per record: segments, talking time, flags, corrections and weak segments (confidence under 0.6).

    ``segments`` has flags and corrections (arrays) and confidence; talking time is the sum
    of the segments' lengths, unlike the record's duration, which is its greatest end.
    """
    talk = F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))
    sizes = lambda c: F.sum(F.greatest(F.size(F.coalesce(c, F.array())), F.lit(0))).alias(f"{c}_count")
    return segments.groupBy("record").agg(F.count("*").alias("segments_count"), F.sum(talk).alias("talk_ms"), sizes("flags"), sizes("corrections"), F.count_if(F.col("confidence") < 0.6).alias("low_confidence_count"))


def file_stats(results: DataFrame) -> DataFrame:
    """One row over all results: counts, characters, mean scores, results by label, distinct terms."""
    terms = results.select(F.explode("terms").alias("t")).agg(F.count_distinct("t").alias("distinct_terms"))
    by_label = [F.count_if(F.col("quality_label") == v).alias(f"{v}_quality") for v in ("high", "medium", "low")]
    totals = results.agg(F.count("*").alias("results"), F.sum(F.length("text")).alias("chars"), F.avg("confidence").alias("mean_confidence"), F.avg("snr").alias("mean_snr"), *by_label, F.sum(F.size("terms")).alias("terms"))
    return totals.crossJoin(terms)


def analysis_payload(segments: DataFrame) -> DataFrame:
    """(record, transcript_json, segments_count, duration_ms): segments under the names clients send and expect.

    ``display_text`` comes before ``text``, names before ids; blank values count as missing.
    """
    pick = lambda *names: first_text(*[F.col(n).cast("string") for n in names if n in segments.columns])
    item = F.struct("idx", pick("display_text", "text").alias("text"), pick("speaker_name", "speaker").alias("speaker"), "start_ms", "end_ms")
    grouped = segments.groupBy("record").agg(F.array_sort(F.collect_list(item)).alias("s"), F.sum(F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))).alias("duration_ms"))
    return grouped.select("record", F.to_json("s").alias("transcript_json"), F.size("s").cast("bigint").alias("segments_count"), "duration_ms")


def record_title(title: Column, filename: Column, default: str = "untitled") -> Column:
    """Title, else the file's name without its extension, else a default."""
    return F.coalesce(first_text(title, F.regexp_replace(filename, r"\.[^.]*$", "")), F.lit(default))


def format_duration(seconds: Column) -> Column:
    """``H:MM:SS``, or ``M:SS`` under an hour."""
    s = F.greatest(F.floor(F.coalesce(seconds, F.lit(0.0))), F.lit(0)).cast("int")
    hours, minutes, rest = F.floor(s / 3600).cast("int"), (F.floor(s / 60) % 60).cast("int"), s % 60
    return F.when(hours > 0, F.format_string("%d:%02d:%02d", hours, minutes, rest)).otherwise(F.format_string("%d:%02d", minutes, rest))


def result_json(results: DataFrame) -> Column:
    """Image of a result for clients: times to 3, scores to 1 and 3 places, words nested, audio for final ones only."""
    held = set(results.columns)
    fields = [F.round(c, 3).alias(c) for c in ("start_sec", "end_sec", "confidence") if c in held] + [F.round(c, 1).alias(c) for c in ("snr",) if c in held]
    fields += [F.col(c) for c in ("text", "speaker", "is_final", "words") if c in held]
    if {"audio", "is_final"} <= held:
        fields.append(F.when(F.col("is_final"), F.base64("audio")).alias("audio"))
    return F.to_json(F.struct(*fields))


def participant_ids(value: Column) -> Column:
    """Distinct non-blank ids of a JSON array text; anything else gives none."""
    ids = F.filter(F.coalesce(F.from_json(value, "array<string>"), F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")
    return F.array_distinct(ids)


def jobs_by_class(jobs: DataFrame) -> DataFrame:
    """Queued, running and all jobs."""
    running = ~F.col("status").isin("queued", "completed", "failed", "cancelled")
    return jobs.agg(F.count_if(F.col("status") == "queued").alias("queued"), F.count_if(running).alias("running"), F.count("*").alias("total"))


def type_counts(messages: DataFrame, column: str = "kind") -> DataFrame:
    return messages.groupBy(column).agg(F.count("*").alias("n"))


def complete_presets(presets: DataFrame, enabled: DataFrame) -> DataFrame:
    """Presets all of whose words are enabled (relational division); empty presets are not."""
    held = presets.join(enabled.select("word").distinct().withColumn("_on", F.lit(1)), "word", "left")
    return held.groupBy("preset").agg(F.count("*").alias("words"), F.count("_on").alias("on")).where("words = on").select("preset", "words")


def merge_hypotheses(hyps: DataFrame, key: str = "ys") -> DataFrame:
    """Equal token strings merged by log-sum-exp of their scores, stable for very small scores."""
    top = Window.partitionBy("utt", key)
    shifted = hyps.withColumn("_m", F.max("log_prob").over(top))
    return shifted.groupBy("utt", key).agg((F.first("_m") + F.log(F.sum(F.exp(F.col("log_prob") - F.col("_m"))))).alias("log_prob"), F.count("*").alias("merged"))


def beam(hyps: DataFrame, k: int, length_norm: bool = False, key: str = "ys") -> DataFrame:
    """Best k hypotheses of each utterance; ties keep the smaller token string."""
    score = F.col("log_prob") / F.size(F.split(F.col(key), "_")) if length_norm else F.col("log_prob")
    return hyps.withColumn("rank", F.row_number().over(Window.partitionBy("utt").orderBy(F.desc(score), key))).where(F.col("rank") <= k)


# Order and pages


def page(df: DataFrame, order: list[Column], limit: int = 20, offset: int = 0) -> DataFrame:
    """One page with the total before the cut in ``total``; limit is kept to 1..100, offset to 0 or more.

    The total comes from a count of its own, so the page is a top-k, not a global sort.
    """
    limit, offset = max(1, min(100, int(limit))), max(0, int(offset))
    total = df.agg(F.count("*").alias("total"))
    cut = df.orderBy(*order).offset(offset).limit(limit) if offset else df.orderBy(*order).limit(limit)
    return cut.crossJoin(F.broadcast(total))


def latest(df: DataFrame, order: Column, n: int) -> DataFrame:
    return df.orderBy(F.desc(order)).limit(n)


def last_per_key(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The last n rows of each key (event replay, log tails)."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def longest_first(terms: Column) -> Column:
    """Distinct terms, the longest first, ties in text order."""
    return F.array_sort(F.array_distinct(terms), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))


def greedy_budget(df: DataFrame, key: str, duration: str, budget: int, tiebreak: str) -> DataFrame:
    """Rows of a key, longest first, until their durations fill the budget; the last is clipped (``taken``)."""
    order = Window.partitionBy(key).orderBy(F.desc(duration), tiebreak).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(duration).over(order), F.lit(0))
    return df.withColumn("_before", before).where(F.col("_before") < budget).withColumn("taken", F.least(F.col(duration), F.lit(budget) - F.col("_before"))).drop("_before")


# Sets


def first_of_each(df: DataFrame, key: Column, position: str) -> DataFrame:
    """Keeps the first row by position of each key; unlike ``dropDuplicates`` this is defined."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(position))).where("_r = 1").drop("_r")


def clean_hotwords(words: DataFrame, most: int = 500, chars: int = 80) -> DataFrame:
    """Trimmed hotwords (list, pos, word, score), one a case-insensitive key, comments and blanks out, at most ``most`` a list."""
    trimmed = words.withColumn("word", F.trim("word")).where((F.col("word") != "") & ~F.col("word").startswith("#") & (F.length("word") <= chars))
    unique = first_of_each(trimmed, F.concat_ws("\x00", F.col("list").cast("string"), F.lower("word")), "pos")
    return unique.withColumn("_n", F.row_number().over(Window.partitionBy("list").orderBy("pos"))).where(F.col("_n") <= most).drop("_n")


def toggle_preset(enabled: DataFrame, presets: DataFrame, preset: str, on: bool) -> DataFrame:
    """Words after a preset is switched: union, or minus the words that no other complete preset shares."""
    own = presets.where(F.col("preset") == preset).select("word")
    if on:
        return enabled.select("word").union(own).distinct()
    others = complete_presets(presets, enabled).where(F.col("preset") != preset)
    protected = presets.join(others.select("preset"), "preset", "left_semi").select("word")
    return enabled.select("word").distinct().join(own.join(protected, "word", "left_anti"), "word", "left_anti")


# Mutations, as rewrites


def latest_rows(df: DataFrame, key: list[str], order: tuple[str, ...] = ()) -> DataFrame:
    """One row a key: the last by ``order``, of equals the greatest by all columns; nulls come first."""
    by = [F.col(c).desc_nulls_last() for c in dict.fromkeys([*[c for c in order if c in df.columns], *df.columns])]
    ranked = df.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(*by)))
    return ranked.where("_nth = 1").drop("_nth")


def upsert(old: DataFrame, new: DataFrame, keep: tuple[str, ...] = ("created_at", "created_by", "status"), order: tuple[str, ...] = ("updated_at",)) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same id; columns in ``keep`` stay from the old row if it has them.

    Of rows of ``new`` that share an id the last by ``order`` counts, see :func:`latest_rows`; ids of ``old`` are its key.
    """
    new = latest_rows(new, ["id"], order)
    held = [c for c in keep if c in old.columns and c in new.columns]
    first = old.select("id", *[F.col(c).alias(f"_{c}") for c in held])
    columns = [F.coalesce(f"_{c}", c).alias(c) if c in held else F.col(c) for c in new.columns]
    merged = new.join(first, "id", "left").select(*columns)
    return old.join(new.select("id"), "id", "left_anti").select(old.columns).unionByName(merged, allowMissingColumns=True)


def replace_children(children: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """All children of the parents that ``new`` names are replaced by its rows."""
    return children.join(new.select(parent).distinct(), parent, "left_anti").select(children.columns).unionByName(new.select(children.columns))


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str], order: tuple[str, ...] = ()) -> DataFrame:
    """Adds the rows whose key is not there yet, each key once: its last row by ``order``, see :func:`latest_rows`."""
    fresh = latest_rows(new, key, order).join(old.select(key), key, "left_anti").select(old.columns)
    return old.unionByName(fresh)


def patch(old: DataFrame, changes: DataFrame, allowed: list[str], version: str | None = None, order: tuple[str, ...] = ("updated_at",)) -> DataFrame:
    """Sparse update: non-null changes to allowed columns win; others are ignored. ``version`` counts the changes made to a row.

    Changes that share an id are made in turn by ``order``, then by all columns: each column ends with its last value.
    """
    columns = [c for c in allowed if c in changes.columns]
    turn = F.struct(*dict.fromkeys([*[c for c in order if c in changes.columns], *changes.columns]))
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), turn)).alias(f"_{c}") for c in columns]
    renamed = changes.groupBy("id").agg(*last, F.count("*").alias("_hits"))
    out = [F.coalesce(f"_{c}", c).alias(c) if c in columns else (F.col(c) + F.coalesce("_hits", F.lit(0))).cast(old.schema[c].dataType).alias(c) if c == version else F.col(c) for c in old.columns]
    return old.join(renamed, "id", "left").select(*out)


def cascade_delete(parents: DataFrame, children: DataFrame, gone: DataFrame, parent: str) -> tuple[DataFrame, DataFrame]:
    """Parents without the ids in ``gone``, and children without theirs."""
    return parents.join(gone.select("id"), "id", "left_anti"), children.join(gone.select(F.col("id").alias(parent)), parent, "left_anti").select(children.columns)


def restricted(gone: DataFrame, children: DataFrame, parent: str) -> DataFrame:
    """Ids that may not be deleted, as children still point at them."""
    return gone.join(children.select(F.col(parent).alias("id")), "id", "left_semi").select("id")


def append_segments(segments: DataFrame, new: DataFrame) -> DataFrame:
    """Adds rows (record, ...) with indexes that go on from each record's greatest."""
    top = segments.groupBy("record").agg(F.max("idx").alias("_top"))
    order = Window.partitionBy("record").orderBy("start_ms", "end_ms", "text")
    numbered = new.join(top, "record", "left").withColumn("idx", F.coalesce("_top", F.lit(0)) + F.row_number().over(order)).drop("_top")
    return segments.unionByName(numbered.select(segments.columns))


def finalize(records: DataFrame, segments: DataFrame) -> DataFrame:
    """Headers with text, counts and durations rebuilt from their segments, marked completed."""
    built = record_stats(segments).join(full_text(segments), "record").withColumnRenamed("full_text", "_text")
    done = records.join(built, records["id"] == built["record"], "left")
    return done.select("id", F.coalesce("_text", F.lit("")).alias("full_text"), F.coalesce("n_segments", F.lit(0)).alias("n_segments"), F.coalesce("duration_ms", F.lit(0)).alias("duration_ms"), F.lit("completed").alias("status"))


def backfill_uuid(df: DataFrame, column: str = "segment_uuid", seed: str = "id") -> DataFrame:
    """Blank identifiers filled by a name-based one, so that a rerun fills in the same."""
    digest = F.md5(F.concat(F.lit(column), F.col(seed).cast("string")))
    made = F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.substring(digest, 13, 4), F.substring(digest, 17, 4), F.substring(digest, 21, 12))
    return df.withColumn(column, F.when(F.trim(F.coalesce(column, F.lit(""))) == "", made).otherwise(F.col(column)))


def layered(key: str, *layers: DataFrame) -> DataFrame:
    """Settings (key, name, value) where the first layer that has a value wins."""
    ranked = None
    for k, layer in enumerate(layers):
        part = layer.select(key, "name", "value", F.lit(k).alias("_layer")).where("value is not null and trim(value) <> ''")
        ranked = part if ranked is None else ranked.unionByName(part)
    return ranked.groupBy(key, "name").agg(F.min_by("value", "_layer").alias("value"), F.min("_layer").alias("layer"))


def foreign_key_violations(children: DataFrame, parents: DataFrame, column: str) -> DataFrame:
    return children.join(parents.select(F.col("id").alias(column)), column, "left_anti")


def unique_violations(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def migrate(df: DataFrame, added: dict[str, tuple[str, object]]) -> DataFrame:
    """Additive, repeatable schema migration: missing columns appear with type and default."""
    for name, (kind, default) in added.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(default).cast(kind))
    return df
