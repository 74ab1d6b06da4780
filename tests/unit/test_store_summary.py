import json
import tracemalloc

import pytest
from pyspark.sql import functions as F

from confab.functions import plugins as P
from confab.operators import settings as G
from confab.operators import store as S
from confab.operators import summarize as Z


def test_upsert_keeps_creation_and_status(spark):
    old = spark.createDataFrame([(1, "a", "t0", "draft"), (2, "b", "t0", "done")], "id int, title string, created_at string, status string")
    new = spark.createDataFrame([(1, "A", "t9", "completed"), (3, "c", "t9", "completed")], "id int, title string, created_at string, status string")
    assert sorted(map(tuple, S.upsert(old, new).collect())) == [(1, "A", "t0", "draft"), (2, "b", "t0", "done"), (3, "c", "t9", "completed")]


def test_repeated_ids_count_once(spark):
    kind = "id int, title string, status string, updated_at string"
    old = spark.createDataFrame([(1, "a", "draft", "t0")], kind)
    new = spark.createDataFrame([(1, "late", "x", "t3"), (1, "z", "x", "t2"), (1, None, "x", None), (2, "n", "y", "t1"), (2, "n", "y", "t1"), (2, "m", "y", "t1")], kind)
    assert sorted(map(tuple, S.upsert(old, new).collect())) == [(1, "late", "draft", "t3"), (2, "n", "y", "t1")]
    assert sorted(map(tuple, S.insert_ignore(old, new, ["id"], ("updated_at",)).collect())) == [(1, "a", "draft", "t0"), (2, "n", "y", "t1")]
    held = spark.createDataFrame([(1, "a", "draft", 5), (3, "c", "draft", 0)], "id int, title string, status string, rev int")
    change = spark.createDataFrame([(1, None, "done", "t9"), (1, "b", None, "t2"), (1, "c", "open", "t1")], kind)
    assert sorted(map(tuple, S.patch(held, change, ["title", "status"], "rev").collect())) == [(1, "b", "done", 8), (3, "c", "draft", 0)]
    assert S.upsert(old, new.limit(0)).count() == S.patch(old, new.limit(0), ["title"]).count() == 1


def test_patch_and_version(spark):
    old = spark.createDataFrame([(1, "a", "x", 0), (2, "b", "y", 4)], "id int, text string, owner string, rev int")
    change = spark.createDataFrame([(2, "B", "evil")], "id int, text string, owner string")
    assert sorted(map(tuple, S.patch(old, change, ["text"], "rev").collect())) == [(1, "a", "x", 0), (2, "B", "y", 5)]


def test_search_is_case_blind_and_keeps_wildcards(spark):
    rows = spark.createDataFrame([("Plan", None), ("x", "my PLAN"), ("y", "z")], "a string, b string")
    assert S.search(rows, "plan", ["a", "b"]).count() == 2 and S.search(rows, "p_an", ["a", "b"]).count() == 2 and S.search(rows, "", ["a"]).count() == 3


def test_pages_clamp_and_total(spark):
    rows = spark.range(250)
    assert S.page(rows, [F.col("id")], 999, -5).count() == 100
    assert [tuple(r) for r in S.page(rows, [F.col("id")], 0, 249).collect()] == [(249, 250)]


def test_reservation_rules(spark):
    users = spark.createDataFrame([(1, "u1", "A", "active"), (2, "u2", "B", "active"), (3, "u3", "C", "disabled")], "id int, username string, display_name string, status string")
    meets = spark.createDataFrame([(10, 1)], "id int, organizer int")
    people = spark.createDataFrame([(10, 1), (10, 2), (10, 3), (10, 9)], "meeting int, person int")
    friends = spark.createDataFrame([(1, 2), (1, 3)], "user int, friend int")
    assert sorted(r["person"] for r in S.invalid_participants(meets, people, users, friends).collect()) == [3, 9]
    assert S.visible_reservations(meets.withColumn("status", F.lit("s")), people, 2).count() == 1 and S.visible_reservations(meets.withColumn("status", F.lit("s")), people, 5).count() == 0
    row = spark.createDataFrame([([2, 2, 3, 1], 1, [2, 3], [2])], "w array<int>, o int, a array<int>, f array<int>").select(S.resolve_participants(F.col("w"), F.col("o"), F.col("a"), F.col("f")).alias("r")).first()["r"]
    assert row["valid"] == [2] and row["invalid"] == [3]


def test_times(spark):
    rows = spark.createDataFrame([("2026-07-20T09:00:00+08:00", "2026-07-20T10:00:00+08:00"), ("2026-07-20T10:00:00Z", "2026-07-20T09:00:00Z"), ("bad", "x")], "a string, b string")
    assert [r[0] for r in rows.select(S.valid_span(F.col("a"), F.col("b"))).collect()] == [True, False, False]
    r = spark.createDataFrame([(1, 2)], "a int, b int")
    state = lambda now: r.select(S.time_status(F.col("a"), F.col("b"), F.lit(now))).first()[0]
    assert [state(0), state(1), state(2), state(3)] == ["upcoming", "running", "running", "ended"]
    assert r.select(S.time_status(F.lit(None).cast("int"), F.col("b"), F.lit(1))).first()[0] == "unknown"


def test_profiles(spark):
    rows = [("n", "a@b", "1", "data:image/png;base64,AAEC"), ("n" * 61, "a@b", "", None), ("n", "ab", "", None), ("n", "", "", "AAEC"), ("n", None, None, "")]
    frame = spark.createDataFrame(rows, "d string, e string, p string, v string")
    assert [r[0] for r in frame.select(S.valid_profile(*map(F.col, "depv"))).collect()] == [True, False, False, False, True]


def test_json_and_text_helpers(spark):
    frame = spark.createDataFrame([('{"a": 1, "text": "x"}', " ", "y"), ("bad", "z", "y")], "j string, p string, q string")
    got = frame.select(S.residual_metadata(F.col("j"), ["text"]), S.first_text(F.col("p"), F.col("q"))).collect()
    assert [tuple(r) for r in got] == [('{"a":"1"}', "y"), ("{}", "z")]
    assert [r[0] for r in spark.createDataFrame([("1.5",), ("x",), (None,)], "v string").select(S.number_or(F.col("v"), 7)).collect()] == [1.5, 7.0, 7.0]


def test_hotword_lists(spark):
    rows = [("l", 0, " OpenAI ", 3.5), ("l", 1, "openai", 8.0), ("l", 2, "# no", 1.0), ("l", 3, "贾扬清", 7.0), ("l", 4, "x" * 81, 1.0)]
    found = S.clean_hotwords(spark.createDataFrame(rows, "list string, pos int, word string, score double")).orderBy("pos").collect()
    assert [(r["word"], r["score"]) for r in found] == [("OpenAI", 3.5), ("贾扬清", 7.0)]


def test_presets_protect_shared_words(spark):
    presets = spark.createDataFrame([("a", "x"), ("a", "s"), ("b", "y"), ("b", "s"), ("c", "z")], "preset string, word string")
    enabled = spark.createDataFrame([("y",), ("s",)], "word string")
    assert [r["preset"] for r in S.complete_presets(presets, enabled).collect()] == ["b"]
    on = S.toggle_preset(enabled, presets, "a", True)
    assert sorted(r[0] for r in on.collect()) == ["s", "x", "y"]
    assert sorted(r[0] for r in S.toggle_preset(on, presets, "a", False).collect()) == ["s", "y"]


def test_mutations(spark):
    segs = spark.createDataFrame([(1, 0, 0, 5, "a"), (2, 0, 0, 5, "b")], "record int, idx long, start_ms int, end_ms int, text string")
    new = spark.createDataFrame([(1, 9, 12, "d"), (1, 5, 9, "c"), (3, 0, 1, "e")], "record int, start_ms int, end_ms int, text string")
    assert sorted((r["record"], r["idx"], r["text"]) for r in S.append_segments(segs, new).collect()) == [(1, 0, "a"), (1, 1, "c"), (1, 2, "d"), (2, 0, "b"), (3, 1, "e")]
    assert sorted(r["text"] for r in S.replace_children(segs, segs.where("record = 1").withColumn("text", F.lit("n")), "record").collect()) == ["b", "n"]
    out = S.migrate(spark.createDataFrame([(1,)], "id int"), {"status": ("string", "completed"), "id": ("int", 0)}).first()
    assert tuple(out) == (1, "completed")
    zipped = S.zip_by_position(spark.createDataFrame([(1, ["a", "b"])], "k int, l array<string>"), spark.createDataFrame([(1, ["x"])], "k int, r array<string>"), "k", "l", "r")
    assert sorted((r["left_item"], r["right_item"]) for r in zipped.collect()) == [("a", "x"), ("b", None)]
    flags = spark.createDataFrame([([("a",), ("b",)],)], "f array<struct<type:string>>").select(S.hide_flags(F.col("f"), ["b"])).first()[0]
    assert len(flags) == 1
    hyps = spark.createDataFrame([("u", "a_b", -1000.0), ("u", "a_b", -1000.0)], "utt string, ys string, log_prob double")
    assert abs(S.merge_hypotheses(hyps).first()["log_prob"] - (-1000 + 0.6931471805599453)) < 1e-9


def test_alias_normalisation():
    one = Z.normalize_single({"meeting_summary": " m ", "main_topics": ["t", {"title": "u", "content": "c"}, {}], "key_decisions": ["d", {"decision": "e"}], "pending_issues": "q", "todos": [{"action": "x", "assignee": "p"}, {"no": 1}], "risk_items": ["r"], "contributions": [{"name": "n", "content": "c"}, "bad"]})
    assert one["overview"] == "m" and [t["topic"] for t in one["topics"]] == ["t", "u"] and [d["content"] for d in one["decisions"]] == ["d", "e"]
    assert one["open_questions"] == ["q"] and one["action_items"] == [{"action": "x", "assignee": "p", "task": "x"}] and one["risks"] == [{"description": "r"}] and len(one["speaker_contributions"]) == 1
    assert Z.normalize_single("bad", "f")["overview"] == "f"
    many = Z.normalize_multi({"overview": "o", "meeting_overviews": [{"id": "1", "name": "n", "key_topics": "k"}], "common_themes": ["c"], "timeline": {"key_events": ["e", {"content": "f", "time": "t"}]}, "project_progress": ["p"], "risks": [{"risk": "r"}]})
    assert many["executive_summary"] == "o" and many["meeting_summaries"][0]["topics"] == ["k"] and many["common_topics"][0]["topic"] == "c"
    assert [e["event"] for e in many["timeline"]] == ["e", "f"] and many["progress_changes"] == ["p"] and many["new_risks"][0]["description"] == "r"
    kept = Z.keep_sources([{"title": "T", "record_id": "zz"}], [{"record_id": "1", "title": "s", "summary": "x"}, {"record_id": "2"}])
    assert [k["record_id"] for k in kept] == ["1", "2"] and kept[0]["title"] == "T" and kept[0]["summary"] == "x"


def test_schema_paths():
    assert Z.violations({"overview": 1}, Z.SINGLE_SCHEMA) == ["$.overview must be string"]
    assert Z.violations({}, Z.SINGLE_SCHEMA) == ["$.overview is required"]
    assert Z.violations({"overview": "", "topics": [{}, 3]}, Z.SINGLE_SCHEMA) == ["$.topics[1] must be object"]
    assert Z.violations(True, {"type": "integer"})
    filled = Z.schema_defaults({"overview": "x", "open_questions": ["q"] * 99}, Z.SINGLE_SCHEMA)
    assert len(filled["open_questions"]) == 20 and filled["risks"] == []


def test_markdown_numbers_run_on():
    text = Z.render_single({"overview": "o", "decisions": [{"content": "a|b"}]}, {"title": "周会", "record_id": "r1"})
    assert [line for line in text.splitlines() if line.startswith("## ")] == ["## 一、会议信息", "## 二、会议概述", "## 三、关键决策", "## 四、来源记录"]
    assert "a\\|b" in text and Z.append_section(text, "附", "c").count("## 五、附") == 1 and Z.append_section(text, "附", " ") == text
    assert [Z.chinese_ordinal(n) for n in (1, 10, 11, 20, 21)] == ["一", "十", "十一", "二十", "二十一"]
    many = Z.render_multi({"executive_summary": "e", "timeline": [{"date": "d", "event": "v"}]}, {"record_count": 2})
    assert "## 二、执行摘要" in many and "- **d** — v" in many


def test_diagrams(spark):
    d = {"type": "mindmap", "title": "T(1)", "nodes": [{"id": "a", "label": "A"}, {"id": "b", "parent": "a"}, {"id": "c"}, {"id": "x", "parent": "y"}, {"id": "y", "parent": "x"}]}
    assert Z.render_mermaid(d) == "mindmap\n  root((T[1]))\n    A\n        b\n    c"
    assert Z.render_tree(d) == "# T(1)\n\n- A\n  - b\n- c"
    flow = Z.render_mermaid({"type": "flowchart", "nodes": [{"id": "a", "children": ["b"]}, {"id": "b", "parent": "a"}]})
    assert flow == "flowchart TD\n  a[a]\n  b[b]\n\n  a --> b\n  a --> b"
    assert Z.render_mermaid({"type": "architecture", "nodes": [{"id": "a"}]}).startswith("flowchart LR") and Z.render_mermaid(None) == "" and Z.render_tree({"title": "t"}).endswith("(无节点)")


def test_overview_and_fences(spark):
    frame = spark.createDataFrame([("[A] 你好。\n\n[B] 再见",), ("好" * 200 + "。" + "长" * 300,), ("x" * 400,), (None,)], "t string")
    found = [r[0] for r in frame.select(Z.overview(F.col("t"))).collect()]
    assert found[0] == "你好。 再见" and found[1] == "好" * 200 + "。…" and found[2] == "x" * 360 + "…" and found[3] == ""
    row = spark.createDataFrame([('```json\n{"overview": "o"}\n```', "not json")], "a string, b string").select(Z.normalized_answers(F.col("a")), Z.schema_errors(F.col("b"), Z.SINGLE_SCHEMA)).first()
    assert json.loads(row[0])["overview"] == "o" and row[1] == ["$ is not JSON"]
    key = spark.createDataFrame([("sk-abcdefghij", {"api_key": "k", "m": "1"})], "k string, s map<string,string>").select(Z.redacted_key(F.col("k")), Z.public_settings(F.col("s"))).first()
    assert key[0] == "sk-a***ghij" and key[1] == {"m": "1", "has_api_key": "true"}


def test_lines_keep_digits_and_lose_spaces(spark):
    texts = spark.createDataFrame([(1, "0 of 490\n  171 \n \n\u3000\u00a02002\u2003\n\tx\r"), (2, None), (3, ""), (4, " ")], "record long, text string")
    found = Z.text_to_segments(texts).orderBy("record", "idx").collect()
    assert [tuple(r) for r in found] == [(1, k, k * 10_000, t) for k, t in enumerate(["0 of 490", "171", "2002", "\tx\r"])]


class Failing:
    def complete(self, prompt):
        raise RuntimeError("x" * 2000)


def test_map_reduce_keeps_errors(spark):
    segs = spark.createDataFrame([(1, k, "A", k * 1000, k * 1000 + 500, "word " * 30) for k in range(10)], "record long, idx long, speaker string, start_ms long, end_ms long, text string")
    rows = Z.summarize_records(segs, P.FirstLinesSummarizer, 400).collect()
    assert rows[0]["chunks"] == 5 and json.loads(rows[0]["answer"])["overview"]
    bad = Z.summarize_records(segs, Failing, 9999).first()
    assert bad["error"].startswith("RuntimeError") and len(bad["error"]) == 1000
    records = spark.createDataFrame([(1, "t1", "a"), (2, "t2", "b" * 9000)], "id long, title string, full_text string")
    items = spark.createDataFrame([(7, 2, 0), (7, 1, 1)], "summary_id long, record_id long, sort_order int")
    row = Z.summarize_many(items, records, P.FirstLinesSummarizer).first()
    meetings = json.loads(row["answer"])["meeting_summaries"]
    assert (row["n"], row["failed"]) == (2, 0) and [m["record_id"] for m in meetings] == ["2", "1"]
    assert Z.summarize_many(items, records, Failing).first()["failed"] == 2


class Traced:
    """Answers with how many texts of 100,000 characters Python holds."""

    def __init__(self):
        tracemalloc.start()

    def complete(self, prompt):
        return {"overview": str(sum(100_000 <= t.size < 110_000 for t in tracemalloc.take_snapshot().traces))}

    def __del__(self):
        tracemalloc.stop()


def test_prompts_of_a_batch_are_not_all_held(spark):
    prompts = spark.range(0, 200, 1, 1).select("id", F.concat(F.col("id").cast("string"), F.repeat(F.lit("word "), F.lit(20_000))).alias("p"))
    rows = prompts.select("id", Z.asked(F.col("p"), Traced).alias("a")).select("id", F.get_json_object("a.answer", "$.overview").cast("int").alias("held")).collect()
    assert sorted(r["id"] for r in rows) == list(range(200)) and 1 <= max(r["held"] for r in rows) < 40
    texts = spark.createDataFrame([(k, t) for k, t in enumerate(['{"overview": "o"}', None, "", "{", '{"overview": "' + "x" * 3_000_000 + '"}'] * 3)], "id int, t string").coalesce(1)
    found = {r["id"]: json.loads(r["t"])["overview"] for r in texts.select("id", Z.normalized_answers(F.col("t")).alias("t")).collect()}
    assert [len(found[k]) for k in range(15)] == [1, 0, 0, 0, 3_000_000] * 3
    assert spark.range(0).select(Z.asked(F.col("id").cast("string"), P.FirstLinesSummarizer).alias("a")).collect() == []


def test_states_are_final(spark):
    rows = [(1, 1, "pending", 0.0, None), (1, 2, "failed", 0.5, "e"), (1, 3, "processing", 0.6, None)]
    assert Z.latest_state(spark.createDataFrame(rows, "id int, at int, status string, progress double, error string")).first()["status"] == "failed"


def test_settings(spark):
    row = G.normalized_settings(spark.createDataFrame([("99999", "8", " Dictation", "k")], "pre_roll_ms string, vad_threshold string, profile string, other string")).first()
    assert tuple(row) == (2000.0, 0.95, "dictation", "k")
    words = spark.createDataFrame([([("a", 1.0, True), ("b", 2.0, False), ("a", 9.0, True)], ["quality"])], "w array<struct<text:string,score:double,enabled:boolean>>, i array<string>")
    got = words.select(G.enabled_words(F.col("w")), G.available_profile(F.lit("fast"), F.col("i"))).first()
    assert got[0] == {"a": 1.0} and got[1] == "quality"
    catalog = spark.createDataFrame([("p", "m1", False), ("p", "m2", True)], "provider string, model string, is_default boolean")
    assert G.model_choice(catalog, "p").first()["model"] == "m2" and G.model_choice(catalog, "p", "m1").first()["model"] == "m1"
    utt = spark.createDataFrame([(k, float(k % 10 + 1)) for k in range(100)], "id int, duration double")
    batches = G.duration_buckets(utt, 4, 30.0).groupBy("bucket", "batch").agg(F.sum("duration").alias("d")).collect()
    assert all(r["d"] <= 40 for r in batches) and len({r["bucket"] for r in batches}) == 4
    jobs = G.normalized_job(spark.createDataFrame([(None, None, None, 7.0)], "file_id string, filename string, status string, progress double")).first()
    assert tuple(jobs) == ("", "", "queued", 1.0)
    req, have = spark.createDataFrame([("m", "a"), ("m", "b"), ("n", "a")], "model string, file string"), spark.createDataFrame([("m", "a"), ("n", "a")], "model string, file string")
    assert [r["model"] for r in G.complete_models(req, have).collect()] == ["n"]


@pytest.mark.parametrize("order", [[("a", 1), ("b", 1)]])
def test_longest_first(spark, order):
    row = spark.createDataFrame([(["b", "ccc", "a", "ccc"],)], "t array<string>").select(S.longest_first(F.col("t"))).first()[0]
    assert row == ["ccc", "a", "b"]
