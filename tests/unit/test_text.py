import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from confab.functions import cleanup as C
from confab.functions import hotwords as H


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("二零二六年百分之二十五下午三点半端口八零八零预算五千八百元", "2026年25%下午3:30端口8080预算5800元"),
        ("三月五号上午十点", "3月5号上午10:00"),
        ("三点", "三点"),
        ("晚上八点二十分", "晚上8:20"),
        ("下午三点一刻和四点三刻", "下午3:15和4:45"),
        ("版本二点五", "版本2.5"),
        ("一万两千三百", "12300"),
        ("一二三", "一二三"),
        ("三十五块钱 两小时", "35块钱 2小时"),
        ("零", "零"),
        ("", ""),
    ],
)
def test_numbers(text, want):
    assert C.normalize_numbers(text) == want


@pytest.mark.parametrize(("text", "want"), [("五千八百", 5800), ("十", 10), ("一百零五", 105), ("两亿三千万", 230_000_000), ("一二", None), ("", None), ("a", None)])
def test_chinese_number(text, want):
    assert C.chinese_number(text) == want


def test_fillers_in_both_forms(spark):
    cases = ["嗯金额额外看看那个那个我们开始", "呃，今天吧", "就是说呢开始", "对对对 好", "", "   "]
    assert C.remove_fillers(cases[0]) == "金额额外看看那个我们开始"
    frame = spark.createDataFrame([(c,) for c in cases], "t string")
    assert [r[0] for r in frame.select(C.fillers_removed(F.col("t"))).collect()] == [C.remove_fillers(c) for c in cases]


TEXTS = st.text(alphabet="你好的了嗯啊，。！？、；：,. 12ab", max_size=40)


def test_normalize_in_both_forms(spark):
    found = []

    @settings(max_examples=200, deadline=None)
    @given(TEXTS)
    def gather(t):
        found.append(t)

    gather()
    frame = spark.createDataFrame([(t,) for t in found], "t string")
    assert [r[0] for r in frame.select(C.normalized(F.col("t"))).collect()] == [C.normalize(t) for t in found]


def test_marks_collapse_to_the_strongest():
    assert C.clean("大家好。，今天开始开会。。") == "大家好。今天开始开会。"
    assert C.normalize("真的吗，？！。") == "真的吗？"


def test_punctuation_keeps_numbers_and_uses_the_model_for_bare_text():
    assert C.restore_punctuation("涨了3.5个点,3:30开会") == "涨了3.5个点，3:30开会。"
    assert C.restore_punctuation("你好", lambda t: t + "！") == "你好！"
    assert C.restore_punctuation("你好,再见", lambda t: "x") == "你好，再见。"
    assert C.restore_punctuation("你好", lambda t: 1 / 0) == "你好。"
    assert C.restore_punctuation("好了吗") == "好了吗？"
    assert C.restore_punctuation("行。但是不好") == "行。。但是不好。"
    assert C.clean("行。但是不好", longest=40) == "行。但是不好。"
    assert C.restore_punctuation("  ") == "  "


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="你好的了和吗", max_size=150))
def test_long_runs_split_without_losing_text(text):
    out = C.split_long(text)
    assert out.replace("，", "") == text
    assert (out == text) or len(text) > 40


def test_split_prefers_the_boundary_nearest_the_target():
    run = "好" * 30 + "的" + "好" * 30
    assert C.split_long(run) == "好" * 30 + "的，" + "好" * 30
    assert C.split_long("好" * 60) == "好" * 60


def test_switches_and_details():
    assert C.clean("嗯三百元", fillers=False, punctuation=False) == "嗯 300 元"
    d = C.details("嗯那个那个哈哈哈哈")
    assert d["fillers"] == ["那个那个", "嗯", "哈"] and d["repeats"] == ["哈哈哈哈"] and d["changed"]


def test_boundary_dedup(spark):
    from confab.operators.timeline import boundary_cut

    cases = [("项目计划", "目计划确认"), ("你好", "你好"), ("abc", "abc  d"), ("", "x"), ("aaaa", "aaaab"), (None, "q")]
    frame = spark.createDataFrame(cases, "p string, c string")
    got = [r[0] for r in frame.select(C.boundary_deduplicated(F.col("p"), F.col("c"))).collect()]
    assert got == [boundary_cut(*c) for c in cases] == ["确认", "你好", "d", "x", "b", "q"]


def test_bytes_width_and_spacing(spark):
    assert C.bytes_decoded("<0xE4><0xBD><0xA0>好<0xFF>") == "你好�"
    assert C.width_of("a你") == 3 and C.tail_fitting("ab你好", 4) == "你好" and C.tail_fitting("ab你好", 3) == "好"
    row = spark.createDataFrame([("我 们 say hi 吗",)], "t string").select(C.han_spacing(F.col("t")), C.spaced_han(F.col("t")), C.cased(F.col("t"), "lower")).first()
    assert tuple(row) == ("我们 say hi 吗", "我 们 say hi 吗", "我 们 say hi 吗")


def test_injected_corrector(spark):
    frame = spark.createDataFrame([("ab",), (None,)], "t string")
    good = frame.select(C.corrected(F.col("t"), lambda t: (t.upper(), [("a", "A", 0), ("bad",)])).alias("c")).select("c.*").collect()
    assert good[0]["text"] == "AB" and len(good[0]["edits"]) == 1 and good[1]["text"] is None
    assert frame.select(C.corrected(F.col("t"), lambda t: 1 / 0).alias("c")).first()["c"]["text"] == "ab"


def test_pinyin_keys():
    assert [H.fuzzy_key(x) for x in ("shi", "niu", "jing", "zhang", "lü", "lu:", "Cheng")] == ["si", "liu", "jin", "zan", "lv", "lv", "cen"]


def test_rewriting():
    text, edits = H.HotwordRewriter(["世界", "世界银行"])("四界银航今天开会")
    assert text == "世界银行今天开会" and edits == [{"position": 0, "end": 4, "original": "四界银航", "corrected": "世界银行", "method": "fuzzy_pinyin", "confidence": 0.9}]
    assert H.HotwordRewriter(["世界", "世界银行"], fuzzy=False)("四界银航")[0] == "四界银航"
    text, edits = H.HotwordRewriter(["BERT", "OpenAI"])("b e r t uses open ai and bat not combat")
    assert text == "BERT uses OpenAI and BERT not combat" and len(edits) == 3
    assert H.HotwordRewriter([])("x") == ("x", [])


def test_matched_terms_longest_first(spark):
    words = H.HotwordRewriter(["ai", "openai", "zz"])
    assert spark.createDataFrame([("I use OpenAI",)], "t string").select(words.matched_terms(F.col("t"))).first()[0] == ["openai", "ai"]


def test_token_corrections(spark):
    row = spark.createDataFrame([("the bat, okr x",)], "t string").select(H.token_corrections(F.col("t"), ["BERT", "OKR"])).first()[0]
    assert [(c["position"], c["corrected"]) for c in row] == [(1, "BERT"), (2, "OKR")]
    assert H.context_correction("用户增长", ["全量", "x"]) == "全量用户" and H.context_correction("训练模型", ["x", "BERT"]) == "BERT" and H.context_correction("", []) is None


def test_decoder_assets():
    assert H.decoder_lines("openai", 4, True) == ["openai :4", "Openai :4"]
    assert H.decoder_lines("openai", 4) == ["openai :2.5", "Openai :2.5"]
    assert H.decoder_lines("你好", 7.5) == ["你 好 :7.5"] and H.decoder_lines("x :3", 9) == ["x :3"] and H.boosted("长", 10) == "长 :10"
    assert H.decoder_vocabulary("<blk> 0\n▁Open 1\n▁你 2\n▁好 3\nbad")[-3:] == ["▁\t-1", "你\t-999999", "好\t-999999"]


def test_term_candidates(spark):
    row = spark.createDataFrame([("我们用BERT2，好",)], "t string").select(C.term_candidates(F.col("t"))).first()[0]
    assert sorted(row) == sorted(["我们", "们用", "用好", "我们用", "们用好", "bert", "bert2"])
