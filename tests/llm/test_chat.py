import pytest

from confab.llm import chat as X


def render(source, **names):
    return X.compile_template(X.ChatParams(template=source))(names)[0]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("a{# no #}b", "ab"),
        ("{{ 1 + 2 * 3 }}", "7"),
        ("{{ 'a' ~ 1 ~ none }}", "a1None"),
        ("{{ -2 + 3 }} {{ 7 // 2 }} {{ 7 % 4 }}", "1 3 3"),
        ("{% if x > 1 %}big{% elif x == 1 %}one{% else %}small{% endif %}", "one"),
        ("{{ 'y' if x else 'n' }}", "y"),
        ("{% for i in [1, 2, 3] %}{{ loop.index }}{{ ',' if not loop.last }}{% endfor %}", "1,2,3"),
        ("{% for i in [] %}x{% else %}none{% endfor %}", "none"),
        ("{% set y = x + 1 %}{{ y }}", "2"),
        ("  {%- if true -%}  a  {%- endif -%}  b", "ab"),
        ("{{ m.role | upper }}{{ m['role'][0] }}{{ m.gone | default('d') }}", "USERud"),
        ("{{ 'b' in ['a', 'b'] }} {{ 'c' not in 'abc' }} {{ not x }}", "True False False"),
        ("{{ m.gone is defined }} {{ x is number }} {{ m.role is not string }}", "False True False"),
        ("{{ '%}' }}{{ \"}}\" }}", "%}}}"),
        ("{{ [1, 2, 3][1:] | join('-') }}", "2-3"),
        ("{{ m | tojson }}", '{"role": "user"}'),
    ],
)
def test_language(source, want):
    assert render(source, x=1, m={"role": "user"}) == want


@pytest.mark.parametrize("source", ["{{ ''.__class__ }}", "{{ m.__class__ }}", "{{ m.keys }}", "{{ x.real }}", "{{ m['__class__'] }}"])
def test_python_attributes_are_out_of_reach(source):
    assert render(source, m={"role": "u"}, x=1) == ""


@pytest.mark.parametrize("source", ["{{ open('x') }}", "{{ m.keys() }}", "{% import os %}", "{{ x", "{% if x %}", "{{ 1 + }}", "{{ a | nofilter }}", "{{ a is notest }}", "{% for in x %}{% endfor %}"])
def test_wrong_templates_do_not_compile(source):
    with pytest.raises(X.TemplateError):
        X.compile_template(X.ChatParams(template=source))


def test_limits():
    for source, params in (("{% for a in range(1000) %}{% for b in range(1000) %}x{% endfor %}{% endfor %}", {"max_steps": 1000}), ("{{ x }}" * 20, {"max_output": 10})):
        with pytest.raises(X.TemplateError):
            X.compile_template(X.ChatParams(template=source, **params))({"x": "abc"})
    for source in ("{{ range(10000000) }}", "{{ 'a' * 1000000 }}", "{{ raise_exception('no') }}", "{{ 1 / 0 }}"):
        with pytest.raises(X.TemplateError):
            render(source)


def test_constants_fold():
    tree = X.fold_block(X.parse("a{{ 1 + 1 }}{% if false %}{{ x }}{% elif true %}b{% else %}c{% endif %}{{ 'd' | upper }}"))
    assert tree == [("out", ("lit", "a2bD"))]
    assert X.fold(X.Parser("x + (2 * 3)").whole()) == ("bin", "+", ("name", "x"), ("lit", 6))
    assert X.fold(X.Parser("1 / 0").whole())[0] == "bin"


def test_generation_spans():
    text, spans = X.compile_template()({"messages": [{"role": "user", "content": " hi "}, {"role": "assistant", "content": "yo\n"}, {"role": "assistant", "content": ""}]})
    assert text == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [text[a:b] for a, b in spans] == ["yo<|im_end|>", "<|im_end|>"]


KIND = "conv_id long, turn long, role string, text string, error string, starts int, messages string"


def test_messy_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, None, None, None), (2, 5, "user", None), (None, 0, "user", "n"), (3, 0, "user", "x" * 2_000_000)]
    frame = spark.createDataFrame([(*r, "e", 1, "m") for r in rows], KIND)
    done = {r["conv_id"]: r for r in X.format_conversations(frame).collect()}
    assert done[1]["text"].count("user\na<") == 2 and done[1]["text"].endswith("assistant\nb<|im_end|>\n") and len(done[1]["starts"]) == 1
    assert done[2]["text"] == "<|im_start|>\n<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    assert done[None]["text"] and len(done[3]["text"]) > 2_000_000 and done[3]["error"] is None
    assert X.format_conversations(spark.createDataFrame([], KIND)).count() == 0
    strict = X.ChatParams(template="{% for m in messages %}{{ raise_exception('empty') if not m.content }}{% endfor %}")
    bad = {r["conv_id"]: r for r in X.format_conversations(frame, strict).collect()}
    assert bad[2]["error"] == "empty" and bad[2]["text"] is None and bad[1]["error"] is None


def test_limits_grow_with_the_conversation():
    turns = [{"role": ("user", "assistant")[k % 2], "content": f"t{k}"} for k in range(200_000)]
    text, spans = X.compile_template()({"messages": turns})
    assert text == "".join(f"<|im_start|>{m['role']}\n{m['content']}<|im_end|>\n" for m in turns) and len(spans) == 100_000
    small = X.ChatParams(max_steps=10, max_output=10, max_range=10)
    assert X.compile_template(small)({"messages": turns[:500]})[0] == text[: text.index("<|im_start|>user\nt500<")]
    counted = X.ChatParams(template="{% for k in range(messages | length) %}{{ messages[k].content }}{% endfor %}")
    assert X.compile_template(counted)({"messages": turns})[0].endswith("t199999")
    endless = "{% for m in messages %}{% for a in range(99999) %}x{% endfor %}{% endfor %}"
    with pytest.raises(X.TemplateError):
        X.compile_template(X.ChatParams(template=endless))({"messages": turns[:100]})


def test_many_rows_without_an_id_are_formatted_whole(spark, tmp_path, monkeypatch):
    turns = spark.range(170_000).selectExpr("if(id < 169990, null, id) AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('t', id) AS text")
    turns.write.parquet(str(tmp_path / "conversations.parquet"))
    done = {r["conv_id"]: r for r in X.op4_chat_format(spark, str(tmp_path)).collect()}
    assert len(done) == 11 and done[None]["n_spans"] == 84_995 and done[None]["spans"].count(",") == 84_994
    assert done[None]["text"] == "".join(f"<|im_start|>{('user', 'assistant')[k % 2]}\nt{k}<|im_end|>\n" for k in range(169_990))
    monkeypatch.setattr(X, "MAX_BATCH", 1)  # every conversation in a batch of its own
    assert {r["conv_id"]: r for r in X.op4_chat_format(spark, str(tmp_path)).collect()} == done
    whole = X.format_conversations
    monkeypatch.setattr(X, "format_conversations", lambda turns: whole(turns, X.ChatParams(template="{{ raise_exception('lost') }}")))
    with pytest.raises(Exception, match="conversation .*: lost"):
        X.op4_chat_format(spark, str(tmp_path)).collect()
