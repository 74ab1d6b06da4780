"""Chat formatting by a template compiler.

A small sandboxed template language is lexed and parsed into a syntax tree, constants
are folded, and the tree becomes Python closures that render a conversation and note
which characters lie between generation markers. A template sees only the values it is
given: names, members of mappings and items of lists are looked up in data alone, never
as Python attributes. Steps, output and ranges are limited against runaway templates; the
limits grow with a conversation's messages and characters, so that none is too long.

Language: ``{{ expression }}``, ``{% if %}/{% elif %}/{% else %}/{% endif %}``,
``{% for x in xs %}/{% else %}/{% endfor %}`` with ``loop``, ``{% set x = e %}``,
``{% generation %}/{% endgeneration %}``, ``{# comment #}`` and ``-`` beside a delimiter to
strip white space. Expressions have literals, lists, names, ``a.b``, ``a[b]``, calls of
``raise_exception`` and ``range``, filters, tests (``is defined`` and the like), arithmetic,
``~``, comparisons, ``in``, ``and``/``or``/``not`` and ``a if b else c``.

Edge cases: null roles and texts render as empty; turns order a conversation, nulls
first, ties by role and text, repeated rows are kept as turns; a null conversation id is a
conversation of its own; a conversation that raises has null text and spans and the
message in ``error``, which the query, without that column, raises; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from confab.sources.tables import table

DEFAULT_TEMPLATE = (
    "{%- for message in messages -%}\n"
    "{{ '<|im_start|>' + message.role + '\\n' }}"
    "{%- if message.role == 'assistant' -%}"
    "{% generation %}{{ message.content | trim }}{{ '<|im_end|>' }}{% endgeneration %}"
    "{%- else -%}{{ message.content | trim }}{{ '<|im_end|>' }}{%- endif -%}"
    "{{ '\\n' }}"
    "{%- endfor -%}"
)


@dataclass(frozen=True)
class ChatParams:
    template: str = DEFAULT_TEMPLATE
    max_steps: int = 1_000_000  # nodes evaluated for a conversation, beside those of its messages
    max_output: int = 100_000_000  # characters of a conversation, beside those of its messages
    max_range: int = 100_000  # numbers of a range, beside one a message
    per_message: int = 1_000  # nodes, and characters, that each message adds to the limits, beside the template's length
    per_char: int = 10  # characters that each character of a message adds


class TemplateError(ValueError):
    """The template or its use is wrong."""


class _Undefined:
    def __bool__(self) -> bool:
        return False

    def __str__(self) -> str:
        return ""


UNDEFINED = _Undefined()
TAGS = re.compile(r"(\{\{-?|\{%-?|\{#-?)")
LEX = re.compile(r"\s*(?:(?P<num>\d+(?:\.\d+)?)|(?P<str>'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|//|\*\*|[-+*/%~<>|.,:()\[\]=]))")
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"'}


def split_template(source: str) -> list[tuple[str, str]]:
    """('text' | 'expr' | 'stmt', content) parts, with white space stripped where asked."""
    parts, at, strip = [], 0, False
    while True:
        m = TAGS.search(source, at)
        text = source[at : m.start() if m else len(source)]
        if strip:
            text = text.lstrip()
        if m and m.group().endswith("-"):
            text = text.rstrip()
        if text:
            parts.append(("text", text))
        if not m:
            return parts
        close = {"{": "}}", "%": "%}", "#": "#}"}[m.group()[1]]
        end = _closing(source, m.end(), close)
        body = source[m.end() : end]
        strip = body.endswith("-")
        body = body[:-1] if strip else body
        if m.group()[1] != "#":
            parts.append(("expr" if m.group()[1] == "{" else "stmt", body.strip()))
        at = end + 2


def _closing(source: str, at: int, close: str) -> int:
    quote = None
    while at < len(source):
        c = source[at]
        if quote:
            if c == "\\":
                at += 1
            elif c == quote:
                quote = None
        elif close != "#}" and c in "'\"":
            quote = c
        elif source.startswith(close, at):
            return at
        at += 1
    raise TemplateError(f"{close} is missing")


def lex(source: str) -> list[tuple[str, object]]:
    tokens, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = LEX.match(source, at)
        if not m or m.end() == at:
            raise TemplateError(f"can't read {source[at : at + 20]!r}")
        kind, text = m.lastgroup, m.group(m.lastgroup)
        if kind == "num":
            tokens.append(("lit", float(text) if "." in text else int(text)))
        elif kind == "str":
            tokens.append(("lit", re.sub(r"\\(.)", lambda e: ESCAPES.get(e.group(1), "\\" + e.group(1)), text[1:-1], flags=re.S)))
        else:
            tokens.append((kind, text))
        at = m.end()
    return tokens


WORDS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
BINARY = [["or"], ["and"], ["not"], ["==", "!=", "<", ">", "<=", ">=", "in"], ["~"], ["+", "-"], ["*", "/", "//", "%"]]


class Parser:
    """Expressions become tuples: (kind, operands...)."""

    def __init__(self, source: str):
        self.source, self.tokens, self.at = source, lex(source), 0

    def peek(self, *texts: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "name") and self.tokens[self.at][1] in texts

    def take(self, *texts: str) -> bool:
        found = self.peek(*texts)
        self.at += found
        return found

    def need(self, text: str) -> None:
        if not self.take(text):
            raise TemplateError(f"{text!r} is missing in {self.source!r}")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError(f"a name is missing in {self.source!r}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> tuple:
        node = self.expression()
        if self.at < len(self.tokens):
            raise TemplateError(f"{self.tokens[self.at][1]!r} is unexpected in {self.source!r}")
        return node

    def expression(self) -> tuple:
        node = self.binary(0)
        if self.take("if"):
            test = self.binary(0)
            other = self.expression() if self.take("else") else ("lit", "")
            return ("cond", test, node, other)
        return node

    def binary(self, level: int) -> tuple:
        if level == len(BINARY):
            return self.unary()
        if BINARY[level] == ["not"]:
            if self.take("not"):
                return ("not", self.binary(level))
            return self.binary(level + 1)
        node = self.binary(level + 1)
        while True:
            if self.peek(*BINARY[level]):
                op = self.tokens[self.at][1]
                self.at += 1
                node = (op if op in ("or", "and") else "bin", *((node, self.binary(level + 1)) if op in ("or", "and") else (op, node, self.binary(level + 1))))
            elif "in" in BINARY[level] and self.peek("not") and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1][1] == "in":
                self.at += 2
                node = ("not", ("bin", "in", node, self.binary(level + 1)))
            else:
                return node

    def unary(self) -> tuple:
        if self.take("-"):
            return ("neg", self.unary())
        return self.postfix(self.atom())

    def atom(self) -> tuple:
        if self.at >= len(self.tokens):
            raise TemplateError(f"{self.source!r} ends early")
        kind, value = self.tokens[self.at]
        if kind == "lit":
            self.at += 1
            return ("lit", value)
        if kind == "name" and value not in ("if", "else", "in", "and", "or", "not", "is"):
            self.at += 1
            return ("lit", WORDS[value]) if value in WORDS else ("name", value)
        if self.take("("):
            node = self.expression()
            self.need(")")
            return node
        if self.take("["):
            return ("list", *self.arguments("]"))
        raise TemplateError(f"{value!r} is unexpected in {self.source!r}")

    def arguments(self, close: str) -> list[tuple]:
        found = []
        while not self.take(close):
            found.append(self.expression())
            if not self.take(","):
                self.need(close)
                break
        return found

    def postfix(self, node: tuple) -> tuple:
        while True:
            if self.take("."):
                node = ("item", node, ("lit", self.name()))
            elif self.take("["):
                node = self.index(node)
            elif self.take("("):
                if node[0] != "name" or node[1] not in FUNCTIONS:
                    raise TemplateError(f"{self.source!r} calls something other than {sorted(FUNCTIONS)}")
                node = ("call", node[1], *self.arguments(")"))
            elif self.take("|"):
                name = self.name()
                if name not in FILTERS:
                    raise TemplateError(f"there is no filter {name!r}")
                node = ("filter", name, node, *(self.arguments(")") if self.take("(") else []))
            elif self.take("is"):
                turned, name = self.take("not"), self.name()
                if name not in TESTS:
                    raise TemplateError(f"there is no test {name!r}")
                node = ("not", ("test", name, node)) if turned else ("test", name, node)
            else:
                return node

    def index(self, node: tuple) -> tuple:
        first = ("lit", None) if self.peek(":") else self.expression()
        if self.take(":"):
            last = ("lit", None) if self.peek("]") else self.expression()
            self.need("]")
            return ("slice", node, first, last)
        self.need("]")
        return ("item", node, first)


def parse(source: str) -> list[tuple]:
    """Syntax tree of a template: a list of statement nodes."""
    parts = split_template(source)
    nodes, end, at = _block(parts, 0, ())
    return nodes


def _block(parts: list[tuple[str, str]], at: int, ends: tuple[str, ...]) -> tuple[list[tuple], str, int]:
    nodes: list[tuple] = []
    while at < len(parts):
        kind, body = parts[at]
        if kind == "text":
            nodes.append(("out", ("lit", body)))
        elif kind == "expr":
            nodes.append(("out", Parser(body).whole()))
        else:
            word = body.split(None, 1)[0] if body else ""
            rest = body[len(word) :].strip()
            if word in ends:
                return nodes, body, at
            if word == "if":
                branches, test = [], Parser(rest).whole()
                other: list[tuple] = []
                while True:
                    inner, end, at = _block(parts, at + 1, ("elif", "else", "endif"))
                    branches.append((test, inner))
                    if end.startswith("elif"):
                        test = Parser(end[4:].strip()).whole()
                        continue
                    if end == "else":
                        other, _, at = _block(parts, at + 1, ("endif",))
                    break
                nodes.append(("if", branches, other))
            elif word == "for":
                m = re.match(r"([A-Za-z_]\w*)\s+in\s+(.*)$", rest, re.S)
                if not m:
                    raise TemplateError(f"can't read {body!r}")
                inner, end, at = _block(parts, at + 1, ("else", "endfor"))
                other = []
                if end == "else":
                    other, _, at = _block(parts, at + 1, ("endfor",))
                nodes.append(("for", m.group(1), Parser(m.group(2)).whole(), inner, other))
            elif word == "set":
                m = re.match(r"([A-Za-z_]\w*)\s*=(?!=)\s*(.*)$", rest, re.S)
                if not m:
                    raise TemplateError(f"can't read {body!r}")
                nodes.append(("set", m.group(1), Parser(m.group(2)).whole()))
            elif word == "generation":
                inner, _, at = _block(parts, at + 1, ("endgeneration",))
                nodes.append(("generation", inner))
            else:
                raise TemplateError(f"there is no statement {word!r}")
        at += 1
    if ends:
        raise TemplateError(f"{ends[-1]!r} is missing")
    return nodes, "", at


def _raise(message: object) -> None:
    raise TemplateError(str(message))


def _text(value: object) -> str:
    return "" if value is UNDEFINED else "True" if value is True else "False" if value is False else str(value)


FUNCTIONS: dict[str, Callable] = {"raise_exception": _raise, "range": range}
FILTERS: dict[str, Callable] = {
    "trim": lambda v, chars=None: _text(v).strip(chars),
    "upper": lambda v: _text(v).upper(),
    "lower": lambda v: _text(v).lower(),
    "title": lambda v: _text(v).title(),
    "capitalize": lambda v: _text(v).capitalize(),
    "length": lambda v: len(v),
    "string": _text,
    "int": lambda v, d=0: int(v) if re.fullmatch(r"\s*-?\d+\s*", _text(v)) else d,
    "tojson": lambda v: json.dumps(None if v is UNDEFINED else v, ensure_ascii=False),
    "default": lambda v, d="", falsy=False: d if v is UNDEFINED or (falsy and not v) else v,
    "join": lambda v, sep="": sep.join(_text(x) for x in v),
    "replace": lambda v, old, new: _text(v).replace(old, new),
    "first": lambda v: v[0] if len(v) else UNDEFINED,
    "last": lambda v: v[-1] if len(v) else UNDEFINED,
    "list": lambda v: list(v),
    "reverse": lambda v: v[::-1],
}
TESTS: dict[str, Callable] = {
    "defined": lambda v: v is not UNDEFINED,
    "undefined": lambda v: v is UNDEFINED,
    "none": lambda v: v is None,
    "string": lambda v: isinstance(v, str),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "iterable": lambda v: isinstance(v, (str, list, tuple, range, dict)),
    "mapping": lambda v: isinstance(v, dict),
    "odd": lambda v: v % 2 == 1,
    "even": lambda v: v % 2 == 0,
}


def _item(value: object, key: object) -> object:
    """Members of mappings and items of lists and strings; nothing else is reachable."""
    if isinstance(value, dict):
        return value.get(key, UNDEFINED)
    if isinstance(value, (list, tuple, str, range)) and isinstance(key, int):
        return value[key] if -len(value) <= key < len(value) else UNDEFINED
    return UNDEFINED


def _add(a: object, b: object) -> object:
    return _text(a) + _text(b) if isinstance(a, str) or isinstance(b, str) else a + b


def _times(a: object, b: object) -> object:
    if not isinstance(a, (int, float)) or not isinstance(b, (int, float)):
        raise TemplateError("only numbers are multiplied")
    return a * b


OPERATORS: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b, "~": lambda a, b: _text(a) + _text(b), "+": _add, "-": lambda a, b: a - b, "*": _times, "/": lambda a, b: a / b, "//": lambda a, b: a // b, "%": lambda a, b: a % b,
}


def fold(node: tuple) -> tuple:
    """The expression with constant parts evaluated; what fails is left to rendering."""
    kind = node[0]
    if kind in ("lit", "name"):
        return node
    parts = tuple(fold(p) if isinstance(p, tuple) else p for p in node[1:])
    node = (kind, *parts)
    inner = [p for p in parts if isinstance(p, tuple)]
    if kind == "cond" and parts[0][0] == "lit":
        return parts[1] if parts[0][1] else parts[2]
    if kind in ("and", "or") and parts[0][0] == "lit":
        return parts[1] if bool(parts[0][1]) == (kind == "and") else parts[0]
    if kind not in ("call", "list") and inner and all(p[0] == "lit" for p in inner):
        try:
            return ("lit", _closure(node)({}, None))
        except Exception:
            return node
    return node


def fold_block(nodes: list[tuple]) -> list[tuple]:
    """Statements with folded expressions, dead branches dropped and neighbouring texts joined."""
    out: list[tuple] = []
    for node in nodes:
        if node[0] == "out":
            node = ("out", fold(node[1]))
            if node[1][0] == "lit":
                text = _text(node[1][1])
                if out and out[-1][0] == "out" and out[-1][1][0] == "lit":
                    text = out.pop()[1][1] + text
                node = ("out", ("lit", text))
        elif node[0] == "set":
            node = ("set", node[1], fold(node[2]))
        elif node[0] == "for":
            node = ("for", node[1], fold(node[2]), fold_block(node[3]), fold_block(node[4]))
        elif node[0] == "generation":
            node = ("generation", fold_block(node[1]))
        elif node[0] == "if":
            branches, other = [], fold_block(node[2])
            for test, body in node[1]:
                test, body = fold(test), fold_block(body)
                if test[0] == "lit" and test[1]:
                    other = body
                    break
                if test[0] != "lit":
                    branches.append((test, body))
            if not branches:
                out = fold_block(out + other)
                continue
            node = ("if", branches, other)
        out.append(node)
    return out


class _State:
    __slots__ = ("parts", "size", "spans", "steps", "max_steps", "max_output", "max_range")

    def __init__(self, params: ChatParams, messages: list[dict]):
        self.parts, self.size, self.spans, self.steps = [], 0, [], 0
        chars = sum(len(v) for m in messages for v in m.values() if isinstance(v, str))
        more = len(messages) * (params.per_message + len(params.template))
        self.max_steps = params.max_steps + more
        self.max_output = params.max_output + more + params.per_char * chars
        self.max_range = params.max_range + len(messages)

    def step(self) -> None:
        self.steps += 1
        if self.steps > self.max_steps:
            raise TemplateError("the template takes too many steps")

    def write(self, text: str) -> None:
        self.size += len(text)
        if self.size > self.max_output:
            raise TemplateError("the output is too long")
        self.parts.append(text)

    def range(self, *args: int) -> range:
        found = range(*args)
        if len(found) > self.max_range:
            raise TemplateError("range is too long")
        return found


def _closure(node: tuple) -> Callable:
    """Closure (names, state) -> value of an expression."""
    kind = node[0]
    if kind == "lit":
        value = node[1]
        return lambda names, state: value
    if kind == "name":
        name = node[1]
        return lambda names, state: names.get(name, UNDEFINED)
    if kind == "list":
        items = [_closure(n) for n in node[1:]]
        return lambda names, state: [f(names, state) for f in items]
    if kind in ("item", "and", "or"):
        a, b = _closure(node[1]), _closure(node[2])
        if kind == "item":
            return lambda names, state: _item(a(names, state), b(names, state))
        if kind == "and":
            return lambda names, state: a(names, state) and b(names, state)
        return lambda names, state: a(names, state) or b(names, state)
    if kind == "slice":
        a, b, c = map(_closure, node[1:])
        return lambda names, state: a(names, state)[b(names, state) : c(names, state)]
    if kind == "not":
        a = _closure(node[1])
        return lambda names, state: not a(names, state)
    if kind == "neg":
        a = _closure(node[1])
        return lambda names, state: -a(names, state)
    if kind == "cond":
        a, b, c = map(_closure, node[1:])
        return lambda names, state: b(names, state) if a(names, state) else c(names, state)
    if kind == "bin":
        f, a, b = OPERATORS[node[1]], _closure(node[2]), _closure(node[3])
        return lambda names, state: f(a(names, state), b(names, state))
    table_, args = {"filter": FILTERS, "test": TESTS, "call": FUNCTIONS}[kind], [_closure(n) for n in node[2:]]
    f = table_[node[1]]
    if f is range:
        return lambda names, state: state.range(*[a(names, state) for a in args])
    return lambda names, state: f(*[a(names, state) for a in args])


def _runner(nodes: list[tuple]) -> Callable:
    """Closure (names, state) that renders statements."""
    steps = [_statement(n) for n in nodes]

    def run(names: dict, state: _State) -> None:
        for s in steps:
            state.step()
            s(names, state)

    return run


def _statement(node: tuple) -> Callable:
    kind = node[0]
    if kind == "out":
        if node[1][0] == "lit":
            text = node[1][1]
            return lambda names, state: state.write(text)
        value = _closure(node[1])
        return lambda names, state: state.write(_text(value(names, state)))
    if kind == "set":
        name, value = node[1], _closure(node[2])

        def assign(names: dict, state: _State) -> None:
            names[name] = value(names, state)

        return assign
    if kind == "generation":
        body = _runner(node[1])

        def generation(names: dict, state: _State) -> None:
            start = state.size
            body(names, state)
            state.spans.append((start, state.size))

        return generation
    if kind == "if":
        branches, other = [(_closure(t), _runner(b)) for t, b in node[1]], _runner(node[2])

        def choose(names: dict, state: _State) -> None:
            for test, body in branches:
                if test(names, state):
                    return body(names, state)
            return other(names, state)

        return choose
    name, items, body, other = node[1], _closure(node[2]), _runner(node[3]), _runner(node[4])

    def loop(names: dict, state: _State) -> None:
        found = items(names, state)
        found = [] if found is UNDEFINED or found is None else list(found)
        own = dict(names)
        for k, item in enumerate(found):
            state.step()
            own[name] = item
            own["loop"] = {"index": k + 1, "index0": k, "first": k == 0, "last": k == len(found) - 1, "length": len(found), "previtem": found[k - 1] if k else UNDEFINED, "nextitem": found[k + 1] if k + 1 < len(found) else UNDEFINED}
            body(own, state)
        if not found:
            other(names, state)

    return loop


def compile_template(params: ChatParams = ChatParams()) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """Function from names to the rendered text and its generation spans (end exclusive)."""
    run = _runner(fold_block(parse(params.template)))

    def render(names: dict) -> tuple[str, list[tuple[int, int]]]:
        messages = names.get("messages")
        state = _State(params, [m for m in messages if isinstance(m, dict)] if isinstance(messages, list) else [])
        try:
            run(dict(names), state)
        except TemplateError:
            raise
        except Exception as e:  # whatever a template's values raise is that conversation's error, not the task's
            raise TemplateError(f"{type(e).__name__}: {e}") from e
        return "".join(state.parts), state.spans

    return render


MAX_BATCH = 1 << 26  # characters of the texts of an Arrow batch, after which another begins
KIND = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("starts", T.ArrayType(T.IntegerType())),
        T.StructField("ends", T.ArrayType(T.IntegerType())),
        T.StructField("error", T.StringType()),
    ]
)


def format_conversations(turns: DataFrame, params: ChatParams = ChatParams()) -> DataFrame:
    """(conv_id, text, starts, ends, error): each conversation rendered, with its generated spans.

    One shuffle gathers a conversation's turns; rendering is a map.
    """
    compile_template(params)  # a wrong template fails here, not in a task
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("messages"))
    # array_sort puts null turns first within structs, as their fields compare

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(params)
        kinds = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string())
        for batch in batches:
            out: list[tuple] = []
            start = size = 0
            for k in range(batch.num_rows):
                try:
                    text, spans = render({"messages": batch.column(1)[k].as_py()})
                    out.append((text, [a for a, _ in spans], [b for _, b in spans], None))
                    size += len(text)
                except TemplateError as e:
                    out.append((None, None, None, str(e)))
                if size > MAX_BATCH or k == batch.num_rows - 1:  # an Arrow batch holds less than 2 GB of text
                    columns = [pa.array([o[c] for o in out], kind) for c, kind in enumerate(kinds)]
                    yield pa.RecordBatch.from_arrays([batch.column(0)[start : k + 1], *columns], ["conv_id", *KIND.names])
                    out, start, size = [], k + 1, 0

    return grouped.mapInArrow(rendered, T.StructType([turns.schema["conv_id"], *KIND.fields]))


def op4_chat_format(spark, sf_dir: str) -> DataFrame:
    done = format_conversations(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.zip_with("starts", "ends", lambda a, b: F.concat_ws(":", a.cast("string"), b.cast("string"))), ",")
    text = F.when(F.col("error").isNull(), F.col("text")).otherwise(F.raise_error(F.concat(F.lit("conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.lit(": "), F.col("error"))))
    return done.select("conv_id", text.alias("text"), F.size("starts").cast("bigint").alias("n_spans"), spans.alias("spans"))


QUERIES = {"op4_chat_format": op4_chat_format}
ORACLES = {
    "op4_chat_format": r"""
WITH m AS (
  SELECT conv_id, turn, role, '<|im_start|>' || coalesce(role, '') || chr(10) AS head,
         regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') || '<|im_end|>' AS body, coalesce(text, '') AS raw
  FROM conversations),
p AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, raw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + length(head) AS a
  FROM m)
SELECT conv_id, string_agg(head || body || chr(10), '' ORDER BY turn NULLS FIRST, role, raw) AS text,
       count(*) FILTER (role = 'assistant') AS n_spans,
       coalesce(string_agg(a::VARCHAR || ':' || (a + length(body))::VARCHAR, ',' ORDER BY turn NULLS FIRST, role, raw) FILTER (role = 'assistant'), '') AS spans
FROM p GROUP BY conv_id"""
}
