"""Hotword rewriting: written aliases, fuzzy pinyin, matched terms, decoder assets."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

HAN = re.compile("[㐀-鿿豈-﫿]+")

#: Readings of characters, space-separated; a few for tests and demos. Callers inject a full table.
READINGS: dict[str, str] = {
    "世": "shi", "界": "jie", "银": "yin", "行": "xing hang heng", "四": "si", "航": "hang", "张": "zhang", "三": "san", "牛": "niu", "刘": "liu", "京": "jing", "今": "jin", "微": "wei", "调": "diao tiao",
    "为": "wei", "掉": "diao", "模": "mo mu", "型": "xing", "多": "duo", "态": "tai", "夺": "duo", "魔": "mo", "太": "tai", "项": "xiang", "目": "mu", "计": "ji", "划": "hua", "会": "hui kuai", "议": "yi", "贾": "jia gu", "扬": "yang", "清": "qing",
}
OLD_ALIASES: dict[str, str] = {"BERT": "bat|bate|bot", "Transformer": "chuansi|chuan si former", "A/B": "ab", "A/B Test": "ab test|a b test", "Q3": "q 3", "OKR": "o k r"}


def fuzzy_key(reading: str) -> str:
    """Reading with confusions folded: zh/z, ch/c, sh/s, n/l, and ing/in, eng/en, ang/an."""
    key = reading.strip().lower().replace("ü", "v").replace("u:", "v")
    key = re.sub(r"^([zcs])h", r"\1", key)
    key = re.sub("^n", "l", key)
    return re.sub("(i|e|a)ng$", r"\1n", key)


def fuzzy_key_column(reading: Column) -> Column:
    key = F.replace(F.replace(F.lower(F.trim(reading)), F.lit("ü"), F.lit("v")), F.lit("u:"), F.lit("v"))
    for pattern, short in ((r"^([zcs])h", "$1"), ("^n", "l"), ("(i|e|a)ng$", "$1n")):
        key = F.regexp_replace(key, pattern, short)
    return key


def aliases(word: str) -> set[str]:
    """Spellings under which a written word may be heard: joined, split at points, hyphens or capitals, spelt out."""
    found = {word}
    if word.isascii():
        joined = word.replace(" ", "")
        found.add(joined)
        for mark in ".-":
            if mark in joined:
                found |= {joined.replace(mark, ""), joined.replace(mark, " ")}
        found.add(re.sub("([A-Z])(?=[A-Z][a-z])", r"\1 ", re.sub("([a-z0-9])([A-Z])", r"\1 \2", joined)))
        bare = joined.replace(".", "")
        if len(bare) > 1 and all(c.isupper() or c.isdigit() for c in bare):
            found.add(" ".join(bare))
        found |= set(filter(None, OLD_ALIASES.get(word, "").split("|")))
    return {a.strip() for a in found if a.strip()}


EDIT = T.StructType(
    [T.StructField(n, T.IntegerType()) for n in ("position", "end")] + [T.StructField(n, T.StringType()) for n in ("original", "corrected", "method")] + [T.StructField("confidence", T.DoubleType())]
)
REWRITE = T.StructType([T.StructField("text", T.StringType()), T.StructField("corrections", T.ArrayType(EDIT))])


class HotwordRewriter:
    """Rewrites text to the spellings of a small, injected dictionary; it travels with the task."""

    def __init__(self, words: Iterable[str], fuzzy: bool = True, readings: Mapping[str, str] = READINGS):
        self.words = sorted({w.strip() for w in words if w and w.strip()})
        rules = sorted(((a, w) for w in self.words if w.isascii() for a in aliases(w)), key=lambda r: (-len(r[0]), r))
        self.rules = [(re.compile(r"(?<![0-9A-Za-z])" + r"\s+".join(map(re.escape, a.split())) + r"(?![0-9A-Za-z])", re.I), w) for a, w in rules]
        self.readings = {c: frozenset(map(fuzzy_key, r.split())) for c, r in readings.items()} if fuzzy else {}
        spoken = [(w, [self.readings.get(c, frozenset()) for c in w]) for w in self.words if len(w) > 1 and HAN.fullmatch(w)]
        self.spoken = sorted(((w, r) for w, r in spoken if all(r)), key=lambda s: (-len(s[0]), s[0]))

    def __call__(self, text: str) -> tuple[str, list[dict]]:
        edits: list[dict] = []
        note = lambda a, b, old, new, how, sure: edits.append({"position": a, "end": b, "original": old, "corrected": new, "method": how, "confidence": sure})
        for pattern, word in self.rules:

            def one(m: re.Match, word: str = word) -> str:
                if m.group() != word:
                    note(m.start(), m.end(), m.group(), word, "canonical_alias", 0.95)
                return word

            text = pattern.sub(one, text)
        if not self.spoken or self.readings.keys().isdisjoint(text):
            return text, edits
        heard = [self.readings.get(c, frozenset()) for c in text]
        out, at = [], 0
        while at < len(text):
            for word, sounds in self.spoken:
                part = text[at : at + len(word)]
                if part != word and len(part) == len(word) and all(a & b for a, b in zip(heard[at:], sounds)):
                    note(at, at + len(word), part, word, "fuzzy_pinyin", 0.9)
                    out.append(word)
                    at += len(word)
                    break
            else:
                out.append(text[at])
                at += 1
        return "".join(out), edits

    def rewrite(self, text: Column) -> Column:
        """struct(text, corrections)."""

        @pandas_udf(REWRITE)
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame([self(t) if isinstance(t, str) else (None, None) for t in batch], columns=REWRITE.names)

        return run(text)

    def matched_terms(self, text: Column) -> Column:
        """Words of the dictionary that the text holds in any case, the longest first."""
        ordered = sorted(self.words, key=lambda w: (-len(w), w))
        low = F.lower(text)
        return F.filter(F.array(*map(F.lit, ordered)), lambda w: F.contains(low, F.lower(w))) if ordered else F.array().cast("array<string>")


HEARD = {"bat": "BERT BAT", "bate": "BERT", "bot": "BERT", "chuansi": "Transformer", "ab": "A/B", "ab测试": "A/B测试", "weidiao": "微调", "duomotai": "多模态", "zhuanhualv": "转化率", "okr": "OKR", "q3": "Q3"}


def token_corrections(text: Column, words: list[str]) -> Column:
    """Array of struct(position, original, corrected, confidence): tokens that a fixed map hears as a hotword."""
    chosen = {h: next((c for c in cs.split() if c in words), None) for h, cs in HEARD.items()}
    table = F.create_map(*[F.lit(x) for h, c in chosen.items() if c for x in (h, c)]) if any(chosen.values()) else F.create_map().cast("map<string,string>")
    tokens = F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")
    found = F.transform(tokens, lambda t, i: F.struct(i.alias("position"), t.alias("original"), F.try_element_at(table, F.regexp_replace(t, r"[^\w一-鿿/]", "")).alias("corrected"), F.lit(0.85).alias("confidence")))
    return F.filter(found, lambda c: c["corrected"].isNotNull())


def context_correction(context: str, candidates: list[str]) -> str | None:
    """Candidate that the words around it suggest; the first otherwise."""
    if not candidates:
        return None
    if "用户" in context:
        for hint, answer in (("全量", "全量用户"), ("新增", "新增用户")):
            if hint in candidates:
                return answer
    if "训练" in context and "模型" in context:
        for name in ("BERT", "Transformer"):
            if name in candidates:
                return name
    return candidates[0]


# Decoder assets
SCORED = re.compile(r"\s:([0-9]+(?:[.][0-9]+)?)\s*$")


def _is_han(c: str) -> bool:
    return bool(HAN.fullmatch(c))


def spaced(word: str) -> str:
    return " ".join("".join(f" {c} " if _is_han(c) else c for c in word).split())


def boosted(word: str, score: float, explicit: bool = False) -> str:
    """``word :score``; ASCII words are held to 2.5 unless scored by hand, and a score already there stays."""
    m = SCORED.search(word)
    if m:
        return f"{spaced(word[: m.start()])} :{m.group(1)}"
    used = score if explicit or any(map(_is_han, word)) else min(score, 2.5)
    return f"{spaced(word)} :{used:.3f}".rstrip("0").rstrip(".")


def decoder_lines(word: str, score: float, explicit: bool = False) -> list[str]:
    """A line a spelling: ASCII words also with a capital."""
    if SCORED.search(word) or any(map(_is_han, word)):
        return [boosted(word, score, explicit)]
    return [boosted(w, score, explicit) for w in dict.fromkeys((word, word[:1].upper() + word[1:]))]


def decoder_vocabulary(tokens: str) -> list[str]:
    """``piece<TAB>-index`` lines, with the bare marker and bare Han pieces that are missing."""
    rows, pieces, bare = [], set(), set()
    for line in tokens.splitlines():
        piece, _, index = line.rpartition(" ")
        if piece and re.fullmatch(r"-?\d+", index):
            rows.append(f"{piece}\t{-int(index)}")
            pieces.add(piece)
            if len(piece) == 2 and piece[0] == "▁" and _is_han(piece[1]):
                bare.add(piece[1])
    if "▁" not in pieces:
        rows.append("▁\t-1")
    return rows + [f"{c}\t-999999" for c in sorted(bare - pieces)]


def lines_column(word: Column, score: Column, explicit: Column) -> Column:
    @pandas_udf(T.ArrayType(T.StringType()))
    def run(words: pd.Series, scores: pd.Series, flags: pd.Series) -> pd.Series:
        return pd.Series([decoder_lines(w, float(s), bool(e)) if isinstance(w, str) and w.strip() else [] for w, s, e in zip(words, scores, flags)], dtype=object)

    return run(word, score, explicit)


Rewriter = Callable[[str], tuple[str, list[dict]]]
