"""Secret scans: a linear-chain conditional random field over tokens.

White-space tokens are tagged as secret begin, inside or outside. Emissions sum hashed
weights of the token's shape and content, of its two neighbours on either side and of
the file as a whole; transitions complete the chain; Viterbi decodes it. The chain is
trained in numpy by forward-backward on a bounded sample of passages whose own known
formats are labelled, plus passages with generated secrets of many formats and with
look-alikes (mail and network addresses, card and phone numbers, versions, dates). The
sample is of documents; each of them trains as a whole, cut into consecutive passages.

A token's weights depend on the token alone, so they are computed once per distinct
token and kept; a token has as many features as it shows, with no bound. Where no token
of a text can gain by leaving "outside", even under the most favourable transitions, the
all-outside path is optimal and Viterbi is not run: that bound is exact. Whole texts are
scanned in one map, without a shuffle.

Edge cases: null and empty texts hold no secret; white space alone likewise; very long
texts are scanned whole; of equally good labellings that with the lower labels (begin,
inside, outside), decided from the last token back, is taken; repeated rows answer alike;
a null id is reported with its spans; without documents only generated passages train;
an empty table gives no rows; other columns are neither read nor changed.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from confab.llm.texts import blocks, bounded_sample, text_blocks
from confab.sources.tables import table

BEGIN, INSIDE, OUTSIDE = 0, 1, 2
MASK = "<SECRET>"
TOKEN = re.compile(r"\S+")
TRIM = "\"'`,;:!?()[]{}<>#$%&*|."
OFFSETS = (-2, -1, 0, 1, 2)
KNOWN = re.compile(
    r"(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|xox[abpr]-[A-Za-z0-9-]{10,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|sk-[A-Za-z0-9_-]{20,}"
    r"|AIza[A-Za-z0-9_-]{30,}|glpat-[A-Za-z0-9_-]{16,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})"
    r"|(?i:\b(?:token|secret|password|passwd|pwd|api[_-]?key|apikey|access[_-]?key|auth|credential|bearer|private[_-]?key)\w*[\"']?\s*(?:[:=]>?|\s)\s*[\"']?)"
    r"(?P<value>(?=[A-Za-z0-9_/+.=!@#$%^&*-]*\d)[A-Za-z0-9_/+.=@-]{12,})"
)


@dataclass(frozen=True)
class SecretParams:
    """``sample_rows`` bounds the documents that train the chain, all of their passages."""

    sample_rows: int = 1200
    generated: int = 2400  # passages with generated secrets or look-alikes
    buckets: int = 1 << 14
    length: int = 40  # tokens of a training passage
    epochs: int = 12
    rate: float = 0.2
    decay: float = 1e-5
    certain: float = 1e-3  # error of the probabilities up to which a training passage may wait
    seed: int = 11


@dataclass
class SecretModel:
    params: SecretParams
    own: np.ndarray  # buckets x offsets x labels
    file: np.ndarray  # buckets x labels
    trans: np.ndarray  # labels x labels


def shape(token: str) -> str:
    s = re.sub(r"[a-zà-öø-ÿ]+", "a", re.sub(r"[A-ZÀ-ÖØ-Þ]+", "A", re.sub(r"\d+", "9", token)))
    return re.sub(r"(?:a9|9a|A9|9A){2,}[aA9]?", "~", s)[:12]


def traits(token: str) -> list[str]:
    """Features of a token, seen by itself and by its neighbours."""
    core = token.strip(TRIM)
    n = len(core)
    lower = core.lower()
    if core and core.isalpha() and (core.islower() or core.istitle() or core.isupper()):
        return ["w=" + lower if n <= 14 else "w+", "alpha", f"n{min(n.bit_length(), 6)}"]
    digits = sum(c.isdigit() for c in core)
    letters = sum(c.isalpha() for c in core)
    found = [f"s={shape(core)}", f"n{min(n.bit_length(), 7)}", f"l{min(n // 6, 8)}"]
    if digits and letters:
        found.append(f"mixed{min(n // 8, 5)}")
    if n >= 16 and all(c in string.hexdigits for c in core):
        found += ["hex", f"hex{n // 8}"]
    if n >= 16 and re.fullmatch(r"[A-Za-z0-9+/=_-]+", core):
        found.append("b64")
    if n:
        counts = Counter(core)
        entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
        found.append(f"e{int(entropy * 2)}")
        found.append(f"d{int(10 * digits / n)}")
        found.append(f"e{int(entropy)}n{min(n // 8, 5)}")
    for mark in "@=:/-_.":
        if mark in core:
            found.append("has" + mark)
    if token[:1] in "\"'`":
        found.append("quoted")
    found.append("p=" + lower[:3])
    found.append("p=" + core[:4])
    for part in re.split(r"[=:]", lower)[:-1]:
        found.append("key=" + part.strip(TRIM + "_-")[-12:])
    if not core:
        found.append("t=" + token[:3])
    elif n <= 14 and digits == 0:
        found.append("w=" + lower)
    return found


def code_like(token: str) -> bool:
    return token[-1:] in "{};=" or token[:1] in "\"'"


def file_traits(n: int, code: int) -> list[str]:
    """Features of a whole text of ``n`` tokens, ``code`` of them code-like."""
    return [f"file-size{min(max(1, n).bit_length(), 16)}", f"file-code{min(code * 20 // max(1, n), 6)}", "bias"]


def _rows(parts: list[str], buckets: int) -> list[int]:
    return [xxhash.xxh32_intdigest(p) % buckets for p in parts]


def feature_rows(tokens: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all tokens, one after the other, and where each token's begin.

    Equal to hashing :func:`traits`, whose first case, by far the most common, is taken apart here.
    """
    digest, flat, starts = xxhash.xxh32_intdigest, [], []
    alpha, sizes = _rows(["alpha"], buckets)[0], _rows([f"n{k}" for k in range(7)], buckets)
    long = _rows(["w+"], buckets)[0]
    for token in tokens:
        starts.append(len(flat))
        core = token.strip(TRIM)
        if core.isalpha() and (core.islower() or core.istitle() or core.isupper()):
            n = len(core)
            flat += (digest("w=" + core.lower()) % buckets if n <= 14 else long, alpha, sizes[min(n.bit_length(), 6)])
        else:
            flat += _rows(traits(token), buckets)
    return np.array(flat, np.int64), np.array(starts, np.int64)


def _make_secret(rng: random.Random) -> list[str]:
    """Tokens of a generated secret in its context; labels follow from the marks in them."""
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    alnum, hexes = string.ascii_letters + string.digits, "0123456789abcdef"
    value = rng.choice([
        lambda: pick(hexes, rng.choice([32, 40, 40, 48, 64])), lambda: pick(hexes, 40).upper(), lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16),
        lambda: "ghp_" + pick(alnum, 36), lambda: "sk_live_" + pick(alnum, 24), lambda: "sk-" + pick(alnum, 48), lambda: "AIza" + pick(alnum + "_-", 35),
        lambda: "xoxb-" + pick(string.digits, 11) + "-" + pick(alnum, 24), lambda: "eyJ" + pick(alnum, 20) + ".eyJ" + pick(alnum, 40) + "." + pick(alnum + "_-", 43),
        lambda: pick(alnum + "+/", 40), lambda: pick(alnum, rng.randint(20, 40)), lambda: "glpat-" + pick(alnum, 20), lambda: pick(alnum + "!@#$%", rng.randint(12, 20)) + "7x",
    ])()
    key = rng.choice(["token", "secret", "password", "api_key", "apiKey", "access_token", "client_secret", "auth", "API_KEY", "SECRET_KEY", "aws_secret_access_key", "passwd", "private_key", "TOKEN"])
    quote = rng.choice(['"', '"', "'", ""])
    form = rng.randrange(7)
    if form <= 2:
        return [key, "=", f"\0{quote}{value}{quote}"]
    if form == 3:
        return [f"{key}:", f"\0{quote}{value}{quote}"]
    if form == 4:
        return [f"\0{key}={quote}{value}{quote}"]
    if form == 5:
        return ["Authorization:", "Bearer", "\0" + value]
    if rng.random() < 0.5:
        return ["\0-----BEGIN", "\1RSA", "\1PRIVATE", "\1KEY-----", *("\1" + pick(alnum + "+/", rng.choice([32, 64])) for _ in range(rng.randint(2, 6))), "\1-----END", "\1RSA", "\1PRIVATE", "\1KEY-----"]
    return ["\0" + value]


def _make_decoy(rng: random.Random) -> list[str]:
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    d, low = string.digits, string.ascii_lowercase
    return rng.choice([
        lambda: [".".join(str(rng.randint(0, 255)) for _ in range(4))], lambda: [pick(d, 16)], lambda: ["+1", f"({pick(d, 3)})", f"{pick(d, 3)}-{pick(d, 4)}"],
        lambda: [f"{pick(low, 4)}.{pick(d, 2)}@{pick(low, 5)}{pick(d, 1)}.example.com"], lambda: ["version", f"{pick(d, 1)}.{pick(d, 1)}."], lambda: [f"{rng.randint(1990, 2030)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}"],
        lambda: [f"https://{pick(low, 8)}.com/{pick(low, 5)}/{pick(d, 4)}"], lambda: ["id", "=", pick(d, rng.randint(3, 10))], lambda: ["token", "=", "none"], lambda: ["the", "token", "is", "here"],
        lambda: ["password", "must", "be", "changed"], lambda: [pick(low, 6) + pick(d, 2)], lambda: ["=", '"' + pick(low, 8) + '"'], lambda: [pick(string.ascii_uppercase, 6) + "!!", pick(d, 16) + "!!"],
        lambda: ["name", "=", '"' + pick(low, 6) + '"'], lambda: [pick(low, 5) + rng.choice(["%%%", "###", "$$$", "&&&", "***"])], lambda: ["|", pick(low, 6), "|"], lambda: [f"v{pick(d, 1)}.{pick(d, 2)}.{pick(d, 1)}", f"{pick(d, 4)}x{pick(d, 4)}"],
    ])()


def known_labels(text: str) -> tuple[list[str], list[int]]:
    """Tokens of a text and labels by its known formats alone."""
    spans = [m.span("value") if m.group("value") else m.span() for m in KNOWN.finditer(text)]
    tokens, labels, k = [], [], 0
    for m in TOKEN.finditer(text):
        while k < len(spans) and spans[k][1] <= m.start():
            k += 1
        tokens.append(m.group())
        labels.append(BEGIN if k < len(spans) and spans[k][0] < m.end() and spans[k][0] >= m.start() else INSIDE if k < len(spans) and spans[k][0] < m.start() < spans[k][1] else OUTSIDE)
    return tokens, labels


Passage = tuple[list[str], list[int], list[str]]  # tokens with two of context on either side, labels of the others, features of the file


def training_passages(texts: list[str], params: SecretParams) -> list[Passage]:
    """All passages of all texts, and generated ones; "" is context that isn't there."""
    rng = random.Random(params.seed)
    found, clean = [], []
    for text in texts:
        tokens, labels = known_labels(text)
        doc = file_traits(len(tokens), sum(map(code_like, tokens)))
        wide = ["", "", *tokens, "", ""]
        for a in range(0, len(tokens), params.length):
            part = wide[a : a + params.length + 4], labels[a : a + params.length], doc
            found.append(part)
            if all(y == OUTSIDE for y in part[1]):
                clean.append(part)
    clean = clean or [(["", "", *"the words around it are plain".split(), "", ""], [OUTSIDE] * 6, ["bias"])]
    noise = ["", "", "", "", "!!", "%%%", "###", "$$$", "&&&", "***"]
    for _ in range(params.generated):
        tokens, labels, doc = rng.choice(clean)
        tail = rng.choice(noise)
        extra = _make_secret(rng) if rng.random() < 0.5 else _make_decoy(rng)
        ys = [BEGIN if t[:1] == "\0" else INSIDE if t[:1] == "\1" else OUTSIDE for t in extra]
        extra = [t.strip("\0\1") + tail for t in extra]
        if tail == "!!":
            extra = [t.upper() for t in extra]
        at = rng.randint(0, len(labels))
        found.append((tokens[: at + 2] + extra + tokens[at + 2 :], labels[:at] + ys + labels[at:], doc))
    return found


def train(texts: list[str], params: SecretParams = SecretParams()) -> SecretModel:
    """Maximise the conditional likelihood by Adagrad; batches of padded passages.

    A step reads and changes the rows of its own features only. Passages whose labels were
    all but certain when last seen (every probability right to ``certain``) have next to no
    gradient and wait for the next epoch that takes them all, one in three.
    """
    data = training_passages(texts, params)
    rng = np.random.default_rng(params.seed)
    w_own = np.zeros((params.buckets, len(OFFSETS) * 3), np.float32)
    w_file = np.zeros((params.buckets, 3), np.float32)
    trans = np.zeros((3, 3), np.float32)
    trans[OUTSIDE, INSIDE] = -4
    number: dict[str, int] = {"": 0}
    files: dict[tuple[str, ...], int] = {}
    coded = [(np.array([number.setdefault(t, len(number)) for t in tokens]), np.array(labels), files.setdefault(tuple(doc), len(files))) for tokens, labels, doc in data]
    of_file = [_rows(list(f), params.buckets) for f in files]
    held = np.unique(np.concatenate(of_file))
    in_file = np.stack([np.bincount(np.searchsorted(held, f), minlength=len(held)) for f in of_file]).astype(np.float32)
    flat, starts = feature_rows(list(number)[1:], params.buckets)  # token 0 has no features
    ends = np.append(starts[1:], len(flat))
    s_own, s_file, s_trans = (np.full_like(w, 1e-3) for w in (w_own, w_file, trans))

    def step(w: np.ndarray, s: np.ndarray, rows, g: np.ndarray) -> None:
        g = g + params.decay * w[rows]
        s[rows] += g * g
        w[rows] -= params.rate * g / np.sqrt(s[rows])

    waits = np.zeros(len(coded), bool)
    for epoch in range(params.epochs):
        order = rng.permutation(len(coded) if epoch % 3 == 0 else np.flatnonzero(~waits))
        for at in range(0, len(order), 64):
            some = [coded[k] for k in order[at : at + 64]]
            n, size = len(some), max(len(c[1]) for c in some)
            file = np.array([c[2] for c in some])
            ids = np.zeros((n, size + 4), np.int64)
            gold = np.full((n, size), OUTSIDE)
            mask = np.zeros((n, size), bool)
            for i, (t, y, _) in enumerate(some):
                ids[i, : len(t)] = t
                gold[i, : len(y)] = y
                mask[i, : len(y)] = True
            uniq, where = np.unique(ids, return_inverse=True)
            where = where.reshape(ids.shape)
            real = uniq[uniq > 0] - 1
            count = ends[real] - starts[real]
            first = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64)
            rows = flat[np.repeat(starts[real] - first, count) + np.arange(count.sum())]
            touched, back = np.unique(rows, return_inverse=True)
            of_token = np.zeros((len(uniq), len(OFFSETS), 3), np.float32)
            if len(real):
                of_token[len(uniq) - len(real) :] = np.add.reduceat(w_own[rows], first, axis=0).reshape(-1, len(OFFSETS), 3)
            emit = sum(of_token[where[:, o : o + size], o] for o in range(len(OFFSETS)))
            emit += (in_file[file] @ w_file[held])[:, None]
            p_node, p_edge = _marginals(emit, trans, mask)
            err = p_node.copy()
            err[np.arange(n)[:, None], np.arange(size), gold] -= 1
            err *= mask[..., None]
            waits[order[at : at + 64]] = np.abs(err).max((1, 2)) < params.certain
            err = err.reshape(-1, 3) / n
            g_token = np.stack([np.bincount(where[:, o : o + size].ravel(), err[:, y], len(uniq)) for o in range(len(OFFSETS)) for y in range(3)], 1)[len(uniq) - len(real) :]
            if len(touched):
                by_row = np.argsort(back, kind="stable")
                cut = np.searchsorted(back[by_row], np.arange(len(touched)))
                step(w_own, s_own, touched, np.add.reduceat(np.repeat(g_token.astype(np.float32), count, 0)[by_row], cut, axis=0))
            in_use = in_file[file].any(0)
            step(w_file, s_file, held[in_use], (in_file[file].T @ err.reshape(n, size, 3).sum(1))[in_use].astype(np.float32))
            g_trans = p_edge.copy()
            both = mask[:, 1:]
            np.add.at(g_trans, (gold[:, :-1][both], gold[:, 1:][both]), -1)
            step(trans, s_trans, slice(None), g_trans / n)
    return SecretModel(params, np.ascontiguousarray(w_own.reshape(-1, len(OFFSETS), 3)), w_file, trans)


def _marginals(emit: np.ndarray, trans: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label marginals of padded chains and the expected transition counts; scaled at each step."""
    n, size, _ = emit.shape
    own = np.exp((emit - emit.max(2, keepdims=True)).astype(float))
    move = np.exp(trans.astype(float) - trans.max())
    a, b = np.empty((n, size, 3)), np.ones((n, size, 3))
    a[:, 0] = own[:, 0]
    for t in range(1, size):
        x = (a[:, t - 1] @ move) * own[:, t]
        a[:, t] = x / x.sum(1, keepdims=True)
    for t in range(size - 2, -1, -1):
        x = (own[:, t + 1] * b[:, t + 1]) @ move.T
        b[:, t] = np.where(mask[:, t + 1, None], x / x.sum(1, keepdims=True), 1)
    node = a * b
    node /= node.sum(2, keepdims=True)
    edge = a[:, :-1, :, None] * move * (own[:, 1:] * b[:, 1:])[:, :, None, :]
    edge /= edge.sum((2, 3), keepdims=True)
    return node, (edge * mask[:, 1:, None, None]).sum((0, 1))


def viterbi(emit: np.ndarray, trans: np.ndarray) -> list[int]:
    """Best labels of one chain; ties keep the lower label number of the predecessor."""
    rows, (tr0, tr1, tr2) = emit.tolist(), trans.T.tolist()
    a, b, c = rows[0]
    back = []
    for e in rows[1:]:
        best, new = [], []
        for t, own in zip((tr0, tr1, tr2), e):
            x, y, z = a + t[0], b + t[1], c + t[2]
            k = 0 if x >= y and x >= z else 1 if y >= z else 2
            best.append(k)
            new.append((x, y, z)[k] + own)
        back.append(best)
        a, b, c = new
    last = (a, b, c).index(max(a, b, c))
    path = [last]
    for best in reversed(back):
        path.append(best[path[-1]])
    return path[::-1]


class Tagger:
    """Finds secrets; weights of tokens already met are kept, for a bounded number of tokens."""

    def __init__(self, model: SecretModel, max_tokens: int = 150_000):
        self.m, self.max_tokens = model, max_tokens
        self.known: dict[str, int] = {}
        self.weights = np.zeros((max_tokens + 1, len(OFFSETS), 3), np.float32)  # row 0 is padding
        self.code = np.zeros(max_tokens + 1, bool)
        self.files: dict[tuple[str, ...], np.ndarray] = {}
        rise = model.trans - model.trans[OUTSIDE, OUTSIDE]
        self.slack = max(0.0, float(rise[:, :OUTSIDE].max())) + max(0.0, float(rise[:OUTSIDE, OUTSIDE].max()))

    def _ids(self, tokens: list[str]) -> np.ndarray:
        known = self.known
        fresh = list(dict.fromkeys(t for t in tokens if t not in known))
        if len(known) + len(fresh) > self.max_tokens:
            known.clear()
            fresh = list(dict.fromkeys(tokens))
            if len(fresh) > self.max_tokens:
                self.max_tokens = len(fresh)
                self.weights = np.zeros((self.max_tokens + 1, len(OFFSETS), 3), np.float32)
                self.code = np.zeros(self.max_tokens + 1, bool)
        if fresh:
            base = len(known) + 1
            known.update(zip(fresh, range(base, base + len(fresh))))
            flat, starts = feature_rows(fresh, self.m.params.buckets)
            self.weights[base : base + len(fresh)] = np.add.reduceat(self.m.own[flat], starts, axis=0)
            self.code[base : base + len(fresh)] = [code_like(t) for t in fresh]
        return np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))

    def _file(self, n: int, code: int) -> np.ndarray:
        own = tuple(file_traits(n, code))
        if own not in self.files:
            self.files[own] = self.m.file[_rows(list(own), self.m.params.buckets)].sum(0)
        return self.files[own]

    def emissions(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Emissions of all tokens, each text followed by two rows of padding, and the starts of the texts."""
        lengths = np.array([len(d) for d in docs])
        ids = self._ids([t for d in docs for t in d])
        starts = np.concatenate([[0], np.cumsum(lengths + 2)[:-1]])
        flat = np.zeros(int(lengths.sum()) + 2 * len(docs), np.int64)
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        flat[np.repeat(starts - first, lengths) + np.arange(len(ids))] = ids
        emit = np.zeros((len(flat), 3), np.float32)
        for o, off in enumerate(OFFSETS):
            w = self.weights[:, o][flat]
            if off < 0:
                emit[-off:] += w[:off]
            elif off > 0:
                emit[:-off] += w[off:]
            else:
                emit += w
        code = np.add.reduceat(self.code[flat].astype(np.int64), starts)  # padding is no code
        files = np.array([self._file(n, c) for n, c in zip(lengths.tolist(), code.tolist())], np.float32).reshape(-1, 3)
        emit += np.repeat(files, lengths + 2, 0)
        return emit, starts

    def labels(self, docs: list[list[str]]) -> list[list[int] | None]:
        """Labels of each text; None where all are outside."""
        if not any(docs):
            return [None] * len(docs)
        emit, starts = self.emissions(docs)
        may = np.flatnonzero(emit[:, :OUTSIDE].max(1) - emit[:, OUTSIDE] + self.slack > 0)
        found: list[list[int] | None] = [None] * len(docs)
        for k in np.unique(np.searchsorted(starts, may, side="right") - 1):
            if not docs[k]:
                continue
            path = viterbi(emit[starts[k] : starts[k] + len(docs[k])], self.m.trans)
            if any(y != OUTSIDE for y in path):
                found[k] = path
        return found

    def spans(self, texts: list[str | None]) -> list[list[tuple[int, int]]]:
        """Character spans of the secrets of each text, quotes and other trimming left out."""
        found: list[list[tuple[int, int]]] = []
        for a, b in blocks(texts):
            docs = [t.split() if t else [] for t in texts[a:b]]
            for text, labels in zip(texts[a:b], self.labels(docs)):
                found.append(_to_spans(text, labels) if labels else [])
        return found


def _to_spans(text: str, labels: list[int]) -> list[tuple[int, int]]:
    found: list[list[int]] = []
    for m, y in zip(TOKEN.finditer(text), labels):
        if y == BEGIN or (y == INSIDE and not found):
            found.append([m.start(), m.end(), m.end()])
        elif y == INSIDE:
            if TOKEN.search(text[found[-1][2] : m.start()]):
                found.append([m.start(), m.end(), m.end()])
            found[-1][1:] = [m.end(), m.end()]
    spans = []
    for a, b, _ in found:
        raw = text[a:b]
        left = len(raw) - len(raw.lstrip(TRIM))
        right = len(raw.rstrip(TRIM))
        if right > left:
            key = re.match(r"[A-Za-z_-]{2,24}\s*[=:]\s*[\"']?(?=.{8})", raw[left:right])
            spans.append((a + left + (key.end() if key else 0), a + right))
    return spans


def redact(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    for a, b in sorted(spans, reverse=True):
        text = text[:a] + MASK + text[b:]
    return text


def fit(docs: DataFrame, params: SecretParams = SecretParams()) -> SecretModel:
    """Train on passages of a bounded sample of documents and on generated ones."""
    own = docs.select(F.col("text").alias("_text")).where("_text is not null")
    rows = bounded_sample(own.withColumn("_key", F.xxhash64("_text")), "_key", params.sample_rows).select("_text").toPandas()
    return train(sorted(rows["_text"]), params)


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def span_column(model: SecretModel, text: str = "text") -> Column:
    """Array of the secrets' character spans (0-based, end exclusive)."""

    @arrow_udf(SPAN)
    def secret_spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tagger = Tagger(model)
        for batch in batches:
            spans = [s for _, texts in text_blocks(batch) for s in tagger.spans(texts)]
            yield pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))

    return secret_spans(F.col(text))


def redact_column(model: SecretModel, text: str = "text") -> Column:
    """The text with every secret replaced by a mark; null stays null."""

    @arrow_udf("string")
    def redacted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tagger = Tagger(model)
        for batch in batches:
            yield from masked_parts(batch, tagger)

    return redacted(F.col(text))


def masked_parts(batch: pa.Array, tagger: Tagger) -> Iterator[pa.Array]:
    """The masked texts of a batch, about 1 MB at a time, lest a worker hold them all beside those it got."""
    for _, texts in text_blocks(batch):
        yield pa.array([redact(t, s) for t, s in zip(texts, tagger.spans(texts))], batch.type)
    if not len(batch):
        yield batch


def scan(docs: DataFrame, model: SecretModel) -> DataFrame:
    """(doc_id, start, end): one row a secret."""
    found = docs.select("doc_id", F.explode(span_column(model)).alias("span"))
    return found.select("doc_id", F.col("span.start").alias("start"), F.col("span.end").alias("end"))


def mask_secrets(docs: DataFrame, model: SecretModel) -> DataFrame:
    """The documents with secrets masked in ``text``; ``n_chars`` follows where there is one."""
    masked = docs.withColumn("text", redact_column(model))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(docs.columns)


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, fit(docs))


QUERIES = {"op9_secret_scan": op9_secret_scan}
ORACLES: dict[str, str] = {}
