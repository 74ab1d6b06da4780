"""Byte-level BPE encoding and decoding with forced-boundary splitting.

A byte pair that occurs inside no token of the vocabulary can never be merged over, so
the place between its bytes is a certain cut. Each pre-token is cut at all such places,
the fragments are merged independently and their ids concatenated; the result is that
of merging the whole. Fragments are short and recur, so their ids are kept, for a
bounded number of them. One map over the corpus; the vocabulary, a file named by a
parameter and read on the driver, travels with the task.

Edge cases: null text gives null ids, count and check; empty text gives no ids; very
long texts, and fragments, are encoded whole; of pairs of equal rank the leftmost merges
first; any valid text decodes to itself; repeated rows and ids answer alike; an empty
table gives no rows; other columns are neither read nor needed.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from confab.llm.texts import text_blocks
from confab.sources.tables import table

PATTERN = r"""'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_VOCAB_BYTES = 64 << 20


@dataclass(frozen=True)
class BpeParams:
    vocab: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    pattern: str = PATTERN
    max_kept: int = 300_000  # pre-tokens, and as many fragments, whose ids a task keeps


def read_vocab(path: str) -> bytes:
    """The rank file; its size is checked, as it travels with every task."""
    if os.path.getsize(path) > MAX_VOCAB_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCAB_BYTES} bytes")
    with open(path, "rb") as f:
        return f.read()


class Bpe:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, vocab: bytes, params: BpeParams = BpeParams()):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocab.splitlines() if line.strip())}
        missing = [b for b in range(256) if bytes([b]) not in self.ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks the single bytes {missing}")
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        inside = np.zeros((256, 256), bool)
        for token, k in self.ranks.items():
            self.tokens[k] = token
            if len(token) > 1:
                raw = np.frombuffer(token, np.uint8)
                inside[raw[:-1], raw[1:]] = True
        self.never = (~inside).tolist()
        self.findall = regex.compile(params.pattern).findall
        self.max_kept = params.max_kept
        self.pieces: dict[str, bytes] = {}
        self.fragments: dict[bytes, tuple[int, ...]] = {}

    def cuts(self, raw: bytes) -> list[bytes]:
        """Fragments between certain cuts."""
        parts, start, never = [], 0, self.never
        for k in range(1, len(raw)):
            if never[raw[k - 1]][raw[k]]:
                parts.append(raw[start:k])
                start = k
        parts.append(raw[start:])
        return parts

    def merge(self, raw: bytes) -> tuple[int, ...]:
        """Plain BPE: the pair of least rank first, the leftmost of equals."""
        ranks = self.ranks
        parts = [raw[k : k + 1] for k in range(len(raw))]
        pairs = [ranks.get(parts[k] + parts[k + 1]) for k in range(len(parts) - 1)]
        while True:
            best = min((r for r in pairs if r is not None), default=None)
            if best is None:
                return tuple(ranks[p] for p in parts)
            k = pairs.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del pairs[k]
            if k < len(pairs):
                pairs[k] = ranks.get(parts[k] + parts[k + 1])
            if k:
                pairs[k - 1] = ranks.get(parts[k - 1] + parts[k])

    def merge_long(self, raw: bytes) -> tuple[int, ...]:
        """As :meth:`merge`, by a heap over a linked list, for fragments of many bytes."""
        import heapq

        ranks, n = self.ranks, len(raw)
        part = [raw[k : k + 1] for k in range(n)]
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, k, part[k] + part[k + 1]) for k in range(n - 1) if (r := ranks.get(part[k] + part[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, token = heapq.heappop(heap)
            j = after[k]
            if not live[k] or j >= n or part[k] + part[j] != token:
                continue
            part[k], live[j], after[k] = token, False, after[j]
            if after[j] < n:
                before[after[j]] = k
            for a in (before[k], k):
                if a >= 0 and after[a] < n:
                    joined = part[a] + part[after[a]]
                    r = ranks.get(joined)
                    if r is not None:
                        heapq.heappush(heap, (r, a, joined))
        return tuple(ranks[part[k]] for k in range(n) if live[k])

    def _fragment(self, raw: bytes) -> tuple[int, ...]:
        ids = self.fragments.get(raw)
        if ids is None:
            ids = self.merge(raw) if len(raw) < 128 else self.merge_long(raw)
            if len(raw) <= 64:
                if len(self.fragments) >= self.max_kept:
                    self.fragments.clear()
                self.fragments[raw] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        raw = piece.encode()
        whole = self.ranks.get(raw)
        ids = (whole,) if whole is not None else [i for part in self.cuts(raw) for i in self._fragment(part)]
        out = np.array(ids, np.int32).tobytes()
        if len(raw) <= 64:
            if len(self.pieces) >= self.max_kept:
                self.pieces.clear()
            self.pieces[piece] = out
        return out

    def encode(self, text: str) -> np.ndarray:
        """Token ids (int32) of a text."""
        get, make = self.pieces.get, self._piece
        return np.frombuffer(b"".join([get(p) or make(p) for p in self.findall(text)]), np.int32)

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """Text of token ids; bytes that are no valid text become replacement marks."""
        tokens = self.tokens
        return b"".join([tokens[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)]).decode("utf-8", "replace")


def _arrow_lists(parts: list[np.ndarray | None], kind: pa.DataType) -> pa.ListArray:
    """Lists from arrays without a Python object per item."""
    lengths = np.array([0 if p is None else len(p) for p in parts], np.int64)
    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
    some = [p for p in parts if p is not None]
    values = pa.array(np.concatenate(some) if some else np.zeros(0, np.int32), kind)
    return pa.ListArray.from_arrays(offsets, values, mask=pa.array([p is None for p in parts], pa.bool_()))


def encode(docs: DataFrame, params: BpeParams = BpeParams()) -> DataFrame:
    """(doc_id, ids, n_tokens, lossless): every text's token ids, and whether they decode to it."""
    vocab = read_vocab(params.vocab)
    kind = T.StructType([docs.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("lossless", T.BooleanType())])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(vocab, params)
        for batch in batches:
            for first, texts in text_blocks(batch.column(1)):
                ids = [None if t is None else bpe.encode(t) for t in texts]
                same = [None if i is None else bpe.decode(i) == t for i, t in zip(ids, texts)]
                counts = pa.array([None if i is None else len(i) for i in ids], pa.int64())
                columns = [batch.column(0).slice(first, len(texts)), _arrow_lists(ids, pa.int32()), counts, pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "n_tokens", "lossless"])

    return docs.select("doc_id", "text").mapInArrow(encoded, kind)


def decode(encoded: DataFrame, params: BpeParams = BpeParams()) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    vocab = read_vocab(params.vocab)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(vocab, params)
        for batch in batches:
            texts = [None if ids is None else bpe.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = T.StructType([encoded.schema["doc_id"], T.StructField("text", T.StringType())])
    return encoded.select("doc_id", "ids").mapInArrow(decoded, kind)


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


QUERIES = {"op6_bpe": op6_bpe}
ORACLES: dict[str, str] = {}
