import base64
import random

import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from confab.llm import bpe as X
from tests.llm import messy

PARAMS = X.BpeParams()
BPE = X.Bpe(X.read_vocab(PARAMS.vocab))
OTHER = tiktoken.Encoding("own", pat_str=X.PATTERN, mergeable_ranks=BPE.ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_equals_plain_merging_and_round_trips(text):
    ids = BPE.encode(text)
    assert ids.tolist() == OTHER.encode_ordinary(text)
    assert BPE.decode(ids) == text


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=200))
def test_cuts_change_nothing(raw):
    assert b"".join(BPE.cuts(raw)) == raw
    whole = BPE.merge(raw)
    assert tuple(i for part in BPE.cuts(raw) for i in BPE.merge(part)) == whole == BPE.merge_long(raw)


def test_cuts_are_pairs_inside_no_token():
    inside = {t[k : k + 2] for t in BPE.ranks for k in range(len(t) - 1)}
    rng = random.Random(0)
    for _ in range(2000):
        pair = bytes([rng.randrange(256), rng.randrange(256)])
        assert (len(BPE.cuts(pair)) == 2) == (pair not in inside)


def test_bounded_memory_changes_nothing():
    rng = random.Random(1)
    text = " ".join(messy.words(rng, 3000))
    small = X.Bpe(X.read_vocab(PARAMS.vocab), X.BpeParams(max_kept=10))
    assert small.encode(text).tolist() == BPE.encode(text).tolist()
    assert len(small.pieces) <= 10 and len(small.fragments) <= 10
    long = "z" * 5000 + "漢" * 2000
    assert small.decode(small.encode(long)) == long


def test_vocabulary_must_hold_all_bytes():
    try:
        X.Bpe(base64.b64encode(b"a") + b" 0\n")
    except ValueError:
        return
    raise AssertionError


def test_messy_rows(spark):
    docs = messy.docs(spark)
    rows = X.encode(docs).collect()
    assert len(rows) == docs.count()
    assert sorted((str(r["doc_id"]), r["n_tokens"] is None) for r in rows) == sorted((str(r[0]), r[1] is None) for r in messy.rows())
    assert all((r["ids"] is None) == (r["n_tokens"] is None) == (r["lossless"] is None) for r in rows)
    assert all(r["lossless"] and r["n_tokens"] == len(r["ids"]) for r in rows if r["ids"] is not None)
    back = X.decode(X.encode(docs)).collect()
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in back))) == sorted(map(str, ((r[0], r[1]) for r in messy.rows())))
    assert X.encode(messy.empty(spark)).count() == 0
