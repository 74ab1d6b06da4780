"""Every stage, and the whole, against plain loops over the same documents."""

import numpy as np
import pytest
import tiktoken

import corpus_pipeline as P
from confab.llm import bpe, decontaminate, secrets, simhash, toxicity
from confab.sources.tables import table
from tests.llm import messy
from tests.llm.test_simhash import brute_groups


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Rows of documents and of each stage's result, each stage fed with what the one before wrote."""
    path = tmp_path_factory.mktemp("stages")
    docs = table(spark, sf, "documents")
    out = [docs.collect()]
    for k, (_, stage) in enumerate(P.STAGES):
        done = stage(spark, docs, sf)
        if k < len(P.STAGES) - 1:
            assert done.columns == docs.columns and done.dtypes == docs.dtypes
        done.write.parquet(str(path / str(k)))
        docs = spark.read.parquet(str(path / str(k)))
        out.append(docs.collect())
    return out


def ids(rows):
    return sorted(r["doc_id"] for r in rows)


def test_toxic_documents_go(spark, sf, stages):
    model = toxicity.fit(table(spark, sf, "documents"), table(spark, sf, "labels"))
    limit = lambda lang: model.thresholds.get(lang, model.thresholds[None])
    kept = [r for r in stages[0] if toxicity.score([r["text"]], model)[0] < limit(r["lang"])]
    assert ids(kept) == ids(stages[1]) and len(kept) < len(stages[0])


def test_one_of_each_group_stays(stages):
    prints = {r["doc_id"]: h for r in stages[1] if (h := simhash.fingerprint(r["text"]))}
    gone = {i for i, root in brute_groups(prints, simhash.SimHashParams().radius).items() if i != root}
    assert ids(stages[2]) == sorted(set(ids(stages[1])) - gone) and gone


def test_leaks_go(spark, sf, stages):
    params = decontaminate.AlignParams()
    items = [decontaminate.words_of(r["text"]) for r in table(spark, sf, "benchmark").collect()]
    kept = []
    for r in stages[2]:
        words = decontaminate.words_of(r["text"])
        number = {w: k for k, w in enumerate(dict.fromkeys(words))}
        text = np.array([number[w] for w in words], int)
        leaks = False
        for item in items:
            if item and len(set(item) & set(number)) * 2 >= len(set(item)) * params.threshold:
                seq = np.array([number.get(w, -1 - k) for k, w in enumerate(item)])
                leaks |= decontaminate.align(seq, text, params) >= params.threshold * params.match * len(item)
        if not leaks:
            kept.append(r)
    assert ids(kept) == ids(stages[3])


def test_secrets_are_masked(spark, sf, stages):
    docs = spark.createDataFrame(stages[3], table(spark, sf, "documents").schema)
    model = secrets.fit(docs)
    want = {}
    for r in stages[3]:
        tokens = (r["text"] or "").split()
        emit, _ = secrets.Tagger(model).emissions([tokens]) if tokens else (np.zeros((0, 3)), None)
        spans = secrets._to_spans(r["text"], secrets.viterbi(emit[: len(tokens)], model.trans)) if tokens else []
        want[r["doc_id"]] = secrets.redact(r["text"], spans)
    assert {r["doc_id"]: r["text"] for r in stages[4]} == want
    assert all(r["n_chars"] == len(r["text"]) for r in stages[4])


def test_tokens_are_those_of_plain_merging(stages):
    ranks = bpe.Bpe(bpe.read_vocab(bpe.BpeParams().vocab)).ranks
    plain = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {r["doc_id"]: plain.encode_ordinary(r["text"]) for r in stages[4]}
    assert {r["doc_id"]: r["ids"] for r in stages[5]} == want and all(r["lossless"] for r in stages[5])


def test_run_equals_the_stages(spark, sf, stages):
    assert sorted((r["doc_id"], r["ids"]) for r in P.run(spark, sf).collect()) == sorted((r["doc_id"], r["ids"]) for r in stages[5])


def test_stages_take_messy_documents(spark, sf):
    docs = messy.docs(spark)
    for _, stage in P.STAGES[:-1]:
        done = stage(spark, docs, sf)
        assert done.columns == docs.columns and 0 < done.count() <= docs.count()
        assert stage(spark, messy.empty(spark), sf).count() == 0
    assert P.STAGES[-1][1](spark, docs, sf).count() == docs.count()
