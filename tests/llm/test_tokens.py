"""Encoding against two independent encoders, packing against its own conditions."""

import base64
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkfolio.llm import bpe
from sparkfolio.llm.packing import difference, pack, pack_documents

tiktoken = pytest.importorskip("tiktoken")
ODD = ["", " ", "\n\n \t", "  a  b\x1c\x1dc  ", "aaaaaaaaaaaaaaaaa", "<|endoftext|> x", "I'll can't'VE", "²½ 12ab", "日本 語😀😀é", " x　y   z", " a", "a" * 20000, "é" * 999]


@pytest.fixture(scope="module")
def reference():
    split = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    with open(f"{bpe.TOKENIZERS}/{bpe.VOCABULARY}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=split, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.CorpusEncoder()


def ids(encoder, texts):
    flat, offsets = encoder.encode(texts)
    return [flat[a:b].tolist() for a, b in zip(offsets, offsets[1:])]


def test_same_as_other_encoders(encoder, reference):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    got = ids(encoder, ODD)
    assert got == [reference.encode_ordinary(x) for x in ODD]
    assert got == [x.ids for x in t.encode_batch(ODD, add_special_tokens=False)]
    assert (encoder.lengths(ODD) == [len(x) for x in got]).all()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_text(encoder, reference, texts):
    assert ids(encoder, texts) == [reference.encode_ordinary(x) for x in texts]


def test_words_are_forgotten_without_effect(monkeypatch, reference):
    monkeypatch.setattr(bpe, "WORDS_KEPT", 5)
    enc = bpe.CorpusEncoder()
    for x in ODD * 2:
        assert ids(enc, [x]) == [reference.encode_ordinary(x)]


def test_encode_documents(spark, reference):
    rows = [(i, x, "e") for i, x in enumerate(ODD)] + [(50, None, "e"), (None, "word", "e"), (3, ODD[3], "e")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    out = bpe.encode_documents(df)
    assert out.columns == ["doc_id", "ids"] and out.dtypes[1][1] == "array<int>"
    got = sorted((r.doc_id is None, r.doc_id, r.ids) for r in out.collect())
    assert got == sorted((i is None, i, reference.encode_ordinary(x) if x else []) for i, x, _ in rows)
    assert bpe.encode_documents(df.where("1 = 0")).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_pack(seed):
    rng = random.Random(seed)
    sizes = [rng.choice((rng.randint(1, 100), rng.randint(1, 40), 51, 100)) for _ in range(rng.randint(1, 200))]
    windows = pack(sizes, 100)
    load = np.bincount(windows, weights=sizes)
    assert load.max() <= 100 and (load > 0).all()
    best = max(-(-sum(sizes) // 100), sum(2 * s > 100 for s in sizes))
    assert len(load) <= best * 1.12 + 2


def test_differencing_balances():
    rng = random.Random(5)
    sizes = [rng.randint(50, 150) for _ in range(300)]
    windows, sums = difference(sizes, 20)
    load = np.bincount(windows, weights=sizes, minlength=20)
    assert sorted(load) == sorted(sums.tolist()) and sum(load) == sum(sizes) and load.max() - load.min() <= 60


def test_pack_documents(spark, encoder):
    texts = ["word " * n for n in (5, 3000, 1, 2047, 2048, 2049, 700, 5000)] + ["", None, " ", "tie", "tie"]
    df = spark.createDataFrame([(i, x, 7) for i, x in enumerate(texts)] + [(3, texts[3], 7), (None, "x", 7)], "doc_id bigint, text string, piece int")
    rows = pack_documents(df, capacity=1000).collect()
    load, length = {}, {}
    for r in rows:
        load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
        length[r.doc_id] = length.get(r.doc_id, 0) + r.n_tokens
    assert max(load.values()) <= 1000
    want = {i: int(n) for i, n in enumerate(encoder.lengths(texts)) if n} | {None: 1}
    want[3] *= 2
    assert length == want
    for i, n in want.items():
        mine = sorted((r.piece, r.start_token, r.n_tokens) for r in rows if r.doc_id == i)
        if i not in (3, None):
            assert [s for _, s, _ in mine] == [1000 * k for k in range(len(mine))] and len(mine) == -(-n // 1000)
    assert pack_documents(df.where("1 = 0")).count() == 0


def test_containers_of_a_corpus_are_full(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = pack_documents(docs).groupBy("container_id").sum("n_tokens").collect()
    load = [r[1] for r in rows]
    assert max(load) <= 2048 and sum(load) / (2048 * len(load)) > 0.97
