"""Operator 12 against the tiktoken library and a merge loop over bytes."""

import hashlib
import random

import numpy as np
import pytest

from small import corpus, frame, tables
from tokenloom.llm import byte_bpe, queries

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder(ranks):
    return byte_bpe.Encoder(byte_bpe.Vocabulary(ranks), public_tokenizers.PATTERN, byte_bpe.newer_letters())


def ids(encoder, text):
    return np.frombuffer(encoder.encode([text])[0], "<u4").tolist()


def one_at_a_time(ranks, piece):
    parts = [bytes([b]) for b in piece]
    while True:
        best = min(((ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


def test_query_equals_library(spark, tmp_path, library):
    rows = corpus()
    sf = tables(spark, tmp_path, documents=frame(spark, rows).withColumnRenamed("kept", "ids").withColumnRenamed("body", "decoded"))
    got = sorted(tuple(r) for r in queries.op12_byte_bpe(spark, sf).where("doc_id is not null").collect())
    want = []
    for i, t in rows:
        if i is not None:
            code = library.encode_ordinary(t or "")
            want.append((i, len(code), hashlib.sha256(np.array(code, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)


@pytest.mark.parametrize("alphabet", ["a", "ab", "thein", "ñéa", "的一是", " ", "\n ", "0123", "!?.", "abcdefghijklmnopqrstuvwxyz"])
@pytest.mark.parametrize("size", [1, 2, 3, 64, 129, 5000])
def test_runs_of_any_length(encoder, library, alphabet, size):
    rng = random.Random(size)
    text = "".join(rng.choice(alphabet) for _ in range(size))
    assert ids(encoder, text) == library.encode_ordinary(text)


def test_every_code_point(encoder, library):
    rng = random.Random(1)
    every = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x110000, 7))]
    for k in range(0, len(every), 5000):
        text = "".join(c + rng.choice([" ", "a", "1", ".", "\n", ""]) for c in every[k:k + 5000])
        assert ids(encoder, text) == library.encode_ordinary(text)


def test_order_of_merges_where_a_merge_makes_a_lower_rank():
    """Ranks in which a new pair comes before the pair that made it: batches of equal pairs have to stop there."""
    rng = random.Random(4)
    for _ in range(200):
        tokens = {bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5))) for _ in range(12)}
        order = [b"a", b"b", b"c", *sorted(tokens, key=lambda _: rng.random())]
        ranks = {t: r for r, t in enumerate(order)}
        vocabulary = byte_bpe.Vocabulary({**ranks})
        piece = bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 200)))
        count, got = vocabulary.merge([piece, piece[:7]])
        for p, g in ((piece, got[:count[0]]), (piece[:7], got[count[0]:])):
            assert g.tolist() == ([ranks[p]] if p in ranks else one_at_a_time(ranks, p))


def test_memory_of_pieces_is_bounded(ranks, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE", 50)
    monkeypatch.setattr(byte_bpe, "CHUNK", 400)
    monkeypatch.setattr(byte_bpe, "GROUP", 30)
    encoder = byte_bpe.Encoder(byte_bpe.Vocabulary(ranks), public_tokenizers.PATTERN)
    for _, text in corpus():
        assert ids(encoder, text) == library.encode_ordinary(text or "")
        assert len(encoder.numbers) <= 50


def test_unknown_ids_and_empty_table(spark, ranks):
    vocabulary = byte_bpe.Vocabulary(ranks)
    with pytest.raises(ValueError):
        vocabulary.text(np.array([len(ranks) + 5]))
    with pytest.raises(ValueError):
        byte_bpe.Vocabulary({b"a": 0}).merge([b"ab"])
    empty = spark.createDataFrame([], "doc_id long, text string, ids string")
    coded = byte_bpe.encode(empty, PATH, public_tokenizers.PATTERN)
    assert byte_bpe.decode(coded, PATH).count() == 0 and dict(coded.dtypes)["ids"] == "binary"
