"""Operators 3 and 4 against the libraries, and op 4's trees against a plain merge."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from stratalode.llm import bpe, token_counts
from tests.llm.conftest import LONG

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    with open(BYTES, "rb") as f:
        return bpe.Bpe(f.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTES)


def texts(n, seed=1):
    rng = random.Random(seed)
    parts = [" ", "  ", "\n", "\t", "\r\n", "a", "the", "The", "'s", "'ll", "don't", "1", "23", "²", "é", "ß", "中文", "😀", "<|endoftext|>", "<|endof", "\x1c", "\x85", "\xa0", " ", "　", "_", "-", "...", "\0", "ab" * 50, "١"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_ids_and_text_of_the_library(model, library):
    encoder = bpe.Encoder(model, remembered=50)
    for batch in (texts(300), texts(50, 2), [LONG], ["x" * 3_000, "中" * 500, ""]):
        flat, counts = encoder.encode(batch)
        want = [library.encode(t, add_special_tokens=False).ids for t in batch]
        assert counts.tolist() == [len(w) for w in want]
        assert flat.tolist() == [i for w in want for i in w]
        assert model.decode(flat, counts) == [library.decode(w, skip_special_tokens=False) for w in want]


def test_trees_agree_with_plain_merging(model):
    rng = random.Random(3)
    for _ in range(200):
        data = bytes(rng.choice(b"abcdeth ing") for _ in range(rng.randrange(1, 90)))
        ids = model.byte_ids[np.frombuffer(data, dtype=np.uint8)].tolist()
        while ranked := [(model.rank_of[ids[i] << 32 | ids[i + 1]], i) for i in range(len(ids) - 1) if ids[i] << 32 | ids[i + 1] in model.rank_of]:
            rank, i = min(ranked)
            ids[i : i + 2] = [int(model.merged[rank])]
        assert model.merge_one(data) == ids
        assert model.encode_pieces([data, b"a", data])[0].tolist().count(ids[0]) >= 2


def test_op4_rows(spark, odd, none, library):
    got = bpe.digests(bpe.round_trip(odd, BYTES)).collect()
    want = [(r.doc_id, r.text or "") for r in odd.select("doc_id", "text").collect()]
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(
        (str(i), len(ids := library.encode(t, add_special_tokens=False).ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in want
    )
    assert bpe.round_trip(none, BYTES).count() == 0
    again = bpe.decode(bpe.encode(odd, BYTES), BYTES)
    assert set(again.columns) == set(odd.columns)
    assert {r.decoded for r in again.collect()} == {t for _, t in want}


def test_op3_rows_and_cache(spark, odd, none, tmp_path):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    cache = str(tmp_path / "cache")
    got = token_counts.count_tokens(odd, PIECES, cache, limit=5)
    want = [(str(r.doc_id), len((r.text or "").encode()), n := len(library.encode(r.text or "")), n > 5) for r in odd.collect()]
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == sorted(want)
    assert set(odd.columns) <= set(got.columns)
    stored = token_counts.read_cache(spark, cache)
    assert stored.count() == len({r.text or "" for r in odd.collect()})  # distinct contents only
    token_counts.count_tokens(odd, PIECES, cache).collect()
    assert token_counts.read_cache(spark, cache).count() == stored.count()  # nothing missed the second time
    other = token_counts.count_tokens(odd.filter("doc_id = 3"), BYTES, cache)  # another tokenizer has its own rows
    assert {r.n_tokens for r in other.collect()} == {6}
    assert token_counts.read_cache(spark, cache).count() == stored.count() + 1
    assert token_counts.count_tokens(none, PIECES, str(tmp_path / "empty")).count() == 0


@pytest.mark.parametrize("most", [1_000, 0])
def test_op3_encodes_only_what_a_stored_cache_lacks(spark, words, tmp_path, monkeypatch, most):
    """Also where the missing digests are too many to broadcast."""
    monkeypatch.setattr(token_counts, "BROADCAST_DIGESTS", most)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    cache = str(tmp_path / "cache")
    old = [(i, words(20)) for i in range(30)]
    token_counts.count_tokens(spark.createDataFrame(old, "doc_id long, text string"), PIECES, cache).collect()
    before = token_counts.read_cache(spark, cache).count()
    new = old + [(100 + i, words(20)) for i in range(5)] + [(200, old[0][1]), (201, None)]
    got = token_counts.count_tokens(spark.createDataFrame(new, "doc_id long, text string"), PIECES, cache).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == sorted((i, len(library.encode(t or ""))) for i, t in new)
    assert token_counts.read_cache(spark, cache).count() == before + 6
