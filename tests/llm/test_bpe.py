"""Trees of joins against the library, and round trips."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from palimpsest.llm import bpe, queries
from palimpsest.session import table

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
PARTS = ["a", "b", "the", " ", "  ", "\n", "\t", " \n", "'", "'s", "'r", "e", "'ll", "l", "!", "1", "23", "é", "ø", "漢", "。", "😀", " ", "　", "́", "'v", "'S", "\x1c", "\x85", "aaaa", "    ", "----", "²", "_"]


@pytest.fixture(scope="module")
def coding():
    return bpe.encoder(PATH, PATTERN)


@pytest.fixture(scope="module")
def library(coding):
    return tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=coding.ranks, special_tokens={})


def test_joins_of_small_spans(coding, library, monkeypatch):
    rng = random.Random(2)
    for _ in range(4000):
        for name, sizes in (("LEAF_CHARS", [1, 2, 3, 5, 8, 40]), ("LEAF_BYTES", [1, 2, 3, 5, 8]), ("LEAF_IDS", [1, 3, 50]), ("WINDOW_IDS", [1, 2, 4]), ("WINDOW_CHARS", [1, 2, 4, 32])):
            monkeypatch.setattr(bpe, name, rng.choice(sizes))
        text = "".join(rng.choice(PARTS) * rng.choice([1, 1, 1, 2, 5]) for _ in range(rng.randrange(60)))
        got = coding.encode(text).tolist()
        assert got == library.encode_ordinary(text), text
        assert coding.decode(got) == text.encode()


def test_merging_by_halves_is_merging_at_once(coding, monkeypatch):
    rng = random.Random(4)
    for _ in range(1500):
        raw = bytes(rng.choice(b"abnet \xc3\xb8\xa5") for _ in range(rng.randrange(1, 80)))
        monkeypatch.setattr(bpe, "LEAF_BYTES", rng.choice([1, 2, 7]))
        monkeypatch.setattr(bpe, "WINDOW_IDS", rng.choice([1, 2]))
        whole = coding._at_once(raw)
        assert coding.merged(raw) == whole
        for a, b in zip(whole, whole[1:], strict=False):  # what the window's proof rests on
            assert coding._at_once(coding.entries[a] + coding.entries[b]) == [a, b]


@pytest.mark.parametrize("text", ["ab" * 60_000, " " * 60_000, "-" * 30_000, "漢字" * 20_000, "word " * 30_000, "x'" * 30_000, "a" * 20_000])
def test_hostile_long_texts(coding, library, text):
    assert coding.encode(text).tolist() == library.encode_ordinary(text)


def test_query_against_the_library(spark, small, library):
    got = {r.doc_id: r for r in queries.op11_bpe(spark, small).collect()}
    texts = table(spark, small, "documents").select("doc_id", "text").collect()
    assert len(got) == len(texts)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    for doc_id, text in texts:
        ids = library.encode_ordinary(text or "")
        assert got[doc_id].n_tokens == len(ids)
        assert got[doc_id].ids_sha256 == sha(",".join(map(str, ids)).encode())
        assert got[doc_id].decoded_sha256 == sha((text or "").encode())


def test_edges(spark, library):
    rows = [(None, None, 1), (1, "", 2), (1, "", 2), (2, "long " * 40_000, 3), (None, "it's\x00", 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source int").withColumnRenamed("source", "made")
    encoded = bpe.encode(docs, PATH, PATTERN, carry=["doc_id", "made"])
    assert {(r.doc_id, r.made): list(r.ids) for r in encoded.collect()} == {(i, k): library.encode_ordinary(t or "") for i, t, k in rows}
    decoded = bpe.decode(encoded, PATH, PATTERN, carry=["made"])
    assert sorted((r.made, bytes(r.decoded)) for r in decoded.collect()) == sorted((k, (t or "").encode()) for _, t, k in rows)
    assert bpe.decode(bpe.encode(docs.where("false"), PATH, PATTERN), PATH, PATTERN).collect() == []
    nothing = spark.createDataFrame([(1, None)], "doc_id int, ids array<int>")
    assert [bytes(r.decoded) for r in bpe.decode(nothing, PATH, PATTERN).collect()] == [b""]
    with pytest.raises(ValueError):
        bpe.encode(docs.withColumnRenamed("made", "ids"), PATH, PATTERN, carry=["ids"])
    with pytest.raises(ValueError):
        bpe.Encoder({b"a": 0}, PATTERN)
