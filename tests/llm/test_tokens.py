import zlib
from array import array

import numpy as np
import public_tokenizers as tokenizers_files
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from palimpsest.llm import packing, queries, tokenfile
from palimpsest.llm.tokens import ChunkEncoder

FILES = {"byte_bpe_50k.json": True, "word_bpe_49k.json": False}
BOTH = {f: (Tokenizer.from_file(tokenizers_files.path(f)), ChunkEncoder(tokenizers_files.path(f), s)) for f, s in FILES.items()}
BITS = ["a", "B", " ", "  ", "\n", "\t", " \n", "\n ", ".", "'s", "1", "23", "é", "　", "\xa0", "!", "\x1c", "é", "<|endoftext|>", "ΑΣ", "​", "🙂", "\0", "word" * 20]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=25).map("".join) | st.text(max_size=30))
def test_chunks_give_the_ids_of_whole_texts(text):
    for tokenizer, own in BOTH.values():
        assert list(array("I", own.encode(text))) == tokenizer.encode(text, add_special_tokens=False).ids


def whole(file, text, end):
    return [*BOTH[file][0].encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def check_packing(pieces, texts, file="byte_bpe_50k.json", window=1024):
    """Every id in just one piece; sequences gapless and at most a window; the padding's share."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    assert set(by_doc) == set(texts)
    for i, text in texts.items():
        ids = whole(file, text, 0)
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == crc(ids[at : at + p["length"]])
            at += p["length"]
        assert at == len(ids)
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= window
    used = sum(p["length"] for p in pieces)
    return 1 - used / (len(by_sequence) * window)


def test_op1_packs_everything(spark, small):
    texts = dict(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect())
    assert check_packing(queries.op1_pack(spark, small).collect(), texts) < 0.01


def test_packing_edges(spark):
    texts = {1: None, 2: "", 3: "x " * 5000, 4: "é🙂", 5: "a" * 40000}
    docs = spark.createDataFrame([(i, t, 7) for i, t in texts.items()], "doc_id long, text string, start int").repartition(3)
    path = tokenizers_files.path("byte_bpe_50k.json")
    check_packing(packing.ids_crc32(packing.pack(docs, path)).collect(), texts)
    assert packing.pack(docs.limit(0), path).count() == 0
    same = spark.createDataFrame([(None, "same text")] * 300, "doc_id long, text string")
    assert sum(r.n for r in packing.pack(same, path).selectExpr("size(ids) n").collect()) == 300 * len(whole("byte_bpe_50k.json", "same text", 0))


def test_open_windows_are_bounded_and_best_fit():
    bins = packing.OpenWindows(10, 2)
    ids = lambda n: np.arange(n, dtype="<u4")
    assert list(bins.put((1, 0, ids(7), 7))) == [] and list(bins.put((2, 0, ids(5), 5))) == []
    (done,) = bins.put((3, 0, ids(3), 3))  # fills the 7 rather than the 5
    assert [p[0] for p in done] == [1, 3]
    assert list(bins.put((4, 0, ids(8), 8))) == []
    (done,) = bins.put((5, 0, ids(9), 9))  # fits none: the fullest is topped up and emitted
    assert [(p[0], len(p[2])) for p in done] == [(4, 8), (5, 2)] and len(bins.bins) == 2
    last = list(bins.finish())
    assert [sum(len(p[2]) for p in w) for w in last] == [10, 2]


def test_op7_round_trip(spark, small):
    texts = dict(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: tuple(r)[1:] for r in queries.op7_tokens(spark, small).collect()}
    at, want = 0, {}
    for i in sorted(texts):
        ids = whole("word_bpe_49k.json", texts[i], 2)
        want[i] = (at, len(ids), crc(ids))
        at += len(ids)
    assert got == want


def test_token_folder_edges(spark, tmp_path):
    texts = [(3, "b b b"), (1, None), (None, "n"), (2, ""), (9, "x y z " * 9000), (3, "b b b"), (3, "a")]
    coding = tokenfile.Coding(tokenizers_files.path("word_bpe_49k.json"), False, 2)
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts], "doc_id long, text string, start int").repartition(4)
    tokenfile.write(docs, f"{tmp_path}/t", coding, block_bytes=16)
    rows = sorted(tokenfile.read(spark, f"{tmp_path}/t").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 3, 3, 9]
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens
    wanted = sorted((str(i), whole("word_bpe_49k.json", t, 2)) for i, t in texts)
    assert sorted((str(r.doc_id), r.ids) for r in rows) == wanted
    (one,) = tokenfile.read(spark, f"{tmp_path}/t", only=[9]).collect()
    assert one.ids == whole("word_bpe_49k.json", "x y z " * 9000, 2)
    tokenfile.write(docs.limit(0), f"{tmp_path}/e", coding)
    assert tokenfile.read(spark, f"{tmp_path}/e").count() == 0


def test_another_dictionary_is_refused(spark, tmp_path, small):
    coding = tokenfile.Coding(tokenizers_files.path("word_bpe_49k.json"), False, 2)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    tokenfile.write(docs, f"{tmp_path}/t", coding)
    digest, dictionary = tokenfile.read_dictionary(spark, f"{tmp_path}/t")
    assert dictionary and digest == zlib.crc32(dictionary)
    other = dictionary[:-1] + bytes([dictionary[-1] ^ 1])
    spark.createDataFrame([(tokenfile.dictionary_hash(other), bytearray(other))], "dict_hash bigint, dictionary binary").write.mode("overwrite").parquet(f"{tmp_path}/t/dictionary")
    with pytest.raises(Exception, match="another dictionary"):
        tokenfile.read(spark, f"{tmp_path}/t").count()
