import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from scriptorium.llm import packing as K

FILES = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(FILES[0])
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_both_libraries_give_the_same_ids(reference, words):
    encode = K.encoder(*FILES)
    odd = ["", " ", "a  b\n\n\tc", "É straße İI ﬁ", "日本語テキスト 😀👍🏽", "<|endoftext|> x", "don't we'll I'M", "x" * 5000, " " * 3000 + "y", "\x00\x01", "1234567 89,0", "​  z", " ".join(words)]
    assert [encode(t) for t in odd] == [reference(t) for t in odd]


def check(rows, docs, ids_of, length=K.LENGTH):
    """Each id in one piece, sequences gapless, full or a power of two."""
    want = sorted((str(d), zlib.crc32(np.array([*ids_of(t), 0], "<u4").tobytes())) for d, t in docs)
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault((str(r["doc_id"]), r["doc_tokens"]), []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] == len(r["ids"]) // 4 and zlib.crc32(r["ids"]) == r["ids_crc32"]
            at += r["length"]
        assert at == length or at & (at - 1) == 0 and at < length
    assert sum(r["length"] for r in rows) == sum(len(ids_of(t)) + 1 for _, t in docs)
    whole = []
    for (doc, total), own in pieces.items():
        own.sort(key=lambda r: (r["start"], r["ids"]))
        copies = sum(r["length"] for r in own) // total
        if copies == 1:
            assert [r["start"] for r in own] == [*np.cumsum([0, *(r["length"] for r in own[:-1])])]
            whole.append((doc, zlib.crc32(b"".join(r["ids"] for r in own))))
    once = [x for x in want if sum(y[0] == x[0] for y in want) == 1]
    assert all(x in whole for x in once)


def test_round_trip_over_many_partitions(spark, reference, words):
    docs = [(i, " ".join(words[(i * 37 + j) % 3000] for j in range(i * i % 700))) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(40)
    check(K.pack(spark, df, *FILES, ids=True).collect(), docs, reference)


def test_odd_rows(spark, reference, odd_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    check(K.pack(spark, odd_docs, *FILES, ids=True).collect(), docs, reference)
    assert K.pack(spark, odd_docs.limit(0), *FILES).count() == 0


def test_best_fit_takes_the_fullest_window():
    out = []
    p = K.Packer(10, 2, lambda w: out.append([(d, len(i)) for d, _, i, _ in w]))
    add = lambda d, n: p.add(d, 0, np.zeros(n, "<u4"), n)
    add("a", 7), add("b", 5), add("c", 3)  # c fills a's window
    assert out == [[("a", 7), ("c", 3)]]
    add("d", 4), add("e", 2)  # d joins b (room 1), e opens
    add("f", 9)  # none fits: the fullest takes one id of f and goes
    assert out[1] == [("b", 5), ("d", 4), ("f", 1)]
    p.finish()
    assert [sum(n for _, n in w) for w in out[2:]] == [10] and len(p.free) == 0


def test_special_tokens_in_a_text_have_their_ids(spark):
    plain = Tokenizer.from_file(FILES[0])
    docs = [(1, "a <|endoftext|> b"), (2, "<|endoftext|>"), (3, "x<|endoftext|><|endoftext|>\n y"), (4, "<|endoftext"), (5, "a b")]
    ids_of = lambda text: plain.encode(text, add_special_tokens=False).ids
    assert ids_of(docs[0][1]) == [64, 220, 50256, 275]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    for files in (FILES, FILES[:1]):
        rows = K.pack(spark, df, *files, ids=True).collect()
        check(rows, docs, ids_of)
        assert {r["doc_id"]: r["doc_tokens"] for r in rows} == {d: len(ids_of(t)) + 1 for d, t in docs}
