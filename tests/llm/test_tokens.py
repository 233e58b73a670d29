import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pagetext.llm import tokens as T
from pagetext.llm.queries import multi_ranks

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    ranks, pattern = multi_ranks()
    return ranks, pattern, tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_every_character_and_random_texts(vocabulary, monkeypatch):
    ranks, pattern, ref = vocabulary
    monkeypatch.setattr(T, "KEPT", 5000)
    rng = random.Random(1)
    texts = ["", "a", " ", "  \n\n x", "x" * 5000, "ab" * 3000, "é" * 200, "=-" * 300, "\x1c\x1d a\x85b c", "it's we'll <|endoftext|>"]
    texts += ["".join(rng.choice("thein aß'\n9") for _ in range(rng.randrange(1, 300))) for _ in range(300)]
    texts += ["".join(f"a{chr(c)} {chr(c)}b" for c in range(s, s + 4096) if not 0xD800 <= c < 0xE000) for s in range(0, 0x20000, 4096)]
    got = [[i for block in blocks for w in block for i in w[3]] for blocks in T.Encoder(ranks, pattern).tokens(texts)]
    assert got == [ref.encode_ordinary(t) for t in texts]


def test_long_texts_go_in_blocks(vocabulary, monkeypatch):
    ranks, pattern, ref = vocabulary
    monkeypatch.setattr(T, "STRETCH", 500)
    monkeypatch.setattr(T, "PIECES", 64)
    text = " ".join(str(i) + "wörter" for i in range(2000))
    blocks = list(next(T.Encoder(ranks, pattern).tokens([text])))
    assert len(blocks) > 10 and [i for b in blocks for w in b for i in w[3]] == ref.encode_ordinary(text)


def test_documents(docs, doc_rows, no_docs, vocabulary):
    ranks, pattern, ref = vocabulary
    text = {r[0]: r[1] or "" for r in doc_rows if r[0] is not None}
    rows = T.digest_documents(docs, ranks, pattern).collect()
    assert len(rows) == len(doc_rows)
    for r in rows:
        if r.doc_id is not None:
            ids = ref.encode_ordinary(text[r.doc_id])
            assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    back = T.decode_documents(T.encode_documents(docs, ranks, pattern), ranks).filter("doc_id is not null")
    assert {(r.doc_id, bytes(r.decoded).decode()) for r in back.collect()} == set(text.items())
    assert T.digest_documents(no_docs, ranks, pattern).count() == 0 and T.encode_documents(no_docs, ranks, pattern).count() == 0


def test_fold_in_higher_order_functions(spark, vocabulary):
    ranks, _, ref = vocabulary
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("thein ßaé9") for _ in range(rng.randrange(1, 14))) for _ in range(150)} | {"", "a", "the", " unglich", "日本"})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {r.word: r.ids for r in T.encode_words(df, ranks).collect()}
    merges = T.Merges(ranks)
    assert got == dict(zip(words, merges.fold([w.encode() for w in words])))
    back = T.decode_words(T.encode_words(df, ranks), ranks).select("word", F.col("decoded").cast("string").alias("d")).collect()
    assert all(r.word == r.d for r in back)


def test_other_vocabularies_and_missing_pairs():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abc": 257, b"bc": 258, b"cd": 259}
    m = T.Merges(ranks)
    assert m.fold([b"abcd", b"bcd", b"", b"x", b"ab" * 40]) == [[257, 100], [258, 100], [], [120], [256] * 40]
