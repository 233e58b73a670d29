"""The glossary automaton against plain containment, and spans of letters and hits against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagetext.functions import text as tx
from pagetext.functions.arrays import prefix_sums
from pagetext.operators import automaton as A
from pagetext.operators import terms as M


def test_automaton_against_containment():
    rng = random.Random(2)
    for _ in range(150):
        letters = "abé漢"[:rng.randrange(1, 5)]
        made = lambda n: "".join(rng.choice(letters) for _ in range(n)).encode()
        terms = sorted({made(rng.randrange(1, 6)) for _ in range(rng.randrange(12))})
        texts = [made(rng.randrange(rng.choice([5, 40, 3000]))) + b"x" for _ in range(rng.randrange(9))]
        auto = A.build_automaton(terms)
        text, term = A.scan_texts(auto, np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts]))
        want = sorted((j, i) for i, t in enumerate(texts) for j, w in enumerate(terms) if w in t)
        assert list(zip(term.tolist(), text.tolist())) == want


def test_common_start_stays_in_proportion():
    """Terms that share a start share its states, and a text costs one step a byte whatever it holds."""
    terms = [b"common" + str(i).encode() for i in range(20000)]
    auto = A.build_automaton(terms)
    assert len(auto.term) < sum(map(len, terms)) / 2
    text = b"common1 common common19999" * 2000
    _, term = A.scan_texts(auto, np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert {terms[t] for t in term} == {w for w in terms if w in text}


@pytest.mark.parametrize("part_bytes", [1 << 18, 8])
def test_match_glossary(spark, part_bytes):
    glossary = spark.createDataFrame([(1, "ab"), (2, "AB"), (3, "b"), (4, ""), (5, None), (6, "straße"), (7, "c++"), (8, "zz")], "entry_idx int, source string")
    texts = spark.createDataFrame([(1, "xaB"), (1, "b"), (2, ""), (3, None), (4, "STRASSE C++ [boss]"), (None, "ab"), (5, "xa"), (5, "bx")], "page int, text string")
    got = M.match_glossary(texts, glossary, part_bytes=part_bytes)
    assert got.schema["entry_idx"].dataType.simpleString() == "int"
    want = [(None, 1), (None, 2), (None, 3), (None, 4), (1, 1), (1, 2), (1, 3), (1, 4), (2, 4), (4, 3), (4, 4), (4, 6), (4, 7), (5, 3), (5, 4)]
    assert sorted(map(tuple, got.collect()), key=lambda r: (r[0] is not None, r)) == want
    assert M.match_glossary(texts, glossary.limit(0)).count() == 0 and M.match_glossary(texts.limit(0), glossary).count() == 0


def test_match_glossary_shuffles_no_text(spark):
    glossary = spark.createDataFrame([(1, "ab")], "entry_idx int, source string")
    plan = M.match_glossary(spark.range(5).selectExpr("id as page", "string(id) as text"), glossary)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan  # of the matches, to make them distinct


def test_prefix_sums(spark):
    rng = random.Random(1)
    rows = [[rng.randrange(9) for _ in range(n)] for n in (0, 1, 15, 16, 17, 255, 256, 257, 5000)]
    for r in spark.createDataFrame([(r,) for r in rows], "a array<int>").select("a", prefix_sums(F.col("a")).alias("p"), prefix_sums(F.col("a"), 3, 1).alias("q")).collect():
        assert r.p == r.q == [sum(r.a[:i]) for i in range(len(r.a))]


def test_letter_spans():
    letters = tx.checked_letters()
    rng = random.Random(3)
    texts = ["".join(rng.choice("abé𝒳漢 1½.Ⅷß\n") for _ in range(rng.randrange(60))) for _ in range(80)] + ["", "ab"]
    text, n, start, length, word = M.letter_spans(texts, letters, 2)
    want = []
    for i, t in enumerate(texts):
        units, run, k = 0, "", 0
        for ch in t + " ":
            if letters[ord(ch)]:
                run += ch
            elif run:
                if len(run) > 1:
                    size = len(run.encode("utf-16-le")) // 2
                    want.append((i, k, units - size, size, run))
                    k += 1
                run = ""
            units += 1 + (ord(ch) > 0xFFFF)
    assert list(zip(text.tolist(), n.tolist(), start.tolist(), length.tolist(), word.to_pylist())) == want
