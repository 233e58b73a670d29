"""Text functions on small golden rows, with CJK text the given tables lack."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagetext.functions import text as T
from pagetext.operators import quality as Q
from pagetext.operators import terms as M


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(fn(F.col("c")).alias("r")).first().r


@pytest.mark.parametrize("pieces,want", [(["foo", "bar"], "foo bar"), (["漢", "字"], "漢字"), (["foo", "字"], "foo字"), (["a", "", "b "], "a b"), (["x1", "y"], "x1y"), ([], "")])
def test_block_text(spark, pieces, want):
    assert one(spark, pieces, T.block_text, "array<string>") == want


def test_width_and_finalise(spark):
    assert one(spark, "Ａ！　Ｂ。", T.to_half_width) == "A! B."
    assert one(spark, "A! B", T.to_full_width) == "Ａ！　Ｂ"
    assert one(spark, "Ａ!  Ｂ. C", lambda c: T.finalise(c, "English", "日本語")) == "A!B.C"
    assert one(spark, "Ａ。", lambda c: T.finalise(c, "日本語", "繁體中文")) == "Ａ。"
    assert one(spark, "Ａ", lambda c: T.finalise(c, "日本語", "English", full_page=False)) == "Ａ"


def test_letter_case(spark):
    assert one(spark, "12 eGGS. 7 MORE!yes。ok", lambda c: T.letter_case(c, "capitalize")) == "12 Eggs. 7 More!Yes。Ok"
    assert one(spark, "abc", lambda c: T.letter_case(c, "unknown")) == "abc"


def test_rules(spark):
    rules = [{"keyword": "a.b", "sub": "$1\\\\", "use_reg": False, "case_sens": True}, {"keyword": "(x)(?:y)", "sub": r"\1\n", "use_reg": True, "case_sens": False},
             {"keyword": "[", "sub": "", "use_reg": True, "case_sens": True}]
    assert one(spark, "a.b axb XY", lambda c: T.substitute(c, rules)) == "$1\\ axb X\n"
    assert [i for i, _ in T.valid_rules(rules)[1]] == [2]


def test_kana_punctuation_queries(spark):
    assert one(spark, "キュゥべえ", T.enlarge_kana) == "キユウべえ"
    assert one(spark, "キュゥ", lambda c: T.enlarge_kana(c, "ゥ")) == "キユゥ"
    assert one(spark, "（え）...--", T.normalise_punctuation) == "︵え︶……——"
    assert one(spark, "a😀❤", T.clean_query) == "「a♥」"
    assert one(spark, "「「a」b」", T.unquote) == "a」b"


def test_segmentation(spark):
    assert one(spark, "漢\n字", lambda c: T.segment(c, "日本語")) == ["漢", "字"]
    assert one(spark, "I am here", lambda c: T.segment(c, "English")) == ["I am", "here"]
    assert one(spark, "one", lambda c: T.segment(c, "English")) == ["one"]
    assert one(spark, "big cat.dog a house", lambda c: T.segment(c, "English")) == ["big", "cat.", "dog a", "house"]


def slow_repeats(s, threshold):
    """Walk over the text once per unit length and count copies of the unit at each place."""
    for k in range(1, len(s) // 2 + 1):
        at = 0
        while at + 2 * k <= len(s):
            unit, n = s[at:at + k], 1
            while "\n" not in unit and s[at + n * k:at + n * k + k] == unit:
                n += 1
            if n >= threshold:
                return True, unit, n, s[:at] + s[at + n * k:], n
            at += n * k if n > 1 else 1
    return False, None, 0, s, threshold


def test_find_repeats(spark):
    rnd = random.Random(1)
    texts = ["", "a", "ab" * 30, "x" + "abc\n" * 40, "é" * 19, "é" * 20 + "z", "ab" * 9 + "ba" * 11]
    texts += ["".join(rnd.choice("ab") for _ in range(rnd.randint(0, 60))) + rnd.choice(["ab", "aab", "b", "ba\n"]) * rnd.randint(0, 9) + "a" * rnd.randint(0, 3) for _ in range(300)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.find_repeats(F.col("t"), 6).alias("r")).collect()
    for r in rows:
        assert tuple(r.r) == slow_repeats(texts[r.i], 6), texts[r.i]


def test_tokens_suffix_clusters(spark):
    assert one(spark, "abcdefgh你", T.token_estimate) == 3
    assert one(spark, "x" + "ab" * 31, T.repeated_suffix) is True
    assert one(spark, "ab" * 30, T.repeated_suffix) is False
    assert one(spark, "がa‍b❤️", T.clusters)[0] == "が"
    assert one(spark, "漢字 helo世界 wrld a", lambda c: F.regexp_extract_all(c, F.lit(T.WORD_SCRIPTS + "{2,}"), F.lit(0))) == ["helo", "wrld"]


def test_entities_and_honorifics(spark):
    assert one(spark, "アリスとボブ・ドキ", T.entities) == ["アリス", "ボブ", "ドキ"]
    assert one(spark, "田中さん", lambda c: T.entities(c, T.HONORIFIC)) == ["田中さん"]


def test_names_paths_times(spark):
    for v, ok in [("a.png", True), ("a/b", False), ("..", False), ("c:x", False), ("", False), (None, False)]:
        assert one(spark, v, T.safe_name) is ok
    assert one(spark, "/r/../x", lambda c: T.inside_root(c, "/r")) is False
    assert one(spark, 3725.9, T.duration_text, "double") == "01:02:05"
    assert one(spark, 400000.0, T.duration_text, "double") == "111:06:40"
    assert one(spark, "2026-01-02T03:04:05+08:00", T.stamp_state) == "2026-01-01 19:04:05"


def test_own_direction(spark):
    d = spark.createDataFrame([(["ab", "cd"], [(0, 0, 10, 40), (20, 0, 30, 50)]), (["ab", "cd"], [(0, 0, 10, 40), (0, 0, 50, 10)]), (["あ", "いう"], [(0, 0, 9, 1), (0, 0, 10, 40)]), (["ab"], [])],
                              "t array<string>, l array<struct<x1:int,y1:int,x2:int,y2:int>>")
    assert [r.v for r in d.select(Q.own_direction(F.col("t"), F.col("l")).alias("v")).collect()] == [True, None, True, None]


def test_glossary_strategies_agree(spark):
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abß") for _ in range(rnd.randint(1, 7))) for _ in range(60)]
    g = spark.createDataFrame([(i, w.upper() if i % 3 == 0 and "ß" not in w else w, "t", "") for i, w in enumerate(words)], "entry_idx int, source string, translation string, note string")
    texts = [(p, "".join(rnd.choice("abß ") for _ in range(rnd.randint(0, 40)))) for p in range(50)]
    t = spark.createDataFrame(texts, "page int, text string")
    low = lambda s: s.lower().replace("ß", "ss")
    want = {(p, i) for p, x in texts for i, w in enumerate(words) if low(w) in low(x)}
    assert {tuple(r) for r in M.match_glossary(t, g).collect()} == want
    assert M.match_glossary(t, g, mode="all").count() == 50 * 60
    assert M.match_glossary(t, g.limit(0)).count() == 0


def test_words_for_the_spelling_check(spark):
    texts = ["漢字 helo世界 wrld", "𠀀helo", "한helo世界wrld", "ㇰ々한글漢字", "", None]
    d = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = sorted((r.k, r.start, r.length, r.word) for r in M.word_spans(d, "t", ["k"]).collect())
    assert got == [(0, 3, 4, "helo"), (0, 10, 4, "wrld"), (1, 2, 4, "helo"), (2, 1, 4, "helo"), (2, 7, 4, "wrld")]


def test_many_replacements_fold_in_order(spark):
    pairs = [("a", "b"), ("b", "cc"), ("cc", "a"), ("", "x"), ("z", "")] + [(f"q{i}", f"r{i}") for i in range(3000, 1000, -1)]
    rows = [(i, t) for i, t in enumerate(["abc", "q1500 q2999z", None, "", "zzz"])]
    want = {}
    for i, t in rows:
        for old, new in pairs:
            t = t.replace(old, new) if t is not None and old else t
        want[i] = t
    table = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "at int, old string, new string")
    for part in (1 << 22, 20000):
        got = M.apply_terms(spark.createDataFrame(rows, "k int, translation string"), table, part_chars=part).collect()
        assert {r.k: r.translation for r in got} == want and {r.k: r.changed for r in got} == {i: want[i] != t for i, t in rows}


def test_spans(spark):
    s = "xx ab\nab ABab"
    d = spark.createDataFrame([(1, s)], "k int, t string")
    got = sorted((r.start, r.length) for r in M.search_spans(d, T.search_pattern("ab"), "t", ["k"]).collect())
    assert got == [m.span()[:1] + (2,) for m in re.finditer("(?i)ab", s)]


def test_suggestions_match_brute_force(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 6)))
    words, entries = sorted({word() for _ in range(40)}), sorted({word() for _ in range(60)})

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    got = {}
    for r in Q.suggestions(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(w, 1) for w in entries], "word string, rank int")).collect():
        got.setdefault(r.word, []).append((r.rn, r.entry))
    for w in words:
        want = sorted((distance(w, e), e) for e in entries if e != w and distance(w, e) <= 2)[:5]
        assert [e for _, e in sorted(got.get(w, []))] == [e for _, e in want]


def test_texts_of_a_batch_are_worked_in_bounded_pieces(spark):
    texts = pa.array(["", None, "x" * 900, *(["ab c"] * 1000), "y" * 5000, "z", None])
    pieces = list(T._pieces(texts, 1000))
    assert pa.concat_arrays(pieces).equals(texts) and list(map(len, T._pieces(texts[:0], 1000))) == [0]
    assert len(pieces) >= 5 and all(sum(map(len, p[1:].drop_null().to_pylist())) <= 1000 for p in pieces)
    rows = [(i, None if i % 7 == 0 else f"I am here {i} " * (40 if i % 5 else 4000)) for i in range(60)]
    d = spark.createDataFrame(rows, "i int, t string").coalesce(1)
    got = d.select("i", T.segment(F.col("t"), "English").alias("w"), T.find_repeats(F.col("t"), 30).alias("r")).collect()
    for (i, t), r in zip(rows, got):
        assert r.i == i and r.w == (None if t is None else T._join_short_words(t))
        assert tuple(r.r) == T.repeats_of([t or ""], 30)[0] and r.r.repeated == (t is not None)
