import random
import re

from pagetext.llm import licences as L
from parity import connect


def words_of(x):
    return re.findall("[a-z0-9]+", x.translate({c: c + 32 for c in range(65, 91)}))


def brute(text, templates=L.TEMPLATES, least=0.8):
    """Every window of every template, the best taken again and again."""
    w = words_of(text or "")
    pairs = list(zip(w, w[1:]))
    windows = []
    for k, (name, t) in enumerate(templates):
        tw = words_of(t)
        want = list(zip(tw, tw[1:]))
        for a in range(len(pairs)):
            left, shared = {p: want.count(p) for p in want}, 0
            if pairs[a] not in left:
                continue
            for b in range(a, min(len(pairs), a + int(len(want) * 2 / least) + 1)):
                if left.get(pairs[b], 0) > 0:
                    left[pairs[b]] -= 1
                    shared += 1
                total = b - a + 1 + len(want)
                if pairs[b] in left and 2.0 * shared / total >= least:
                    windows.append((-(shared * shared) / total, a, b, name, k, 2.0 * shared / total, shared))
    out = []
    while windows:
        top = min(windows)
        out.append((top[3], top[1], top[2] - top[1] + 2, top[5], top[6]))
        windows = [x for x in windows if x[2] + 1 < top[1] or x[1] > top[2] + 1]
    return sorted(out, key=lambda x: x[1])


def template(name, k):
    return [t for n, t in L.TEMPLATES if n == name][k]


def wrapped(t, k, sep="\n"):
    w = t.split()
    return sep.join(" ".join(w[i:i + k]) for i in range(0, len(w), k))


def texts():
    mit = template("MIT", 2)
    bsd3, bsd2 = template("BSD-3-Clause", 0), template("BSD-2-Clause", 0)
    changed = bsd3.replace("copyright holder", "ACME corporation").replace("THIS SOFTWARE", "THIS LIBRARY")
    return [None, "", "\n\n", "one", "Released under the MIT license", "some text\nReleased under the MIT License!\n\nmore", wrapped(mit, 9), "head\n \t\n" + wrapped(changed, 7, "\n# ") + "\n\ntail of words",
            "Licensed under CC BY-NC 4.0.\n\nLicensed under CC BY-NC 4.0. Licensed under CC BY-SA 4.0", "of the software " * 60 + bsd2 + " of the software" * 60,
            ("word " * 40 + "\n") * 20, "Licensed under\nthe Apache License,\nVersion 2.0.", "İ licensed under the mit license. K", "Licensed under the MIT License. " + mit + " Released under the MIT License."]


def found(text):
    return [h[1:] for h in L.Matcher().scan([(text or "").encode()])]


def test_scan_equals_brute_force():
    for t in texts():
        assert found(t) == brute(t), t


def test_random_texts_equal_brute_force():
    """Few words and short templates with repeats: many overlapping windows and ties, several texts and small groups at a time."""
    rng = random.Random(2)
    templates = (("x", "a b a b c"), ("y", "b a b a"), ("x", "c c c"), ("z", "a b c d e f"), ("none", "a"))
    cases = [" ".join(rng.choice("aabbccdefg") for _ in range(rng.randrange(0, 60))) for _ in range(150)]
    for least in (0.6, 0.8, 1.0):
        m = L.Matcher(templates, least)
        got = list(m.scan([t.encode() for t in cases]))
        assert [h for h in got] == [(n, *h) for n, t in enumerate(cases) for h in brute(t, templates, least)]


def test_groups_and_pieces_do_not_matter(monkeypatch):
    cases = [t.encode() for t in texts() if t] * 2
    whole = list(L.Matcher().scan(cases))
    monkeypatch.setattr(L, "GROUP", 100)
    monkeypatch.setattr(L, "PIECE", 13)
    assert list(L.Matcher().scan(cases)) == whole


def test_licences_inside_other_texts():
    rng = random.Random(3)
    other = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300))
    mit = template("MIT", 2).replace("conditions: The", "conditions:\n\nThe").replace("Software. THE", "Software.\n\nTHE")
    apache = template("Apache-2.0", 1).replace(" at http", " at\n\n    http").replace("2.0 Unless", "2.0\n\nUnless")
    for name, licence in [("MIT", mit), ("Apache-2.0", apache), ("MIT", "This repository is released under the MIT License. See LICENSE."), ("BSD-3-Clause", template("BSD-3-Clause", 0)),
                          ("BSD-2-Clause", template("BSD-2-Clause", 0)), ("Unlicense", template("Unlicense", 0)), ("GPL-2.0", template("GPL-2.0", 1))]:
        hits = found(f"{other}\n\n{licence}\n\n{other}")
        assert [h[0] for h in hits] == [name] and hits[0][3] > 0.95, (name, hits)
    assert not found(other)


def test_spans_are_code_points(spark):
    t = "ß😀 x\nReleased under the MIT License! ü Licensed under CC BY-SA 4.0."
    rows = L.scan_licences(spark.createDataFrame([(1, t)], "doc_id bigint, text string")).orderBy("start").collect()
    assert [t[r["start"]:r["end"]] for r in rows] == ["Released under the MIT License", "Licensed under CC BY-SA 4.0"]


def test_scan_equals_its_twin(spark, tmp_path):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts())] + [(4, texts()[4], 1), (None, texts()[4], 1)], "doc_id bigint, text string, license int")
    df.toPandas().astype({"doc_id": "Int64"}).to_parquet(tmp_path / "documents.parquet")
    got = sorted((tuple(r) for r in L.scan_licences(df).drop("start", "end").collect()), key=str)
    assert got == sorted(connect(str(tmp_path)).execute(L.licence_sql()).fetchall(), key=str)
    assert len(got) >= 14 and sum(r[0] is None for r in got) == 1
    assert L.scan_licences(df.limit(0)).count() == 0
