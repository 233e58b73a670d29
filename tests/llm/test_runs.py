import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np

from pagetext.llm import runs as R
from pagetext.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute_runs(words, periods=4, least=6):
    """(start, length, smallest period) by walking along every period."""
    found = {}
    for q in range(1, len(words) // periods + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, periods * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def digest(doc_id, text):
    """The agreed columns of one document, in plain Python."""
    words = split(text)
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *head, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(collapse(words, runs)))


def test_core_against_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        texts = []
        for _ in range(rng.randrange(1, 5)):
            n, k = rng.randrange(60), rng.choice([1, 2, 2, 3, 5])
            w = [rng.randrange(k) for _ in range(n)]
            if n and rng.random() < 0.6:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randrange(3, 11)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            texts.append(w)
        for periods, least in ((4, 6), (2, 2), (3, 7)):
            own, *rows = R.runs_of(np.array(sum(texts, []), dtype=np.int64), np.array([len(t) for t in texts]), periods, least)
            assert [list(zip(*(r[own == k].tolist() for r in rows))) for k in range(len(texts))] == [brute_runs(t, periods, least) for t in texts]


def test_extensions():
    rng = np.random.default_rng(2)
    for n in (2, 30, 500):
        for text in (rng.integers(0, 2, n), np.tile(rng.integers(0, 3, 5), n)[:n], np.zeros(n, np.int64)):
            laid = np.concatenate([[5], text, [6]])
            a, b = np.sort(rng.integers(1, n + 1, (2, 80)), axis=0)
            a, b = a[a < b], b[a < b]
            levels = R.recompress(laid)
            ahead, behind = R.extensions(levels, a, b), R.extensions(levels, a, b, back=True)
            for i, j, x, y in zip(a, b, ahead, behind):
                assert (laid[i:i + x] == laid[j:j + x]).all() and laid[i + x] != laid[j + x]
                assert (laid[i - y + 1:i + 1] == laid[j - y + 1:j + 1]).all() and laid[i - y] != laid[j - y]


def test_documents(spark, docs, doc_rows, no_docs):
    rows = [r for r in doc_rows if r[0] not in (300, 301)]
    extra = [(900, "a " * 50000, *rows[0][2:]), (901, "x\x0b\x1c\x0by é\x00 é\x00 é\x00 é\x00 é\x00 é\x00", *rows[0][2:]), (902, "p q " * 9 + "p", *rows[0][2:])]
    df = spark.createDataFrame(rows + extra, docs.schema).repartition(3)
    got = R.digest_runs(R.periodic_runs(df.select("*", df.text.alias("runs"), df.lang.alias("collapsed"))))
    plain = lambda i, t: digest(None, t)[1:]
    want = [(r[0], *plain(*r[:2])) for r in rows + extra if r[0] != 900]
    key = lambda r: (r[0] is None, r[0] or 0, r[-1])
    out = sorted(map(tuple, got.collect()), key=key)
    assert [r for r in out if r[0] != 900] == sorted(want, key=key)
    assert [r[1:6] for r in out if r[0] == 900] == [(1, 0, 50000, 1, 50000000)]
    full = {r.doc_id: r for r in R.periodic_runs(df).collect()}
    assert full[902].collapsed == "p q" and [tuple(x) for x in full[902].runs] == [(0, 19, 2)] and full[902].n_words == 19
    assert full[310].collapsed == "" and full[310].runs == [] and R.periodic_runs(no_docs).count() == 0
    long = {r.doc_id: r for r in R.periodic_runs(docs.filter("doc_id in (300, 301)")).collect()}
    assert long[300].n_words == 30000 and long[301].n_words == 30001


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, QUERIES["op12_periodic_runs"](spark, SF).collect()))
    assert got == sorted(digest(r.doc_id, r.text) for r in docs)
    assert any(r[1] for r in got)
