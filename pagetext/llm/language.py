"""Language identification: a linear-chain conditional random field labels every word, forward-backward gives the shares.

The features of a word are its character bigrams and trigrams with word ends (so also its affixes of one and two letters),
its affixes of three letters, and a lexicon of the sampled words. Transitions are learned on code-switched
sequences made of segments of the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from pagetext.llm.common import WORD, id_fold, id_key, stored

HASHED = 1 << 16  # rows of the weight table; one more row of zeros stands for "no feature"
CELLS = 1 << 23  # words times languages of a sample: with more than 12 languages it takes fewer documents of each
LEAST = 12  # stretches of each language that are sampled, however many there are
CHAIN = 1 << 11  # words of one chain; a longer text is several chains, so that memory stays bounded
CHUNK = 2 << 20  # characters of text labelled together
_M = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _M
    return x ^ (x >> np.uint64(29))


@dataclass
class Words:
    """Feature places of distinct words; ``at`` starts each word's stretch of characters."""

    at: np.ndarray
    lens: np.ndarray
    bi: np.ndarray
    tri: np.ndarray
    head: np.ndarray
    tail: np.ndarray
    key: np.ndarray


def table_size(langs: int) -> int:
    """Rows of the weight table: halved whenever the languages double beyond 64."""
    return max(1 << 10, HASHED >> max(0, (langs - 1).bit_length() - 6))


def sample_size(langs: int, docs: int, segments: int, segment: int) -> tuple[int, int]:
    """Documents of each language and stretches of each document: all that was asked for as long as the sample fits ``CELLS``, and ``LEAST`` stretches at least."""
    room = max(LEAST, CELLS // (max(1, segment) * max(1, langs) ** 2))
    docs = min(docs, max(LEAST, room // max(1, segments)))
    return docs, min(segments, max(1, room // docs))


def featurise(words: list[str], size: int | None = None) -> Words:
    hashed = size or HASHED
    codes = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lens = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    at = np.cumsum(lens) - lens
    end = at + lens
    place = lambda h: (h % np.uint64(hashed)).astype(np.int32)
    nxt, third = np.append(codes[1:], np.zeros(1, np.uint64)), np.append(codes[2:], np.zeros(2, np.uint64))
    two = _mixed(codes * np.uint64(1 << 21) + nxt)
    bi, tri = place(two), place(_mixed(two ^ (third + np.uint64(7))))
    bi[end - 1] = hashed
    tri[end - 1] = hashed
    tri[np.maximum(end - 2, at)] = hashed
    four = lambda i: np.where(lens >= 5, place(_mixed(two[i] * np.uint64(3) ^ two[np.minimum(i + 2, len(codes) - 1)])), hashed)
    inside = np.arange(len(codes)) - np.repeat(at, lens)
    powers = np.cumprod(np.full(int(lens.max(initial=1)), 0x100000001B3, np.uint64))
    key = _mixed(np.add.reduceat((codes + np.uint64(1)) * powers[inside], at)) if len(words) else np.zeros(0, np.uint64)
    return Words(at, lens, bi, tri, four(at), four(end - 4), key)


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # (table size + 1, languages)
    lex_key: np.ndarray  # sorted keys of the lexicon
    lex: np.ndarray  # log share of each language
    lex_weight: float
    start: np.ndarray
    step: np.ndarray

    def lexicon(self, w: Words) -> np.ndarray:
        out = np.zeros((len(w.key), len(self.langs)))
        if len(self.lex_key):
            i = np.minimum(np.searchsorted(self.lex_key, w.key), len(self.lex_key) - 1)
            hit = self.lex_key[i] == w.key
            out[hit] = self.lex[i[hit]]
        return out

    def emissions(self, w: Words, lex: np.ndarray | None = None) -> np.ndarray:
        sums = np.add.reduceat(self.weights[w.bi] + self.weights[w.tri], w.at, axis=0)
        return sums + self.weights[w.head] + self.weights[w.tail] + self.lex_weight * (self.lexicon(w) if lex is None else lex)


def forward_backward(em: np.ndarray, lens: np.ndarray, start: np.ndarray, step: np.ndarray, moves: bool = False):
    """Posteriors of every word (chains one after the other in ``em``); with ``moves`` also expected starts and steps.

    All chains advance together; a chain drops out at its end, so the cost is the number of words.
    """
    order = np.argsort(-lens, kind="stable")
    n, first = lens[order], (np.cumsum(lens) - lens)[order]
    e = np.exp(em - em.max(axis=1, keepdims=True))
    live = np.searchsorted(-n, -np.arange(1, (n[0] if len(n) else 0) + 1), side="right")
    a, b = np.empty_like(e), np.ones_like(e)
    t_mat = np.exp(step - step.max())
    for t, k in enumerate(live):
        i = first[:k] + t
        x = e[i] * (np.exp(start - start.max()) if t == 0 else a[i - 1] @ t_mat)
        a[i] = x / x.sum(axis=1, keepdims=True)
    total = np.zeros_like(step)
    for t in range(len(live) - 2, -1, -1):
        i = first[:live[t + 1]] + t
        right = e[i + 1] * b[i + 1]
        x = right @ t_mat.T
        b[i] = x / x.sum(axis=1, keepdims=True)
        if moves:
            share = a[i] / (x * a[i]).sum(axis=1, keepdims=True)  # without a table of pairs for each chain
            total += t_mat * (share.T @ right)
    post = a * b
    post /= post.sum(axis=1, keepdims=True)
    return (post, post[first[n > 0]].sum(axis=0), total) if moves else post


def train(segments: list[tuple[str, list[str]]], rounds: int = 30, rate: float = 0.3, decay: float = 1e-4, seed: int = 7) -> Model:
    """Maximise the likelihood of code-switched sequences (one to three segments each) by full-batch AdaGrad."""
    langs = sorted({s[0] for s in segments})
    number = {x: i for i, x in enumerate(langs)}
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(segments))
    ids: dict[str, int] = {}
    tokens, labels, lens, k = [], [], [], 0
    while k < len(order):
        group = order[k:k + int(rng.integers(1, 4))]
        k += len(group)
        for s in group:
            tokens += [ids.setdefault(w, len(ids)) for w in segments[s][1]]
            labels += [number[segments[s][0]]] * len(segments[s][1])
        lens.append(sum(len(segments[s][1]) for s in group))
    tok, lab, n = np.array(tokens, np.int64), np.array(labels, np.int64), np.array(lens, np.int64)
    size, rows = len(langs), table_size(len(langs))
    words = featurise(list(ids), rows)
    seen = np.bincount(tok * size + lab, minlength=len(ids) * size).reshape(-1, size).astype(float)
    share = np.log((seen + 0.5) / (seen.sum(axis=1, keepdims=True) + 0.5 * size))
    by_key = np.argsort(words.key)
    m = Model(langs, np.zeros((rows + 1, size)), words.key[by_key], share[by_key], 0.0, np.zeros(size), np.zeros((size, size)))
    # While training, a word's own occurrence is left out of its lexicon entry; else the lexicon would explain everything.
    held = np.log((seen[tok] - np.eye(size)[lab] + 0.5) / (seen[tok].sum(axis=1, keepdims=True) - 1 + 0.5 * size))
    first = np.cumsum(n) - n
    inner = np.ones(len(tok), bool)
    inner[first] = False
    true_steps = np.bincount(lab[np.flatnonzero(inner) - 1] * size + lab[inner], minlength=size * size).reshape(size, size)
    true_start = np.bincount(lab[first], minlength=size)
    squares = {"w": np.full_like(m.weights, 1e-6), "t": np.full((size, size), 1e-6), "s": np.full(size, 1e-6), "l": 1e-6}
    none = np.zeros((len(ids), size))
    for _ in range(rounds):
        em = m.emissions(words, none)[tok] + m.lex_weight * held
        post, starts, steps = forward_backward(em, n, m.start, m.step, moves=True)
        miss = (np.eye(size)[lab] - post) / len(tok)
        per_word = np.stack([np.bincount(tok, miss[:, c], len(ids)) for c in range(size)], axis=1)
        grad = np.zeros_like(m.weights)
        spread = np.repeat(per_word, words.lens, axis=0)
        for c in range(size):
            grad[:, c] = (np.bincount(words.bi, spread[:, c], rows + 1) + np.bincount(words.tri, spread[:, c], rows + 1)
                          + np.bincount(words.head, per_word[:, c], rows + 1) + np.bincount(words.tail, per_word[:, c], rows + 1))
        grad[rows] = 0
        grad -= decay * m.weights / len(tok)
        g_lex = float((miss * held).sum())
        for key, old, g in (("w", m.weights, grad), ("t", m.step, (true_steps - steps) / len(tok)), ("s", m.start, (true_start - starts) / len(n))):
            squares[key] += g * g
            old += rate * g / np.sqrt(squares[key])
        squares["l"] += g_lex * g_lex
        m.lex_weight = max(0.0, m.lex_weight + rate * g_lex / np.sqrt(squares["l"]))
    return m


def fit_language(docs: DataFrame, docs_per_lang: int = 400, segments_per_doc: int = 6, segment: int = 24,
                 doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """Train on a bounded sample of labelled rows (the caller leaves out what must not be learned from).

    Every labelled language is learned. Of each the ``docs_per_lang`` documents with the smallest hash-random keys are
    taken, of each the ``segments_per_doc`` stretches of ``segment`` words with the smallest keys, anywhere in the text; with more than 12 languages fewer
    (``sample_size``), so that memory stays bounded. Keys depend on id and text, and rows equal in both are one document, so the bound also
    holds for rows without an id or with one id. None without labels.
    """
    key = F.md5(F.concat(id_key(F.col(doc_id), "language"), F.lit(":"), F.xxhash64(text).cast("string")).cast("binary"))
    d = docs.select(key.alias("k"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l")).filter("t is not null and l is not null")
    sizes = stored(d.groupBy("l").agg(F.approx_count_distinct("k").alias("n")), "languages")
    docs_per_lang, segments_per_doc = sample_size(sizes.count(), docs_per_lang, segments_per_doc, segment)
    # Keys are even, so of each language about eight times the documents wanted lie below this share of all keys; only they are ranked.
    share = F.conv(F.substring("k", 1, 8), 16, 10).cast("double") / (1 << 32) <= 8.0 * docs_per_lang / F.col("n")
    few = d.select("k", "l").join(sizes, "l").filter(share).select("k", "l").distinct()
    chosen = few.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("k"))).filter(F.col("r") <= docs_per_lang).select("k", "l")
    words = F.regexp_extract_all(F.lower("t"), F.lit(WORD), F.lit(0))
    cut = F.transform(F.sequence(F.lit(0), F.ceil(F.size("w") / segment).cast("int") - 1),
                      lambda i: F.struct(F.md5(F.concat_ws(":", "k", i.cast("string")).cast("binary")).alias("h"), F.slice("w", i * segment + 1, segment).alias("s")))
    rows = (d.join(F.broadcast(chosen), ["k", "l"]).dropDuplicates(["k", "l"]).withColumn("w", words).filter(F.size("w") > 0)
            .select("l", F.explode(F.slice(F.array_sort(cut), 1, segments_per_doc)).alias("x")).select("l", "x.h", "x.s").collect())
    segments = [(r["l"], list(r["s"])) for r in sorted(rows, key=lambda r: (r["l"], r["h"], r["s"]))]
    return train(segments) if segments else None


def _label(texts: list[str | None], m: Model):
    """Per text its words' posteriors: yields (chain owners, chain lengths, posteriors, word has a letter)."""
    ids: dict[str, int] = {}
    tok: list[int] = []
    owner, lens = [], []
    for k, t in enumerate(texts):
        w = t.lower().split() if t else []
        tok += [ids.setdefault(x, len(ids)) for x in w]
        cuts = [min(CHAIN, len(w) - i) for i in range(0, len(w), CHAIN)]
        owner += [k] * len(cuts)
        lens += cuts
    if not tok:
        return None
    words = list(ids)
    letter = np.fromiter((any(map(str.isalpha, w)) for w in words), bool, len(words))
    at = np.array(tok)
    n = np.array(lens)
    post = forward_backward(m.emissions(featurise(words, len(m.weights) - 1))[at], n, m.start, m.step)
    return np.repeat(np.array(owner), n), n, post, letter[at]


def predict(texts: list[str | None], m: Model | None) -> tuple[list[str], list[float]]:
    """Language with the largest expected share of the words with a letter, and that share."""
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    at = 0
    while at < len(texts) and m is not None:
        to, room = at, min(CHUNK, 8 * CHUNK // len(m.langs))
        while to < len(texts) and (to == at or len(texts[to] or "") <= room):
            room -= len(texts[to] or "")
            to += 1
        if (found := _label(texts[at:to], m)) is not None:
            owner, _, post, letter = found
            mass = np.stack([np.bincount(owner[letter], post[letter, c], to - at) for c in range(len(m.langs))], axis=1)
            sums = mass.sum(axis=1)
            for k in np.flatnonzero(sums > 0):
                best = int(mass[k].argmax())
                langs[at + k], scores[at + k] = m.langs[best], float(min(1.0, mass[k, best] / sums[k]))
        at = to
    return langs, scores


def identify_language(docs: DataFrame, model: Model | None, text: str = "text", pred: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """``docs`` with two more columns, ``pred`` and ``score`` (0 to 1), of every whole text; only the text is looked at.

    A null text, or one without a letter, is ``und`` with score 0, as is everything if nothing could be learned.
    Rows pass one by one, so repeated rows and further columns stay as they are; columns already named like the two are replaced.
    """
    docs = docs.drop(pred, score)
    schema = StructType([*docs.schema.fields, StructField(pred, StringType()), StructField(score, DoubleType())])
    place = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most HASHED rows and the sampled words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                found, shares = predict(part.column(place).to_pylist(), m)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string()), pa.array(shares, pa.float64())], names=schema.names)

    return docs.mapInArrow(run, schema)


def label_words(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Runs of words of one language within each text: doc_id, first_word (from 0), n_words, lang, score (mean posterior)."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if (found := _label([t], m)) is None:
                    continue
                post = found[2]
                best = post.argmax(axis=1)
                cut = np.flatnonzero(np.diff(best, prepend=-1))
                size = np.diff(np.append(cut, len(best)))
                mean = np.add.reduceat(post.max(axis=1), cut) / size
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * len(cut), b.column(0).type), pa.array(cut, pa.int64()), pa.array(size, pa.int64()),
                     pa.array([m.langs[x] for x in best[cut]], pa.string()), pa.array(mean, pa.float64())], names=["doc_id", "first_word", "n_words", "lang", "score"])

    return d.mapInArrow(run, f"doc_id {kind}, first_word bigint, n_words bigint, lang string, score double")


def training_rows(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Rows that may be learned from: those whose crc32 of the id, modulo 4, is not 2."""
    return docs.filter(id_fold(F.col(doc_id), 4) != 2)


def keep_identified(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Rows of ``docs`` with a language; those of none (``und``: null texts and texts without a letter) go, whatever the shares of the others."""
    found = identify_language(docs, model, text, "__pred", "__score")
    return found.filter(F.col("__pred") != "und").select(*docs.columns)
