"""Byte-level BPE: ranked merges folded over the bytes of distinct words; decoding concatenates the tokens' bytes.

``encode_words`` is the fold in higher-order functions with a literal rank map. ``encode_documents`` runs the same fold in numpy
inside Arrow tasks: all distinct words of a stretch of documents merge their lowest pair at once.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

NONE = np.iinfo(np.int32).max
LONG = 48  # bytes; a longer word is folded on its own with a heap, so its cost stays near linear
STRETCH = 1 << 20  # characters of text whose distinct words are folded together
KEPT = 300_000  # distinct words remembered by a task
PIECES = 1 << 16  # words of one text taken at a time


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank file: one base64 token and its rank a line. Read on the driver; tasks get the ranks by broadcast."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Merges:
    """Ranks of neighbouring tokens: the rank of their joined bytes, wherever that is a token itself."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {r: b for b, r in ranks.items()}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for b, r in ranks.items():
            for i in range(1, len(b)):
                left, right = ranks.get(b[:i]), ranks.get(b[i:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = r
        keys = np.fromiter(pairs, np.int64, len(pairs))
        by = np.argsort(keys)
        self.keys, self.vals = keys[by], np.fromiter(pairs.values(), np.int32, len(pairs))[by]
        self.pairs = pairs

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(left.shape, NONE, np.int32)
        key = left << 32 | right
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[i] == key) & (left >= 0) & (right >= 0), self.vals[i], NONE)

    def fold(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word: the lowest-ranked pair merges first, of equal ones the leftmost."""
        out: list[list[int]] = [[] for _ in words]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for low, high in ((0, 1), (1, 8), (8, 16), (16, LONG)):
            pick = np.flatnonzero((sizes > low) & (sizes <= high))
            for at in range(0, len(pick), 1 << 15):
                part = pick[at:at + (1 << 15)]
                rows = self._fold_rows([words[i] for i in part], high)
                for i, row in zip(part.tolist(), rows):
                    out[i] = row
        for i in np.flatnonzero(sizes > LONG).tolist():
            out[i] = self._fold_long(words[i])
        return out

    def _fold_rows(self, words: list[bytes], width: int) -> list[list[int]]:
        n = np.fromiter(map(len, words), np.int64, len(words))
        cols = np.arange(width)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
        tok = np.where(cols < n[:, None], self.byte[raw], -1)
        done = tok.copy()
        open_rows = np.arange(len(words))
        rank = self.rank(tok[:, :-1], tok[:, 1:]) if width > 1 else np.zeros((len(words), 0), np.int32)
        while rank.shape[1] and len(open_rows):
            j = rank.argmin(axis=1)
            r = rank[np.arange(len(j)), j]
            end = r == NONE
            done[open_rows[end]] = tok[end]
            go = ~end
            open_rows, tok, rank, j, r = open_rows[go], tok[go], rank[go], j[go], r[go]
            rows = np.arange(len(j))
            shifted = np.concatenate([tok[:, 1:], np.full((len(j), 1), -1)], axis=1)
            tok = np.where(cols <= j[:, None], tok, shifted)
            tok[rows, j] = r
            moved = np.concatenate([rank[:, 1:], np.full((len(j), 1), NONE, np.int32)], axis=1)
            rank = np.where(cols[:-1] < j[:, None], rank, moved)
            right = np.where(j + 1 < width, tok[rows, np.minimum(j + 1, width - 1)], -1)
            inner = j < width - 1
            rank[rows[inner], j[inner]] = self.rank(tok[rows, j], right)[inner]
            left = j > 0
            rank[rows[left], j[left] - 1] = self.rank(tok[rows[left], j[left] - 1], tok[rows[left], j[left]])
        return [row[row >= 0].tolist() for row in done]

    def _fold_long(self, word: bytes) -> list[int]:
        tok = self.byte[np.frombuffer(word, np.uint8)].tolist()
        n = len(tok)
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs, gone = self.pairs, [False] * n
        heap = [(r, i, tok[i], tok[i + 1]) for i in range(n - 1) if (r := pairs.get(tok[i] << 32 | tok[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            k = nxt[i]
            if gone[i] or k >= n or tok[i] != a or tok[k] != b:
                continue
            tok[i], gone[k], nxt[i] = r, True, nxt[k]
            if nxt[i] < n:
                prev[nxt[i]] = i
            for x, y in ((prev[i], i), (i, nxt[i])):
                if x >= 0 and y < n and (q := pairs.get(tok[x] << 32 | tok[y])) is not None:
                    heapq.heappush(heap, (q, x, tok[x], tok[y]))
        return [t for t, out in zip(tok, gone) if not out]


def _pieces(text: str, pattern) -> Iterator[list[str]]:
    if len(text) <= PIECES:
        yield pattern.findall(text)
        return
    found = (m.group() for m in pattern.finditer(text))
    while part := list(islice(found, PIECES)):
        yield part


class Encoder:
    """Encodes texts of one task; remembers the distinct words it has folded, up to a bound.

    ``known`` tells of a word how many ids it has, their decimal text, their bytes and the ids, in one look-up.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.merges, self.pattern = Merges(ranks), regex.compile(pattern)
        self.known: dict[str, tuple[int, bytes, bytes, tuple[int, ...]]] = {}

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > KEPT:
            self.known.clear()
            new = list(words)
        token = self.merges.bytes
        for w, ids in zip(new, self.merges.fold([w.encode() for w in new])):
            self.known[w] = (len(ids), ",".join(map(str, ids)).encode(), b"".join([token[i] for i in ids]), tuple(ids))

    def tokens(self, texts: list[str]) -> Iterator[Iterator[list[tuple]]]:
        """For each text, what is known of its words, in blocks."""
        at = 0
        while at < len(texts):
            to, room = at, STRETCH
            while to < len(texts) and (to == at or len(texts[to]) <= room):
                room -= len(texts[to])
                to += 1
            if to - at == 1 and len(texts[at]) > STRETCH:  # a very long text goes block by block
                yield self._blocks(texts[at])
            else:
                found = [[w for part in _pieces(t, self.pattern) for w in part] for t in texts[at:to]]
                self.learn(set().union(*found))
                for words in found:
                    yield iter([list(map(self.known.__getitem__, words))])
            at = to

    def _blocks(self, text: str) -> Iterator[list[tuple]]:
        for words in _pieces(text, self.pattern):
            self.learn(set(words))
            yield list(map(self.known.__getitem__, words))


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ``ids`` (array of int) of every whole text; null counts as empty, an empty text has no ids.

    Repeated rows are encoded each; further columns are ignored. There are no special tokens.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # the fixed vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(shared.value, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                out = [np.fromiter((i for block in blocks for w in block for i in w[3]), np.int32) for blocks in enc.tokens(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded`` (binary): the bytes of its ids, put together in order; null ids give null."""
    flat = [b"" for _ in range(max(ranks.values(), default=-1) + 1)]
    for b, r in ranks.items():
        flat[r] = b
    shared = encoded.sparkSession.sparkContext.broadcast(flat)
    schema = StructType([*encoded.schema.fields, StructField("decoded", BinaryType())])
    place = encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in batches:
            out = [None if x is None else b"".join([table[i] for i in x]) for x in b.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=schema.names)

    return encoded.mapInArrow(run, schema)


def digest_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids (decimal, joined by commas) and of the decoded bytes of every whole text.

    The same encoding as ``encode_documents``, but ids and decoded bytes are fed to the digests as they come, so a very long text is never
    held twice. Null counts as empty. ``with_ids`` adds the ids themselves, as encoding and decoding in one pass over the texts.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = StructType([d.schema["doc_id"], StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType()),
                         *([StructField("ids", ArrayType(IntegerType()))] if with_ids else [])])
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(shared.value, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = []
                for blocks in enc.tokens(part.column(1).to_pylist()):
                    n, ids, back, flat = 0, hashlib.sha256(), hashlib.sha256(), []
                    for block in filter(None, blocks):
                        count, said, raw, listed = zip(*block)
                        ids.update((b"," if n else b"") + b",".join(said))
                        back.update(b"".join(raw))
                        n += sum(count)
                        if with_ids:
                            flat.append(np.fromiter(chain.from_iterable(listed), np.int32))
                    rows.append((n, ids.hexdigest(), back.hexdigest(), np.concatenate(flat) if flat else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows]),
                                                  *([pa.array([r[3] for r in rows], pa.list_(pa.int32()))] if with_ids else [])], names=schema.names)

    return d.mapInArrow(run, schema)


def _bucket(hexed: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(hexed.cast("binary")), F.lit(buckets)).cast("int")


def _rank_map(ranks: dict[bytes, int], buckets: int) -> Column:
    """The ranks as one literal: an array of small maps from hexadecimal bytes to the rank, chosen by the crc32 of the key.

    A map literal is searched entry by entry, so a single map of the vocabulary would cost its size on every look-up.
    """
    table: list[dict[str, int]] = [{} for _ in range(buckets)]
    for b, r in ranks.items():
        h = b.hex().upper()
        table[zlib.crc32(h.encode()) % buckets][h] = r
    return F.from_json(F.lit(json.dumps(table)), "array<map<string,int>>")


def encode_words(words: DataFrame, ranks: dict[bytes, int], word: str = "word", buckets: int = 1 << 14) -> DataFrame:
    """``words`` (distinct words, one a row) with ``ids``: ranked merges folded over the bytes with higher-order functions only.

    Each step of the fold merges the neighbouring pieces whose joined bytes have the lowest rank, of equal ones the leftmost; a word of n bytes
    takes at most n - 1 steps. Null gives null.
    """
    table = _rank_map(ranks, buckets)
    rank = lambda h: F.element_at(F.element_at(table, _bucket(h, buckets) + 1), h)
    hexed = F.hex(F.col(word).cast("binary"))
    n = (F.length(hexed) / 2).cast("int")
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(hexed, i * 2 - 1, F.lit(2)))
    start = F.struct(pieces.alias("p"), F.lit(0).alias("at"))

    def step(s: Column, _: Column) -> Column:
        p = s["p"]
        joined = F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: F.concat(a, b))
        best = F.array_min(F.filter(F.transform(joined, lambda h, i: F.struct(rank(h).alias("r"), i.alias("i"))), lambda x: x["r"].isNotNull()))["i"]
        merged = F.concat(F.slice(p, 1, best), F.array(F.concat(F.element_at(p, best + 1), F.element_at(p, best + 2))), F.slice(p, best + 3, F.size(p)))
        # Once nothing merges, the state passes through unchanged.
        return F.when((s["at"] < 0) | (F.size(p) < 2), s).otherwise(F.when(best.isNull(), F.struct(p.alias("p"), F.lit(-1).alias("at"))).otherwise(F.struct(merged.alias("p"), F.lit(0).alias("at"))))

    done = F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), start, step, lambda s: s["p"])
    return words.withColumn("ids", F.when(n == 0, F.array().cast("array<int>")).when(n > 0, F.transform(done, rank)))


def decode_words(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded`` (binary): the hexadecimal pieces of the ids, looked up in a literal array and concatenated."""
    flat = [""] * (max(ranks.values(), default=-1) + 1)
    for b, r in ranks.items():
        flat[r] = b.hex()
    table = F.from_json(F.lit(json.dumps(flat)), "array<string>")
    return encoded.withColumn("decoded", F.unhex(F.array_join(F.transform(ids, lambda i: F.element_at(table, i + 1)), "")))
