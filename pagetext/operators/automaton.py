"""A multi-pattern automaton in flat arrays: all terms of a bounded part of a glossary, found in one pass over each text.

States and bytes index one table of next states, so a step is a single look-up whatever the terms have in common. The bytes of
a batch are cut into lanes that step together; lanes overlap by the longest term less one byte. UTF-8 can be matched byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LANES, LANE = 4096, 256  # lanes at most, bytes of a lane at least
STRETCH = 1 << 22  # bytes of text scanned at a time
HITS = 1 << 20  # hits held before they are reduced to one per text and state


@dataclass
class Automaton:
    """``step[state * classes + class]`` is the next state; states from ``ending`` on end a term themselves or by a suffix."""

    classes: int
    of_byte: np.ndarray  # class of every byte, 0 for bytes of no term
    step: np.ndarray
    ending: int
    term: np.ndarray  # term that ends at a state, -1 for none
    shorter: np.ndarray  # longest proper suffix state that ends a term, 0 for none
    longest: int


def build_automaton(terms: Sequence[bytes]) -> Automaton:
    """The automaton of distinct, non-empty terms; the table has (bytes of all terms + 1) * (distinct bytes + 1) cells at most."""
    of_byte = np.zeros(256, np.uint8 if len(set(b"".join(terms))) < 256 else np.uint16)
    used = sorted(set(b"".join(terms)))
    of_byte[used] = np.arange(1, len(used) + 1)
    classes = len(used) + 1
    child: dict[int, int] = {}
    parent, letter, depth, ends = [0], [0], [0], [-1]
    code = of_byte.tolist()
    for number, t in enumerate(terms):
        at = 0
        for b in t:
            key = at * classes + code[b]
            nxt = child.get(key)
            if nxt is None:
                nxt = child[key] = len(parent)
                parent.append(at)
                letter.append(code[b])
                depth.append(depth[at] + 1)
                ends.append(-1)
            at = nxt
        ends[at] = number
    parent, letter, depth, term = (np.array(x, np.int64) for x in (parent, letter, depth, ends))
    states = len(parent)
    step = np.zeros((states, classes), np.int32)
    fail, shorter = np.zeros(states, np.int64), np.zeros(states, np.int64)
    order = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[order], np.arange(depth.max() + 2))
    step[0, letter[order[cuts[1]:cuts[2]]] if states > 1 else []] = order[cuts[1]:cuts[2]] if states > 1 else []
    for d in range(1, len(cuts) - 1):
        level = order[cuts[d]:cuts[d + 1]]
        if d > 1:
            fail[level] = step[fail[parent[level]], letter[level]]
        step[level] = step[fail[level]]
        below = order[cuts[d + 1]:cuts[d + 2]] if d + 2 < len(cuts) else order[:0]
        step[parent[below], letter[below]] = below
        f = fail[level]
        shorter[level] = np.where(term[f] >= 0, f, shorter[f])
    # states that end a term get the highest numbers
    ending = (term >= 0) | (shorter > 0)
    new = np.empty(states, np.int64)
    ranked = np.argsort(ending, kind="stable")
    new[ranked] = np.arange(states)
    return Automaton(classes, of_byte, new[step[ranked]].astype(np.int32).reshape(-1), int(states - ending.sum()), term[ranked], new[shorter[ranked]], max(map(len, terms), default=1))


def scan_texts(auto: Automaton, values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) for every term in every text, once each; ``values`` are the bytes of all texts, cut at ``offsets``."""
    size, states = len(values), len(auto.term)
    if not size or auto.ending == states:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lanes = int(np.clip(size // max(LANE, 8 * auto.longest), 1, LANES))
    length = -(-size // lanes)
    steps = length + auto.longest - 1
    padded = np.zeros(lanes * length + auto.longest, auto.of_byte.dtype)
    padded[:size] = auto.of_byte[values]
    inside = np.ones(len(padded), np.int32)
    inside[offsets[:-1][offsets[:-1] < size]] = 0  # a text begins at the root
    across = lambda x: np.ascontiguousarray(np.lib.stride_tricks.as_strided(x, (steps, lanes), (x.itemsize, x.itemsize * length)))
    letters, inside = across(padded).astype(np.int32), across(inside)
    state = np.zeros(lanes, np.int32)
    found, held, out = [], 0, np.zeros(0, np.int64)

    def reduced() -> np.ndarray:
        where, what = (np.concatenate(x) for x in zip(*found))
        return np.unique(np.concatenate([out, (np.searchsorted(offsets, where, side="right") - 1) * states + what]))

    for t in range(steps):
        state *= inside[t]
        state *= auto.classes
        state += letters[t]
        state = auto.step[state]
        hit = np.flatnonzero(state >= auto.ending)
        if len(hit):
            found.append((hit * length + t, state[hit]))
            held += len(hit)
            if held > HITS:
                out, found, held = reduced(), [], 0
    pairs = reduced() if found else out
    text, at = pairs // states, pairs % states
    texts, terms = [], []
    while len(text):
        own = auto.term[at] >= 0
        texts.append(text[own])
        terms.append(auto.term[at[own]])
        at = auto.shorter[at]
        left = np.unique((text * states + at)[at > 0])
        text, at = left // states, left % states
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = max(len(offsets), 1)
    both = np.unique(np.concatenate(terms) * n + np.concatenate(texts))
    return both % n, both // n


def entries_in(texts: pa.Array, auto: Automaton, entries: tuple[np.ndarray, np.ndarray], always: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, entry) for the entries of the terms found in each text. ``entries``: all entries by term, and where each term's begin;
    ``always``: entries of empty terms, which every text holds."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    col = pc.cast(texts, pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    values = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    numbers, begin = entries
    part = (offsets[:-1] - offsets[0]) // STRETCH if len(col) else offsets[:0]
    for p in np.unique(part):
        rows = np.flatnonzero(part == p)
        a, b = rows[0], rows[-1] + 1
        row, term = scan_texts(auto, values[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
        many = begin[term + 1] - begin[term]
        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin[term], many)
        yield np.concatenate([np.repeat(row, many) + a, np.repeat(rows, len(always))]), np.concatenate([numbers[place], np.tile(always, len(rows))])
