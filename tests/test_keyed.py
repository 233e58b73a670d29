"""Rows of one key in a micro-batch come in order without being held together."""

import json
import random
import tracemalloc
from types import SimpleNamespace

from pyspark.sql import Row

from pagetext.streaming import keyed as K


def test_rows_in_order_across_runs():
    rng = random.Random(3)
    rows = [Row(seq=rng.randrange(500), piece=None if k % 7 == 0 else f"p{k}") for k in range(2345)]
    key = lambda r: (r.seq,)
    for size in (0, 99, 100, 101, 2345):
        assert list(K.by_place(iter(rows[:size]), key, run=100, piece=7)) == sorted(rows[:size], key=key)


def test_fold_of_a_large_key_holds_few_rows():
    saved = []
    fold = K.OrderedFold(lambda s, key, r: ((s or 0) + 1, None), lambda r: (r.seq,), ["n"])
    fold.value = SimpleNamespace(exists=lambda: False, get=lambda: None, update=saved.append)
    rows = (Row(seq=(k * 7919) % 200_003, piece="x" * 40 + str(k)) for k in range(200_003))
    tracemalloc.start()
    assert list(fold.handleInputRows((1,), rows, None)) == []
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert json.loads(saved[-1][0])[:2] == [200_003, [200_002]]
    assert peak < 40e6  # 28 MB at any number; all rows at once take 147 MB
