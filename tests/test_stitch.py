"""Short islands are stitched as long ones are."""

import random
from collections import namedtuple

from pagetext.operators import merge

Box = namedtuple("Box", "page island x1 y1 x2 y2")


def test_short_islands_are_stitched_alike(monkeypatch):
    rng, islands = random.Random(8), []
    for n in range(600):
        corner = [(rng.randrange(40), rng.randrange(60)) for _ in range(2 + n % 14)]
        islands.append(sorted((Box(1, n, x, y, x + rng.randrange(-1, 40), y + rng.randrange(-1, 40)) for x, y in corner), key=lambda r: r.y1))
    fold = merge._stitcher(15.0, 0.85, 0.5, 0.1)
    short = [fold(i) for i in islands]
    monkeypatch.setattr(merge, "ONE_BY_ONE", 0)
    assert short == [fold(i) for i in islands]
    assert sum(map(len, short)) < sum(map(len, islands)) - 500
