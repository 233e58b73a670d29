"""Ordered folds over keyed streams with ``transformWithState``: one small saved value a key, late rows and expiry defined."""

from __future__ import annotations

import heapq
import json
import pickle
import tempfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RUN, PIECE = 20_000, 200  # rows sorted at a time, and rows of each sorted run that are held while the runs are merged


@contextmanager
def keyed_state_store(spark: SparkSession) -> Iterator[None]:
    """Keyed state lives in RocksDB; the setting in force before comes back afterwards. A query keeps the one it was started with."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def by_place(rows: Iterable[Row], place: Callable, run: int = RUN, piece: int = PIECE) -> Iterator[Row]:
    """The rows of a key by ``place``, in a memory that does not grow with their number: beyond ``run`` rows, sorted runs go to a temporary file of the task."""
    rows = iter(rows)
    part = sorted(islice(rows, run), key=place)
    if len(part) < run:
        yield from part
        return
    made = Row(*part[0].__fields__)
    with tempfile.TemporaryFile() as file:
        runs = []
        while part:
            starts = []
            for k in range(0, len(part), piece):
                starts.append(file.tell())
                pickle.dump([tuple(r) for r in part[k:k + piece]], file)
            runs.append(starts)
            part = sorted(islice(rows, run), key=place)

        def read(starts: list[int]) -> Iterator[Row]:
            for at in starts:
                file.seek(at)
                for values in pickle.load(file):
                    yield made(*values)

        yield from heapq.merge(*map(read, runs), key=place)


class OrderedFold(StatefulProcessor):
    """``step(saved, key, row) -> (saved, output or None)`` over the rows of a key by ``place(row)``, from one micro-batch to the next.

    A row at or before the last place handled came too late and is left out. The saved value is JSON. With ``at`` (the
    event time of a row in milliseconds) so does a row behind the watermark, and a key whose last row lies ``idle_ms`` behind the watermark is forgotten.
    """

    def __init__(self, step: Callable, place: Callable, names: list[str], at: Callable | None = None, idle_ms: int = 0):
        self.step, self.place, self.names, self.at, self.idle_ms = step, place, names, at, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("fold", "saved string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        saved, last, timer = json.loads(self.value.get()[0]) if self.value.exists() else (None, None, None)
        out = Row(*self.names)
        seen, passed = -1, 0 if self.at is None else timerValues.getCurrentWatermarkInMs()
        for r in by_place(rows, self.place):
            place = list(self.place(r))
            if (last is not None and place <= last) or (passed > 0 and self.at(r) < passed):
                continue
            saved, made = self.step(saved, key, r)
            last = place
            if self.at is not None:
                seen = max(seen, self.at(r))
            if made is not None:
                yield out(*made)
        if seen >= 0:
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = max(timer or 0, seen + self.idle_ms)
            self.handle.registerTimer(timer)
        self.value.update((json.dumps([saved, last, timer]),))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.value.clear()
        yield from ()

    def close(self) -> None:
        pass


def fold_stream(df: DataFrame, keys: list[str], step: Callable, place: Callable, schema: str, time: str | None = None, delay: str = "0 seconds", idle_ms: int = 0) -> DataFrame:
    """Rows that ``step`` makes of the stream, key by key in the order of ``place``.

    Only the rows of one key in one micro-batch are sorted, in the task of that key and in runs of bounded size; limit them by the source
    (``maxFilesPerTrigger``, ``maxBytesPerTrigger``). With ``time`` rows more than ``delay`` behind the watermark are late as well, and a key is forgotten
    ``idle_ms`` after its last row; without it a key's small value is kept.
    """
    names = [c.strip().split()[0] for c in schema.split(",")]
    if time is None:
        fold = OrderedFold(step, place, names)
        return df.groupBy(*keys).transformWithState(fold, schema, "append", "none")
    d = df.withWatermark(time, delay).withColumn("__at", F.unix_millis(time))
    fold = OrderedFold(step, place, names, lambda r: r["__at"], idle_ms)
    return d.groupBy(*keys).transformWithState(fold, schema, "append", "eventTime")
