"""Windows with a carried state: whatever the order and the batches, as one walk over the whole signal gives."""

from __future__ import annotations

import random
import time
from datetime import datetime, timedelta
from types import SimpleNamespace

import numpy as np
import pytest

from spanloom.streaming import windows as W

SCHEMA = "rec string, pos long, value long, n long, ts timestamp"
STEP, BACK, AHEAD, PAD = 10, 3, 4, 2


@pytest.fixture(autouse=True)
def store(spark):
    spark.conf.set(*W.PROVIDER)
    yield
    spark.conf.unset(W.PROVIDER[0])


def _plain(values):
    found, carried, k, n = [], 0, 0, len(values)
    while True:
        a = k * STEP
        last = a + STEP + AHEAD >= n
        z, high = (n, n) if last else (a + STEP, a + STEP + AHEAD)
        found.append((k, a, z, sum(values[max(0, a - BACK) : high]), PAD if last else 0, carried))
        carried = carried // 2 + sum(values[a:z])
        k += 1
        if last:
            return found


def _run(spark, tmp_path, batches, name):
    folder = f"{tmp_path}/in"
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    query = W.carried_windows(stream, "rec", STEP, BACK, AHEAD, PAD, "1 minute", 60_000).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination(180)
    found = {}
    for r in spark.table(name).orderBy("rec", "window").collect():
        found.setdefault(r["rec"], []).append(tuple(r)[1:])
    return found


def test_any_order_gives_the_walk(spark, tmp_path):
    rng = random.Random(3)
    t0 = datetime(2024, 1, 1)
    signals = {f"s{n}": [rng.randrange(-50, 100) for _ in range(n)] for n in (1, 13, 14, 15, 47, 100)}
    rows = [(k, i, v, len(x), t0) for k, x in signals.items() for i, v in enumerate(x)]
    rng.shuffle(rows)
    cut = [rows[i::4] for i in range(4)]
    again = rows[:20]  # rows that come twice say nothing new
    assert _run(spark, tmp_path, [*cut, again], "any_order") == {k: _plain(x) for k, x in signals.items()}


def test_an_idle_key_is_closed_with_silence(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    cut_off = [("a", i, 1, 40, t0) for i in range(25)]
    later = [[("b", 0, 5, 1, t0 + timedelta(hours=h))] for h in (1, 2, 3)]
    found = _run(spark, tmp_path, [cut_off, *later], "idle")
    assert found["a"] == _plain([1] * 25 + [0] * 15) and found["b"] == _plain([5])


class _Handle:
    """State that is kept in memory, for a processor on its own."""

    def __init__(self):
        self.value, self.table = None, {}

    def getValueState(self, *_):
        return SimpleNamespace(exists=lambda: self.value is not None, get=lambda: self.value, update=lambda v: setattr(self, "value", v))

    def getMapState(self, *_):
        return SimpleNamespace(iterator=lambda: iter(list(self.table.items())), clear=self.table.clear, removeKey=self.table.pop, updateValue=self.table.__setitem__)


def test_a_long_signal_takes_time_in_proportion():
    """A million values at once, and some that come first: each is read once, where each window used to look through all that were left."""
    rng = np.random.default_rng(5)
    n = 1_000_000
    place, value = rng.permutation(n), rng.integers(-50, 100, n)
    processor = W.CarriedWindows(STEP, BACK, AHEAD, PAD, 60_000)
    handle = _Handle()
    processor.init(handle)
    began = time.process_time()
    found = [processor._advance(("a",), place[part], value[place[part]], n, False) for part in (slice(0, 100), slice(100, n), slice(0, 100))]
    assert time.process_time() - began < 20
    assert [len(f) for f in found[::2]] == [0, 0] and not handle.table
    assert list(found[1].drop(columns="key").itertuples(index=False, name=None)) == _plain(value.tolist())


@pytest.mark.parametrize("seed", range(8))
def test_windows_of_a_processor_in_any_parts(seed):
    rng = np.random.default_rng(seed)
    for n in (1, 4, 9, 13, 14, 15, 24, 25, 60, 200):
        value, place = rng.integers(-50, 100, n), rng.permutation(n)
        processor, handle = W.CarriedWindows(STEP, BACK, AHEAD, PAD, 60_000), _Handle()
        processor.init(handle)
        cut = np.sort(rng.integers(0, n + 1, 3))
        parts = [p for p in np.split(place, cut) if len(p)]
        gone = len(parts) - 1 if rng.random() < 0.5 else len(parts)  # the rest may never come
        found = [processor._advance(("a",), p, value[p], n, False) for p in parts[:gone]]
        heard = np.zeros(n, dtype=np.int64)
        for p in parts[:gone]:
            heard[p] = value[p]
        if gone < len(parts) and gone:
            found.append(processor._advance(("a",), np.array([], dtype=np.int64), np.array([], dtype=np.int64), None, True))
        rows = [r for f in found for r in f.drop(columns="key").itertuples(index=False, name=None)]
        assert rows == (_plain(heard.tolist()) if gone else [])
        assert not handle.table
