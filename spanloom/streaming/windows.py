"""Overlapping windows over a signal that arrives as a stream, each with context on both sides and a state that is carried on.

A window owns ``step`` rows of a key and reads ``back`` rows before them and ``ahead`` after. It is worked on as soon as all it reads has
come, in whatever order; what no later window reads is dropped. The last window takes what is left and is padded with silence. The state
that a window leaves is handed to the next one, so a key's windows are worked on in order, keys side by side. A key keeps the rows of one
window, what has come early, and its carried value.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Setting and provider of the state store that such processors need.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class CarriedWindows(StatefulProcessor):
    """Rows (arrays pos and value, n) of a key, n the number of all its values, become windows: number, bounds, total with context, padding, and carried.

    ``carried`` is what the windows before leave: half of what was carried before them, rounded down, and their own rows' sum. A key that is
    idle for ``idle_ms`` of event time is closed: what is missing counts as silence.
    """

    def __init__(self, step: int, back: int, ahead: int, pad: int, idle_ms: int):
        self.step, self.back, self.ahead, self.pad, self.idle_ms = step, back, ahead, pad, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", "window long, carried long, n long")
        self.rows = handle.getMapState("rows", "pos long", "value long")

    def _windows(self, pos: np.ndarray, value: np.ndarray, window: int, carried: int, n: int, closing: bool) -> tuple[pd.DataFrame, int, int, bool]:
        """The windows whose rows are all there (or all that are left), the next one's number, what it is handed, and whether the key is done.

        Places ascend, from the first that ``window`` reads on. Sums are differences of running ones, so each row is read once.
        """
        begin = max(0, window * self.step - self.back)
        gaps = np.flatnonzero(pos != begin + np.arange(len(pos)))
        known = begin + int(gaps[0] if len(gaps) else len(pos))
        last = max(0, -((self.ahead + self.step - n) // self.step))
        ready = last + 1 if closing or known >= n else min(last, (known - self.ahead) // self.step)
        k = np.arange(window, max(window, ready))
        first = k * self.step
        end = np.where(k == last, n, first + self.step)
        sums = np.concatenate([[0], np.cumsum(value)])
        between = lambda low, high: sums[np.searchsorted(pos, high)] - sums[np.searchsorted(pos, low)]
        total = between(np.maximum(0, first - self.back), np.where(k == last, n, end + self.ahead))
        *handed, carried = accumulate(between(first, end).tolist(), lambda c, own: c // 2 + own, initial=carried)
        done = pd.DataFrame({"window": k, "start": first, "end": end, "total": total, "padded": np.where(k == last, self.pad, 0), "carried": np.array(handed, dtype=np.int64)})
        return done, max(window, ready), carried, ready > last

    def _advance(self, key: tuple, pos: np.ndarray, value: np.ndarray, n: int | None, closing: bool) -> pd.DataFrame:
        window, carried, known = self.progress.get() if self.progress.exists() else (0, 0, n)
        n = known if n is None else n
        if known < 0:  # rows that come again say nothing
            self.progress.update((window, carried, -1))
            return pd.DataFrame(columns=["key", "window", "start", "end", "total", "padded", "carried"])
        before = {k[0]: v[0] for k, v in self.rows.iterator()}
        pos = np.concatenate([np.fromiter(before.keys(), np.int64, len(before)), pos])
        value = np.concatenate([np.fromiter(before.values(), np.int64, len(before)), value])
        order = np.argsort(pos, kind="stable")
        pos, value = pos[order], value[order]
        newest = np.append(pos[1:] != pos[:-1], True)[: len(pos)] & (pos >= window * self.step - self.back)
        pos, value = pos[newest], value[newest]
        done, window, carried, ended = self._windows(pos, value, window, carried, n, closing)
        if ended:
            self.rows.clear()
            self.progress.update((window, carried, -1))
        else:
            needed = pos >= window * self.step - self.back
            left = dict(zip(pos[needed].tolist(), value[needed].tolist(), strict=True))
            for p in before.keys() - left.keys():
                self.rows.removeKey((p,))
            for p in left.keys() - before.keys():
                self.rows.updateValue((p,), (left[p],))
            self.progress.update((window, carried, n))
        done.insert(0, "key", pd.Series([key[0]] * len(done), dtype=object))
        return done

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = list(rows)
        pos, value = (np.concatenate([np.asarray(x, dtype=np.int64) for pdf in parts for x in pdf[c]]) for c in ("pos", "value"))
        n = int(parts[0]["n"].iloc[0])
        out = self._advance(key, pos, value, n, False)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if self.progress.get()[2] >= 0:
            self.handle.registerTimer(int(max(pdf["ts"].max() for pdf in parts).timestamp() * 1000) + self.idle_ms)
        yield out

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        none = np.array([], dtype=np.int64)
        yield self._advance(key, none, none, None, True)

    def close(self) -> None:
        pass


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each key of a batch, with its places and values as arrays: Spark hands rows to stateful processors one by one."""
    for batch in batches:
        one = pa.Table.from_batches([batch]).group_by("key", use_threads=False).aggregate([("pos", "list"), ("value", "list"), ("n", "max"), ("ts", "max")])
        yield from one.select(["key", "pos_list", "value_list", "n_max", "ts_max"]).rename_columns(["key", "pos", "value", "n", "ts"]).to_batches()


def carried_windows(rows: DataFrame, key: str, step: int, back: int, ahead: int, pad: int, late: str = "1 hour", idle_ms: int = 3_600_000) -> DataFrame:
    """key, window, start, end, total, padded and carried of all windows of a stream of (key, pos, value, n, ts); see ``CarriedWindows``."""
    kind = rows.schema[key].dataType.simpleString()
    own = rows.select(rows[key].alias("key"), "pos", "value", "n", "ts").mapInArrow(_packed, f"key {kind}, pos array<long>, value array<long>, n long, ts timestamp").withWatermark("ts", late)
    schema = f"key {kind}, window long, start long, end long, total long, padded long, carried long"
    found = own.groupBy("key").transformWithStateInPandas(CarriedWindows(step, back, ahead, pad, idle_ms), schema, "append", "eventTime")
    return found.withColumnRenamed("key", key)
