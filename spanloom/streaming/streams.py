"""Streams over events: windows with watermarks, stateful span merging, latest-by-key and work that resumes by key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanloom.sources.files import StageCache


def sessions(events: DataFrame, key: str, time: str, gap: str, late: str) -> DataFrame:
    """Counts by key and session: events up to ``gap`` apart share one. Events later than ``late`` are dropped."""
    window = F.session_window(time, gap)
    return events.withWatermark(time, late).groupBy(key, window.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def tumbling(events: DataFrame, key: str, time: str, length: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts by key and window; sliding if ``slide`` is given."""
    return events.withWatermark(time, late).groupBy(key, F.window(time, length, slide).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def merged_spans(spans: DataFrame, key: str, gap: int) -> DataFrame:
    """Spans [a, b) of each key that arrive in order of ``a``, merged over gaps up to ``gap`` unless a barrier row lies between.

    Rows: key, a, b and ``barrier``. The state of a key is its one open span; a span is sent when a later row closes it. The last
    stays open until its barrier or successor comes.
    """
    kind = spans.schema[key].dataType.simpleString()

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        low, high = state.get if state.exists else (None, None)
        rows = sorted((r for pdf in batches for r in pdf[["a", "b", "barrier"]].itertuples(index=False, name=None)), key=lambda r: (r[0], r[1]))
        done = []
        for a, b, barrier in rows:
            if low is not None and (barrier or a - high > gap):
                done.append((keys[0], low, high))
                low = high = None
            if not barrier:
                low, high = (a, b) if low is None else (low, max(high, b))
        if low is not None:
            state.update((int(low), int(high)))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(done, columns=[key, "a", "b"])

    return spans.select(key, "a", "b", "barrier").groupBy(key).applyInPandasWithState(step, f"{key} {kind}, a bigint, b bigint", "a bigint, b bigint", "append", GroupStateTimeout.NoTimeout)


def latest(changes: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The current value of each key of a revision log; run in update or complete mode."""
    return changes.groupBy(key).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))


def resumable(cache: StageCache, stage: str, work: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that does the work for keys without a result and stores it: a repeated batch adds nothing."""
    def batch(rows: DataFrame, _: int) -> None:
        cache.add(stage, work(cache.missing(stage, rows.dropDuplicates(["key_sha"]))))

    return batch
