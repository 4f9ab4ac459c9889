"""What is reached from given nodes by jumps of one node to one other, in rounds that grow with the logarithm of the longest chain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.plans.scratch import materialise, release


def reached(starts: DataFrame, jumps: DataFrame, keys: Sequence[str], at: str, to: str, within: str = "true") -> DataFrame:
    """``starts`` and all that jumps lead to from there, once each; further columns of ``starts`` go along.

    Starts: keys, ``at`` and any others. Jumps: keys, ``at``, ``to``, one row for a node at most, and without cycles. ``within`` is a
    condition on a reached row beyond which no chain need be followed; as soon as it fails it must fail for all that comes after.
    In each round every jump becomes two of its kind, and what the known nodes jump to is known too. Rounds are written tables.
    """
    others = [c for c in starts.columns if c not in (*keys, at)]
    jumps, scratch = jumps.select(*keys, at, to), []
    while True:
        new = starts.join(jumps, [*keys, at]).select(*keys, F.col(to).alias(at), *others).where(within)
        grown = materialise(starts.select(*keys, at, *others).unionByName(new).distinct(), "reached")
        before, starts = starts, grown
        again = jumps.select(*keys, F.col(at).alias(to), F.col(to).alias("_to"))
        jumps = materialise(jumps.join(again, [*keys, to]).select(*keys, at, F.col("_to").alias(to)), "jumps")
        ended = jumps.isEmpty() or (bool(scratch) and grown.count() == before.count())
        if scratch:
            release(*scratch)
        scratch = [starts, jumps]
        if ended:
            release(jumps)
            return starts
