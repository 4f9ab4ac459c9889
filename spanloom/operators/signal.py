"""Sample arrays and their energy as rows: mixing, excerpts, frames and quiet places, by expressions alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.sequences import first_least, moving_sum

#: Samples a second and in a frame of 10 ms, and frames in the window whose energy is compared.
RATE, FRAME, WINDOW = 16_000, 160, 10


def mix(a: Column, b: Column) -> Column:
    """Mean of two channels of equal length."""
    return F.zip_with(a, b, lambda x, y: x * 0.5 + y * 0.5)


def excerpt(samples: Column, start: Column, end: Column) -> Column:
    """The samples of [start, end) seconds."""
    low, high = F.rint(start * RATE).cast("int"), F.rint(end * RATE).cast("int")
    return F.slice(samples, low + 1, F.greatest(F.lit(0), high - low))


def preview(frames: DataFrame, seconds: float) -> DataFrame:
    """Frames of the first seconds alone."""
    return frames.where(F.col("frame") < round(seconds * RATE / FRAME))


def frames(recordings: DataFrame) -> DataFrame:
    """rec_id, frame and its energy, from rows of (rec_id, samples); an unfinished last frame counts."""
    n = F.ceil(F.size("samples") / FRAME).cast("int")
    energy = lambda i: F.aggregate(F.slice("samples", i * FRAME + 1, FRAME), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    rows = recordings.where(F.size("samples") > 0).select("rec_id", F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.cast("long").alias("frame"), energy(i).alias("energy")))).alias("f"))
    return rows.select("rec_id", "f.frame", "f.energy")


def quietest(energies: DataFrame, keys: Sequence[str], low: Column, high: Column, digits: int = 9) -> DataFrame:
    """The middle, in seconds, of the first quietest window of frames in [low, high) of each key.

    Energies are rounded, so that windows that differ in the last bit alone are ties, and the first of these is taken.
    """
    own = energies.where((F.col("frame") >= low) & (F.col("frame") < high))
    moved = moving_sum(own, keys, ["frame"], F.round("energy", digits).cast("decimal(28,9)"), WINDOW)
    return first_least(moved, keys, "moving", "frame").select(*keys, ((F.col("frame") + WINDOW / 2) * FRAME / RATE).alias("cut"))
