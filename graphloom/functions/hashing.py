"""64-bit mixing in wrapping unsigned arithmetic, which SQL's checked integers do not offer: Arrow batches of numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import LongType

# The increment and the two multipliers of the mixing function.
STEP, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + np.uint64(STEP)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(FIRST)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(SECOND)
        return x ^ (x >> np.uint64(31))


def _series(values: pd.Series) -> np.ndarray:
    return values.to_numpy(np.int64).view(np.uint64)


@F.pandas_udf(LongType())
def mix64(values: pd.Series) -> pd.Series:
    """The mixed value, as a signed integer with the same bits."""
    return pd.Series(mix(_series(values)).view(np.int64))


@F.pandas_udf(LongType())
def edge_rank(src: pd.Series, dst: pd.Series, seed: pd.Series) -> pd.Series:
    """A seeded rank of an undirected edge: the same for both directions, and never negative."""
    a, b = _series(src), _series(dst)
    key = np.minimum(a, b) << np.uint64(32) | np.maximum(a, b)
    return pd.Series((mix(key ^ mix(_series(seed))) >> np.uint64(1)).view(np.int64))


def edge_key(src: str = "src", dst: str = "dst") -> Column:
    """Both ends in one integer; for ids under 2 ** 31."""
    return F.shiftleft(F.least(src, dst), 32).bitwiseOR(F.greatest(src, dst))


def seeded(seed: Column | int, *keys: str | Column) -> Column:
    """A hash of a seed and whole numbers, from 0 to 2 ** 60, that any engine with MD5 can make again."""
    text = F.concat_ws(":", F.lit(seed).cast("string"), *((F.col(k) if isinstance(k, str) else k).cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def duration(seconds: str) -> Column:
    """Seconds with one decimal, under an hour minutes and rounded seconds (none under half a second), then hours."""
    s = F.col(seconds)
    minutes = F.floor(s / 60).cast("long")
    rest = s - minutes * 60
    short = F.when(rest < 0.5, F.format_string("%dm", minutes)).otherwise(F.format_string("%dm %ds", minutes, F.bround(rest, 0).cast("long")))
    return F.when(s < 60, F.format_string("%.1fs", s)).when(minutes < 60, short).otherwise(F.format_string("%dh %dm", F.floor(minutes / 60), minutes % 60))
