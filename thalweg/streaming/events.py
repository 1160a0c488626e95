"""Rivers that grow point by point: arc length and sign changes of a stream.

An extra beside the batch operators: state per river is its last point and two running
numbers, however long the stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "river_id long, n_points long, length double, n_crossings long"
STATE = "n long, length double, crossings long, x double, y double, above boolean, ts timestamp"


def _grow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, length, crossings, x, y, above, ts = state.get if state.exists else (0, 0.0, 0, None, None, None, None)
    for points in batches:
        if points.empty:
            continue
        p = points.sort_values("ts", kind="stable")
        px, py = p["x"].to_numpy(float), p["y"].to_numpy(float)
        if n:  # the step from the last point of the batch before
            px, py = np.append(x, px), np.append(y, py)
        over = py > 0
        if n:
            over[0] = above
        length += float(np.hypot(np.diff(px), np.diff(py)).sum())
        crossings += int((over[1:] != over[:-1]).sum())
        n, x, y, above, ts = n + len(p), float(px[-1]), float(py[-1]), bool(over[-1]), p["ts"].iloc[-1]
    state.update((n, length, crossings, x, y, above, ts))
    yield pd.DataFrame({"river_id": [key[0]], "n_points": [n], "length": [length], "n_crossings": [crossings]})


def running_lengths(points: DataFrame) -> DataFrame:
    """Length and crossings so far of each river of a stream (river_id, ts, x, y)."""
    return points.groupBy("river_id").applyInPandasWithState(_grow, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def windowed_counts(points: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Points and mean y of each river and window; points later than ``late`` are dropped."""
    w = points.withWatermark("ts", late).groupBy("river_id", F.window("ts", size))
    return w.agg(F.count(F.lit(1)).alias("n_points"), F.avg("y").alias("mean_y")).select("river_id", F.col("window.start").alias("start"), "n_points", "mean_y")
