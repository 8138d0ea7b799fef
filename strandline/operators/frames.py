"""Statistics of raw frames (rgb24 bytes), in batches of Arrow columns."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not find this package

TILE = "struct<r:double,g:double,b:double,luma:double>"
STATS = f"struct<r:double,g:double,b:double,luma:double,contrast:double,edge:double,saturation:double,tiles:array<{TILE}>>"
_NONE = {"r": 0.0, "g": 0.0, "b": 0.0, "luma": 0.0, "contrast": 0.0, "edge": 0.0, "saturation": 0.0, "tiles": []}


def frame_stats(frame: bytes | None, width: int, height: int, grid: int = 4) -> dict:
    """Mean colour (whole numbers), luma, contrast, edge, saturation, and the tiles of a grid in rows; zeros of an empty frame."""
    n = width * height
    if not frame or not n:
        return dict(_NONE)
    x = np.frombuffer(frame, np.uint8, 3 * n).reshape(height, width, 3).astype(float)
    luma = (0.2126 * x[..., 0] + 0.7152 * x[..., 1] + 0.0722 * x[..., 2]) / 255
    high, low = x.max(2), x.min(2)
    saturation = np.divide(high - low, high, out=np.zeros_like(high), where=high > 0)
    steps = np.concatenate([np.abs(np.diff(luma, axis=1)).ravel(), np.abs(np.diff(luma, axis=0)).ravel()])
    grid = max(1, grid)
    tile = (np.minimum(np.arange(height) * grid // height, grid - 1)[:, None] * grid + np.minimum(np.arange(width) * grid // width, grid - 1)).ravel()
    count = np.maximum(np.bincount(tile, minlength=grid * grid), 1)
    mean = lambda v: np.bincount(tile, v.ravel(), grid * grid) / count
    r, g, b = (np.rint(mean(x[..., c])) for c in range(3))
    tiles = [dict(zip(("r", "g", "b", "luma"), map(float, t))) for t in zip(r, g, b, mean(luma))]
    mid = luma.mean()
    whole = dict(zip("rgb", (float(np.rint(x[..., c].mean())) for c in range(3))))
    return whole | {"luma": float(mid), "contrast": float(np.sqrt(max(0.0, (luma * luma).mean() - mid * mid))), "edge": float(steps.mean()) if len(steps) else 0.0, "saturation": float(saturation.mean()), "tiles": tiles}


def pixel_motion(now: bytes | None, before: bytes | None) -> float:
    """Mean difference of the bytes both frames have, 0 to 1; 0 without one of them."""
    n = min(len(now or b""), len(before or b""))
    if not n:
        return 0.0
    return float(np.abs(np.frombuffer(now, np.uint8, n).astype(np.int16) - np.frombuffer(before, np.uint8, n)).mean()) / 255


def stats(frame: Column, width: int, height: int, grid: int = 4) -> Column:
    """STATS of a column of frames of one size."""
    one = frame_stats

    @F.pandas_udf(STATS)
    def run(frames: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(f, width, height, grid) for f in frames], columns=list(_NONE))

    return run(frame)


@F.pandas_udf(DoubleType())
def motion(now: pd.Series, before: pd.Series) -> pd.Series:
    return pd.Series([pixel_motion(a, b) for a, b in zip(now, before)], dtype=float)


def sampled(frames: DataFrame, width: int, height: int, grid: int = 4) -> DataFrame:
    """Samples of frames (film_id, n, t, frame): all statistics, and motion against the frame before."""
    w = Window.partitionBy("film_id").orderBy("n")
    seen = frames.withColumn("__before", F.lag("frame").over(w))
    return seen.withColumn("motion", motion("frame", "__before")).withColumn("__s", stats(F.col("frame"), width, height, grid)).select("film_id", "n", "t", "__s.*", "motion")
