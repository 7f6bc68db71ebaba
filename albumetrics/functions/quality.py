"""Region quality: size, frontality and sharpness blended into [0, 1]."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NEUTRAL = 0.5


def size_score(w: Column, h: Column) -> Column:
    area = F.least(F.greatest(w * h, F.lit(0.0)), F.lit(1.0))
    return 1 / (1 + F.exp(F.lit(-10.0) * (area - 0.05)))


def frontal_score(rotation: Column) -> Column:
    return F.exp(-(rotation * rotation) / (2 * 0.35 * 0.35))


def region_quality(
    w: Column, h: Column, rotation: Column | None = None, sharpness: Column | None = None
) -> Column:
    """An absent rotation or image scores the neutral value."""
    neutral = F.lit(NEUTRAL)
    frontal = neutral if rotation is None else F.coalesce(frontal_score(rotation), neutral)
    sharp = neutral if sharpness is None else F.coalesce(sharpness, neutral)
    total = size_score(w, h) * 0.40 + frontal * 0.35 + sharp * 0.25
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))


def match_boost(quality: Column, is_confirmed: Column) -> Column:
    factor = F.when(is_confirmed, 1.5).otherwise(1.0)
    return F.least(F.coalesce(quality, F.lit(NEUTRAL)) * factor, F.lit(1.0))


def blend_quality(previous: Column, refined: Column) -> Column:
    return F.coalesce(previous, refined) * 0.667 + refined * 0.333


def _sharpness(data: bytes, height: int, width: int, channels: int) -> float:
    if height < 3 or width < 3:
        return NEUTRAL
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float64)
    # Image rows hold channels in blue, green, red order.
    luma = pixels[:, :, :3] @ np.array([0.114, 0.587, 0.299]) if channels >= 3 else pixels[:, :, 0]
    inner = luma[1:-1, 1:-1]
    laplacian = (
        luma[:-2, 1:-1] + luma[2:, 1:-1] + luma[1:-1, :-2] + luma[1:-1, 2:] - 4 * inner
    )
    return float(1 - np.exp(-np.mean(laplacian**2) / 200.0))


@F.arrow_udf(T.DoubleType())
def sharpness_score(
    data: pa.Array, height: pa.Array, width: pa.Array, channels: pa.Array
) -> pa.Array:
    """Sharpness of image rows as ``spark.read.format("image")`` yields them."""
    sizes = zip(
        data.to_pylist(), height.to_pylist(), width.to_pylist(), channels.to_pylist(), strict=True
    )
    return pa.array([None if d is None else _sharpness(d, h, w, c) for d, h, w, c in sizes], pa.float64())
