"""How far apart in time two photos are, as a penalty or a bonus on distances."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
YEAR_MS = 365.25 * 24 * 3600 * 1000
HALF_LIFE_YEARS = 3.0
DECAY = 0.6931 / HALF_LIFE_YEARS
BONUS_SIGMA_YEARS = 3.0
MAX_BONUS = 0.15


def penalty(taken_a: Column, taken_b: Column, weight: float, reference: float) -> Column:
    """Grows from 0 to ``reference``; half of it at three years. Any epoch is a valid date."""
    if weight <= 0:
        return F.lit(0.0)
    years = F.abs(taken_a.cast("double") - taken_b.cast("double")) / YEAR_MS
    raw = F.lit(reference) * (1 - F.exp(-F.lit(DECAY) * years)) * weight
    bounded = F.least(F.greatest(raw, F.lit(0.0)), F.lit(reference))
    return F.when(taken_a.isNull() | taken_b.isNull(), F.lit(0.0)).otherwise(bounded)


def bonus(taken_a: Column, taken_b: Column, weight: float) -> Column:
    """Greatest for photos of the same moment; a date at or before 1970 counts as missing."""
    if weight <= 0:
        return F.lit(0.0)
    years = (taken_a.cast("double") - taken_b.cast("double")) / YEAR_MS
    gauss = F.exp(-(years * years) / (2 * BONUS_SIGMA_YEARS**2))
    usable = taken_a.isNotNull() & taken_b.isNotNull() & (taken_a > 0) & (taken_b > 0)
    return F.when(usable, F.lit(MAX_BONUS * weight) * gauss).otherwise(F.lit(0.0))


def penalty_pairs(a: np.ndarray, b: np.ndarray, weight: float, reference: float) -> np.ndarray | float:
    """Penalty of dates that stand side by side; NaN marks a missing date."""
    if weight <= 0:
        return 0.0
    years = np.abs(a - b) / YEAR_MS
    out = np.clip(reference * (1 - np.exp(-DECAY * years)) * weight, 0.0, reference)
    return np.nan_to_num(out, nan=0.0)


def penalty_matrix(
    rows: np.ndarray, cols: np.ndarray, weight: float, reference: float
) -> np.ndarray | float:
    """Penalty for all row/column pairs."""
    return penalty_pairs(rows[:, None], cols[None, :], weight, reference)


def bonus_matrix(rows: np.ndarray, cols: np.ndarray, weight: float) -> np.ndarray | float:
    if weight <= 0:
        return 0.0
    rows = np.where(rows > 0, rows, np.nan)
    cols = np.where(cols > 0, cols, np.nan)
    years = (rows[:, None] - cols[None, :]) / YEAR_MS
    out = MAX_BONUS * weight * np.exp(-(years * years) / (2 * BONUS_SIGMA_YEARS**2))
    return np.nan_to_num(out, nan=0.0)
