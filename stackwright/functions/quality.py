"""Scores of read texts and pictures, and the gates on them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Floors of the text gate, the weight of a detection, the pass mark; floors of the picture gate.
CONFIDENCE, AGREEMENT, LENGTH, LETTERS = 0.35, 0.0, 3.0, 0.4
DETECTION, PASS = 0.3, 0.5
SHARPNESS, EXPOSURE, SOFTNESS = 0.12, 0.12, 40.0


def above(value: Column, floor: float) -> Column:
    """How far a value is above its floor, as a share of the floor, within 0 and 1; 1 without a floor."""
    return F.lit(1.0) if floor <= 0 else F.when(value > floor, F.least(F.lit(1.0), (value - floor) / floor)).otherwise(0.0)


def plausible(text: Column) -> Column:
    """Mean of length, share of letters, and whether a word has two letters; 0 for blank texts."""
    x = F.trim(text)
    n, letters = F.length(x), F.length(F.regexp_replace(x, r"[^\p{L}]", ""))
    shaped = F.exists(F.split(x, " "), lambda w: F.length(F.regexp_replace(w, r"[^\p{L}]", "")) >= 2).cast("double")
    return F.when(n == 0, 0.0).otherwise((above(n.cast("double"), LENGTH) + above(letters / n, LETTERS) + shaped) / 3)


def text_score(text: Column, confidence: Column, agreement: Column, detection: Column) -> Column:
    """Weighted mean of confidence, agreement, plausibility and, if known, the detection's confidence."""
    core = above(confidence, CONFIDENCE) + above(agreement, AGREEMENT) + plausible(text)
    known = F.coalesce(detection * DETECTION, F.lit(0.0))
    weight = F.when(detection.isNull(), 3.0).otherwise(3.0 + DETECTION)
    return F.when(F.trim(text) == "", 0.0).otherwise((core + known) / weight)


def _pixels(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint8)[: len(raw) // width * width].reshape(-1, width).astype(np.float64)


@F.pandas_udf(T.DoubleType())
def sharpness(raw: pd.Series, width: pd.Series) -> pd.Series:
    """Variance of the Laplacian of 8-bit samples, v / (v + 40); 0 below three rows or columns."""

    def one(b: bytes, w: int) -> float:
        p = _pixels(b, w)
        if min(p.shape) < 3:
            return 0.0
        v = float(np.var(p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]))
        return v / (v + SOFTNESS)

    return pd.Series([None if b is None else one(b, w) for b, w in zip(raw, width)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def exposure(raw: pd.Series) -> pd.Series:
    """1 at a mean of half the range, 0 at either end; 0 without samples."""
    return pd.Series([None if b is None else 0.0 if not b else 1 - abs(float(np.frombuffer(b, np.uint8).mean()) - 127.5) / 127.5 for b in raw], dtype="float64")


def picture_ok(sharp: Column, exposed: Column) -> Column:
    return (sharp >= SHARPNESS) & (exposed >= EXPOSURE)
