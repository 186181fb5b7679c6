"""Integrated loudness of waveforms: two weighting filters, gated blocks, and gains that don't clip."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The public broadcast recommendation's filters (gain in dB, quality, corner in Hz), block and gates.
SHELF, HIGH_PASS = (4.0, 1 / math.sqrt(2), 1500.0), (0.0, 0.5, 38.0)
BLOCK, STEP, OFFSET, GATE, RELATIVE = 0.4, 0.25, -0.691, -70.0, -10.0
#: Samples that a filter takes at a time.
PIECE = 256


def high_shelf(gain: float, quality: float, corner: float, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """(b, a) of a second-order shelf, by the usual cookbook formulas."""
    a, w = 10 ** (gain / 40), 2 * math.pi * corner / rate
    alpha, c = math.sin(w) / (2 * quality), math.cos(w)
    root = 2 * math.sqrt(a) * alpha
    b = np.array([a * (a + 1 + (a - 1) * c + root), -2 * a * (a - 1 + (a + 1) * c), a * (a + 1 + (a - 1) * c - root)])
    return b / (a + 1 - (a - 1) * c + root), np.array([1, 2 * (a - 1 - (a + 1) * c) / (a + 1 - (a - 1) * c + root), (a + 1 - (a - 1) * c - root) / (a + 1 - (a - 1) * c + root)])


def high_pass(quality: float, corner: float, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """(b, a) of a second-order high pass."""
    w = 2 * math.pi * corner / rate
    alpha, c = math.sin(w) / (2 * quality), math.cos(w)
    return np.array([(1 + c) / 2, -(1 + c), (1 + c) / 2]) / (1 + alpha), np.array([1, -2 * c / (1 + alpha), (1 - alpha) / (1 + alpha)])


def filtered(x: np.ndarray, b: np.ndarray, a: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """A second-order recursive filter, a piece of samples at a time.

    What a piece gives by itself is one matrix product for all pieces; the two numbers of state that go
    from piece to piece are added after it.
    """
    if not len(x):
        return x
    move = np.array([[-a[1], 1.0], [-a[2], 0.0]])
    enter = np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]])
    powers = [np.eye(2)]
    for _ in range(piece):
        powers.append(powers[-1] @ move)
    answer = np.append(b[0], [(p @ enter)[0] for p in powers[: piece - 1]])
    k = np.arange(piece)
    alone = np.where(k[:, None] >= k[None, :], answer[(k[:, None] - k[None, :]) % piece], 0.0)
    seen = np.array([p[0] for p in powers[:piece]])
    given = np.stack([p @ enter for p in powers[piece - 1 :: -1]])
    rows = np.append(x, np.zeros(-len(x) % piece)).reshape(-1, piece)
    put, state, states = rows @ given, np.zeros(2), np.empty((len(rows), 2))
    for i, more in enumerate(put):
        states[i] = state
        state = powers[piece] @ state + more
    return (rows @ alone.T + states @ seen.T).ravel()[: len(x)]


def integrated(x: np.ndarray, rate: float) -> float:
    """Loudness of one channel in LUFS; minus infinity where no block passes the gates."""
    y = filtered(filtered(np.asarray(x, float), *high_shelf(*SHELF, rate)), *high_pass(*HIGH_PASS[1:], rate))
    blocks = int(np.round((len(y) / rate - BLOCK) / (BLOCK * STEP))) + 1
    energy = np.append(0.0, np.cumsum(y * y))
    j = np.arange(blocks)
    lo = (BLOCK * (j * STEP) * rate).astype(np.int64)
    hi = np.minimum((BLOCK * (j * STEP + 1) * rate).astype(np.int64), len(y))
    z = (energy[hi] - energy[np.minimum(lo, len(y))]) / (BLOCK * rate)
    with np.errstate(divide="ignore", invalid="ignore"):
        level = OFFSET + 10 * np.log10(np.maximum(z, 0))
        loud = level >= GATE
        if not loud.any():
            return -math.inf
        gate = OFFSET + 10 * np.log10(z[loud].mean()) + RELATIVE
        loud = (level > gate) & (level > GATE)
        return float(OFFSET + 10 * np.log10(z[loud].mean())) if loud.any() else -math.inf


def loudness(x: Column, rate: float) -> Column:
    """Integrated loudness in LUFS; null for silent and empty arrays, and for those shorter than a block."""

    @F.pandas_udf("double")
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for v in batch:
                v = np.empty(0) if v is None else np.asarray(v, float)
                found = integrated(v, rate) if len(v) >= int(rate * BLOCK) and np.abs(v).max() > 0 else -math.inf
                out.append(found if math.isfinite(found) else None)
            yield pd.Series(out, dtype=float)

    return F.nanvl(measure(x), F.lit(None).cast("double"))


def gain(level: Column, peak: Column, target: float = -23.0, limit: float = 0.99) -> Column:
    """What brings a level to the target, at most what brings the peak to its limit; 1 without a level."""
    return F.when(level.isNull() | (peak <= 0), 1.0).otherwise(F.least(F.pow(F.lit(10.0), (target - level) / 20), limit / peak))


def normalised(x: Column, gain: Column) -> Column:
    """An array times its gain."""
    return F.transform(x, lambda v: v * gain)
