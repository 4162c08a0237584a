"""Wavelet smoothing for any orthogonal filter and level: the approximation of a level, and back from it alone.

Each level takes the filter with its taps twice as far apart as the one before, forwards; the way back takes the same taps in the other direction, from
the last level on. Vectors wrap around their ends. Tiles are smoothed apart, with as many positions on either side as the cascade reaches.
Haar's cascade has a closed form, and goes by running sums.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import product
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyridge.operators.dense import TILE
from tallyridge.operators.windows import around_ends, tiled, triangle_smooth


def _from_roots(n: int, roots: list[complex]) -> np.ndarray:
    """A low-pass filter with ``n`` zeros at -1 and the others given, of sum 1."""
    taps = np.real(np.poly([-1.0] * n + roots))
    return taps / taps.sum()


def _root_groups(n: int) -> list[list[complex]]:
    """Inner zeros of the half-band polynomial with ``n`` vanishing moments; conjugates together."""
    ys = np.roots([comb(n - 1 + k, k) for k in range(n - 1, -1, -1)]) if n > 1 else []
    groups = []
    for y in ys:
        if y.imag > -1e-9:
            z = min(np.roots([1, 4 * y - 2, 1]), key=abs)
            groups.append([z] if abs(y.imag) < 1e-9 else [z, z.conjugate()])
    return groups


@lru_cache
def scaling(name: str) -> tuple[float, ...]:
    """Taps of sum 1: ``haar``, ``db2`` to ``db10`` (least phase), ``sym2`` to ``sym10`` or ``la4`` to ``la20`` (straightest phase; ``la8`` has 8 taps)."""
    found = re.fullmatch(r"haar|(db|sym|la)(\d+)", name)
    n = 0 if not found else 1 if name == "haar" else int(found[2]) // (2 if found[1] == "la" else 1)
    if not 1 <= n <= 10 or (found[1] == "la" and int(found[2]) % 2):
        raise ValueError(f"no filter {name}")
    groups = _root_groups(n)
    if not found[1] or found[1] == "db":
        return tuple(_from_roots(n, [z for g in groups for z in g]))

    def bend(taps: np.ndarray) -> float:
        """How far the phase is from a straight line."""
        w = np.linspace(0, 0.9 * np.pi, 200)
        phase = np.unwrap(np.angle(np.exp(-1j * np.outer(w, np.arange(len(taps)))) @ taps))
        return float(np.abs(phase - np.polyval(np.polyfit(w, phase, 1), w)).max())

    choices = (_from_roots(n, [1 / z if out else z for g, out in zip(groups, sides) for z in g]) for sides in product((False, True), repeat=len(groups)))
    return tuple(min(choices, key=bend))


def cascade(x: np.ndarray, taps: tuple[float, ...], level: int) -> np.ndarray:
    """Forward through all levels and back, wrapped around the ends of ``x``."""
    for forward, levels in ((1, range(level)), (-1, range(level - 1, -1, -1))):
        for j in levels:
            gap = 1 << j
            far = len(taps) * gap - 1
            x = sum(g * np.roll(x, -forward * (far - i * gap)) for i, g in enumerate(taps))
    return x


def reach(taps: tuple[float, ...], level: int) -> int:
    """Positions on either side that a step of the cascade can reach."""
    return len(taps) * ((1 << level) - 1)


def wavelet_smooth(vector: DataFrame, name: str = "haar", level: int = 7, keys: tuple[str, ...] = ("contig",), tile: int = TILE) -> DataFrame:
    """``vector`` (without nulls) with ``smoothed``."""
    taps = scaling(name)
    if len(taps) == 2:
        return triangle_smooth(vector, level, keys, tile)
    far = reach(taps, level)
    out = vector.withColumn("smoothed", F.lit(0.0)).schema.simpleString().removeprefix("struct<").removesuffix(">")

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        return rows.assign(smoothed=cascade(rows["x"].to_numpy(np.float64), taps, level))

    def part(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        rows = rows.assign(smoothed=cascade(rows["x"].to_numpy(np.float64), taps, level), pos=rows["pos"] - far, size=rows["size"] - 2 * far)
        return rows[rows["own"] & (rows["__turn"] == 0)].drop(columns=["own", "tile", "__turn"])

    wide = tiled(around_ends(vector.where(F.col("size") > far), far), far, far, tile).groupBy(*keys, "tile").applyInPandas(part, out)
    return wide.unionByName(vector.where(F.col("size") <= far).groupBy(*keys).applyInPandas(whole, out))
