"""Column expressions over kinetics arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let, let_all

#: Fixed value: the normal distribution's 75 % quantile, which scales a median deviation to a standard deviation.
MAD_SCALE = 0.6744897501960817


def frames(codes: Column) -> Column:
    """Byte codes to frames: four ranges of 64 codes, in steps of 1, 2, 4 and 8 frames."""
    # Range r begins at frame 64 * (2**r - 1) and has steps of 2**r.
    def one(c):
        r = F.floor(c / 64).cast("int")
        step = F.when(r == 0, 1).when(r == 1, 2).when(r == 2, 4).otherwise(8)
        return ((step - 1) * 64 + (c - r * 64) * step).cast("int")

    return F.transform(codes, one)


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(a), F.lit(1))


def _median(a: Column) -> Column:
    s = F.array_sort(a)
    n = F.size(a)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def normalised(signal: Column, method: str = "zscore", decimals: int = 6) -> Column:
    """``signal`` normalised by ``method``; see ``_normalised``."""
    return let(F.transform(signal, lambda x: x.cast("double")), lambda a: _normalised(a, method, decimals))


def _normalised(a: Column, method: str, decimals: int) -> Column:
    """(x - shift) / scale: zscore (mean, population sd), min-max, min-mean (min, mean), mad, none.
    A zero scale gives zeros; half steps of the last decimal go up."""
    shifts = {"none": lambda: F.lit(0.0), "zscore": lambda: _mean(a), "min-max": lambda: F.array_min(a), "min-mean": lambda: F.array_min(a), "mad": lambda: _median(a)}
    if method not in shifts:
        raise ValueError(f"unknown normalisation: {method}")

    def scale(shift: Column) -> Column:
        if method == "none":
            return F.lit(1.0)
        if method == "zscore":
            return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - shift) * (x - shift)) / F.greatest(F.size(a), F.lit(1)))
        if method == "min-max":
            return F.array_max(a) - shift
        if method == "min-mean":
            return _mean(a)
        return let(F.transform(a, lambda x: F.abs(x - shift)), _median) / MAD_SCALE

    k = float(10**decimals)
    value = lambda x, p: F.when(p["scale"] == 0, 0.0).otherwise(F.floor((x - p["shift"]) / p["scale"] * k + 0.5) / k)
    scaled = lambda p: F.transform(a, lambda x: value(x, p))
    return let(shifts[method](), lambda m: let_all(scaled, shift=m, scale=scale(m)))
