"""Indices and integrals of every sample; constant weights on the sample's array, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frames import Stack, nearest
from . import kernels as K
from .pixelwise import weighted_sum


def total_fluorescence(stack: Stack) -> DataFrame:
    return stack.frame.select("sample", F.aggregate("intensity", F.lit(0.0), lambda s, v: s + v).alias("total"))


def _between(axis: Sequence[float], low: float, high: float) -> np.ndarray:
    """Weights on the axis of the integral from low to high of the linear interpolant; of its value where both are one."""
    inner = sorted({low, high, *[x for x in axis if low <= x <= high]})
    m = K.linear_weights(axis, inner)
    if np.isnan(m).any():
        raise ValueError(f"{low} to {high} is not inside the axis, {min(axis)} to {max(axis)}")
    return m[0] if len(inner) == 1 else K.trapezoid(inner) @ m


def regional_integration(stack: Stack, ex_min: float, ex_max: float, em_min: float, em_max: float) -> DataFrame:
    """sample, integral, average: trapezoids over the rectangle, its bounds interpolated linearly.

    A single excitation or emission gives an integral over the other axis, with
    its sign; a rectangle gives the absolute value. The average is over the
    area, 0 if there is none.
    """
    weights = np.outer(_between(stack.ex, ex_min, ex_max), _between(stack.em, em_min, em_max))
    value = weighted_sum(weights)
    if ex_min != ex_max and em_min != em_max:
        value = F.abs(value)
    area = (ex_max - ex_min) * (em_max - em_min)
    return stack.frame.select("sample", value.alias("integral"), (value / area if area > 0 else F.lit(0.0)).alias("average"))


def at(stack: Stack, ex: float, em: float) -> Column:
    return F.get("intensity", F.lit(nearest(stack.ex, ex) * len(stack.em) + nearest(stack.em, em)))


def peak_picking(stack: Stack, ex: float, em: float) -> DataFrame:
    """sample, ex, em, intensity at the nearest grid point."""
    i, j = nearest(stack.ex, ex), nearest(stack.em, em)
    return stack.frame.select("sample", F.lit(stack.ex[i]).alias("ex"), F.lit(stack.em[j]).alias("em"), at(stack, ex, em).alias("intensity"))


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def hix(stack: Stack, ex: float = 254, high: tuple[float, float] = (435, 480), low: tuple[float, float] = (300, 345)) -> DataFrame:
    """H / (H + L) of emission bands at one excitation; ValueError if the axes don't hold them."""
    h, low_ = (weighted_sum(np.outer(_between(stack.ex, ex, ex), _between(stack.em, *band))) for band in (high, low))
    return stack.frame.select("sample", _ratio(h, h + low_).alias("hix"))


def bix(stack: Stack, ex: float = 310, high: float = 380, low: float = 430) -> DataFrame:
    return stack.frame.select("sample", _ratio(at(stack, ex, high), at(stack, ex, low)).alias("bix"))


def fi(stack: Stack, ex: float = 370, high: float = 470, low: float = 520) -> DataFrame:
    return stack.frame.select("sample", _ratio(at(stack, ex, high), at(stack, ex, low)).alias("fi"))


def aqy(stack: Stack, absorbance: DataFrame, ex_range_abs: Sequence[float], target_ex: float | None = None) -> DataFrame:
    """sample, ex, aqy: intensity over all emissions, over the absorbance at that excitation; all excitations, or the nearest."""
    from .pixelwise import _product

    width = len(stack.em)
    places = range(len(stack.ex)) if target_ex is None else [nearest(stack.ex, target_ex)]
    a = _product(F.col("absorbance"), K.linear_weights(ex_range_abs, stack.ex, "extrapolate"))
    joined = stack.frame.join(absorbance.select("sample", "absorbance"), "sample").withColumn("__a", a)
    rows = F.array(*[F.struct(F.lit(stack.ex[i]).alias("ex"), F.try_divide(F.aggregate(F.slice("intensity", i * width + 1, width), F.lit(0.0), lambda s, v: s + v), F.get("__a", F.lit(i))).alias("aqy")) for i in places])
    return joined.select("sample", F.explode(rows).alias("r")).select("sample", "r.*")
