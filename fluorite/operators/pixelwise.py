"""Masks, cuts, corrections and normalisations of every sample; narrow, JVM-side where an expression says it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frames import Stack, flags, nearest, numbers
from . import kernels as K

NAN = float("nan")


def process_samples(
    stack: Stack,
    kernel: Callable[..., np.ndarray | tuple],
    ex: Sequence[float] | None = None,
    em: Sequence[float] | None = None,
    absorbance: DataFrame | None = None,
    blank: Stack | None = None,
    outputs: str | None = None,
) -> tuple[Stack, DataFrame | None]:
    """Any function of a (ex, em) matrix, sample by sample.

    absorbance (sample, absorbance) and blank go to the kernel by these names,
    each sample's own; samples without one are dropped, null ones are None.
    outputs is the schema of what the kernel returns after the matrix, "mask
    array<double>" say (matrices as arrays in row order); the table of sample
    and outputs comes second. Stack and table each run the kernel.
    """
    names, shape = stack.frame.columns, stack.shape
    frame = stack.frame
    if absorbance is not None:
        frame = frame.join(absorbance.select("sample", F.col("absorbance").alias("__absorbance")), "sample")
    if blank is not None:
        frame = frame.join(blank.frame.select("sample", F.col("intensity").alias("__blank")), "sample")
        blank_shape = blank.shape
    more = [f.name for f in stack.spark.createDataFrame([], outputs).schema] if outputs else []

    def matrix(v, size: tuple[int, int]) -> np.ndarray:
        return np.full(size, np.nan) if v is None else np.asarray(v, float).reshape(size)

    def run(batches):
        for pdf in batches:
            done, others = [], []
            for _, row in pdf.iterrows():
                own = {}
                if absorbance_given:
                    own["absorbance"] = None if row["__absorbance"] is None else np.asarray(row["__absorbance"], float)
                if blank_given:
                    own["blank"] = None if row["__blank"] is None else matrix(row["__blank"], blank_shape)
                got = kernel(matrix(row["intensity"], shape), **own)
                first, rest = (got[0], got[1:]) if isinstance(got, tuple) else (got, ())
                done.append(np.asarray(first, float).ravel())
                others.append([np.ravel(o) if np.ndim(o) else o for o in rest[: len(more)]])
            pdf["intensity"] = done
            for i, name in enumerate(more):
                pdf[name] = [o[i] for o in others]
            yield pdf[[*names, *more]]

    absorbance_given, blank_given = absorbance is not None, blank is not None
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in stack.frame.schema] + ([outputs] if outputs else []))
    both = frame.mapInPandas(run, schema)
    out = Stack(both.select(*names), tuple(ex if ex is not None else stack.ex), tuple(em if em is not None else stack.em), stack.ref)
    return out, both.select("sample", *more) if outputs else None


def threshold_masking(stack: Stack, threshold: float, fill: float = NAN, mask_type: str = "greater") -> Stack:
    """Pixels above (greater) or below (smaller) the threshold become fill; NaN stays."""
    if mask_type not in ("greater", "smaller"):
        raise ValueError(f"mask_type must be greater or smaller; got {mask_type!r}")

    def one(v: Column) -> Column:
        over = v > threshold if mask_type == "greater" else v < threshold
        return F.when(~F.isnan(v) & over, F.lit(float(fill))).otherwise(v)

    return stack.with_intensity(F.transform("intensity", one))


def _where(stack: Stack, mask: np.ndarray, fill: float) -> Stack:
    marks = flags(mask)
    return stack.with_intensity(F.zip_with("intensity", marks, lambda v, m: F.when(m, F.lit(float(fill))).otherwise(v)))


def snapped(axis: Sequence[float], low: float, high: float) -> tuple[int, int]:
    return nearest(axis, low), nearest(axis, high)


def region_masking(stack: Stack, ex_min: float = 230, ex_max: float = 500, em_min: float = 250, em_max: float = 810, fill: str = "nan") -> Stack:
    """A rectangle, its bounds snapped to the grid and inclusive, becomes NaN or zero."""
    if fill not in ("nan", "zero"):
        raise ValueError(f"fill must be nan or zero; got {fill!r}")
    a, b = snapped(stack.ex, ex_min, ex_max)
    c, d = snapped(stack.em, em_min, em_max)
    mask = np.zeros(stack.shape, bool)
    mask[a : b + 1, c : d + 1] = True
    return _where(stack, mask, NAN if fill == "nan" else 0.0)


def cutting(stack: Stack, ex_min: float, ex_max: float, em_min: float, em_max: float) -> Stack:
    """Keeps a rectangle, its bounds snapped to the grid and inclusive."""
    a, b = snapped(stack.ex, ex_min, ex_max)
    c, d = snapped(stack.em, em_min, em_max)
    width, keep = len(stack.em), d - c + 1
    rows = [F.slice("intensity", i * width + c + 1, keep) for i in range(a, b + 1)]
    return stack.with_intensity(F.concat(*rows), stack.ex[a : b + 1], stack.em[c : d + 1])


def tf_weights(stack: Stack) -> DataFrame:
    """sample, total, weight: total intensity over the mean total."""
    totals = stack.frame.select("sample", F.aggregate("intensity", F.lit(0.0), lambda s, v: s + v).alias("total"))
    mean = totals.agg(F.avg("total").alias("mean"))  # one row
    return totals.join(F.broadcast(mean)).select("sample", "total", F.try_divide("total", "mean").alias("weight"))


def tf_normalization(stack: Stack) -> tuple[Stack, DataFrame]:
    """Every sample over its weight, and the weights."""
    total = F.aggregate("intensity", F.lit(0.0), lambda s, v: s + v)
    mean = stack.frame.agg(F.avg(total).alias("__mean"))  # one row
    joined = stack.frame.join(F.broadcast(mean)).withColumn("__w", F.try_divide(total, F.col("__mean")))
    frame = joined.withColumn("intensity", F.transform("intensity", lambda v: F.try_divide(v, F.col("__w")))).drop("__mean", "__w")
    return stack.with_frame(frame), tf_weights(stack)


def raman_unit(blank: Stack, integration_time: float = 1, ex_target: float = 350, bandwidth: float = 5, rsu_standard: float = 20000) -> DataFrame:
    """sample, rsu: the Raman scattering units of blanks."""
    from .indices import regional_integration

    centre = ex_target / (1 - 0.00036 * ex_target)
    area = regional_integration(blank, ex_target, ex_target, centre - bandwidth / 2, centre + bandwidth / 2)
    return area.select("sample", (F.col("integral") / (integration_time * rsu_standard)).alias("rsu"))


def raman_normalization(stack: Stack, blank: Stack | None = None, from_blank: bool = False, integration_time: float = 1, ex_target: float = 350, bandwidth: float = 5, rsu_standard: float = 20000, manual_rsu: float = 1) -> Stack:
    """Divides by the Raman scattering units of the sample's blank, or of a single blank, or by a given number."""
    if not from_blank:
        return stack.with_intensity(F.transform("intensity", lambda v: v / F.lit(float(manual_rsu))))
    if blank is None:
        raise ValueError("blank is needed with from_blank")
    units = raman_unit(blank, integration_time, ex_target, bandwidth, rsu_standard)
    first = [r["rsu"] for r in units.limit(2).collect()]
    if len(first) == 1:
        return raman_normalization(stack, manual_rsu=first[0])
    joined = stack.frame.join(units, "sample")
    return stack.with_frame(joined.withColumn("intensity", F.transform("intensity", lambda v: F.try_divide(v, F.col("rsu")))).drop("rsu"))


def _restored(x: np.ndarray, filled: np.ndarray, keep: bool) -> np.ndarray:
    return np.where(np.isnan(x), np.nan, filled) if keep else filled


def raman_scattering_removal(stack: Stack, width: float = 5, interpolation_method: str = "linear", interpolation_dimension: str = "2d", recover_original_nan: bool = True) -> Stack:
    """The first-order Raman band becomes zero or NaN, or is filled from around it."""
    if interpolation_method not in ("linear", "cubic", "nan", "zero"):
        raise ValueError(f"interpolation_method must be linear, cubic, nan or zero; got {interpolation_method!r}")
    ex, em = np.array(stack.ex), np.array(stack.em)
    mask = K.raman_mask(ex, em, width)
    if interpolation_method in ("nan", "zero"):
        return _banded(stack, mask, interpolation_method, recover_original_nan)
    return stack.map_kernel(lambda x: _restored(x, K.fill_band(x, mask, ex, em, interpolation_method, interpolation_dimension), recover_original_nan))


def _banded(stack: Stack, mask: np.ndarray, method: str, keep: bool) -> Stack:
    fill = F.lit(0.0 if method == "zero" else NAN)
    return stack.with_intensity(F.zip_with("intensity", flags(mask), lambda v, m: F.when(m & (~F.isnan(v) if keep else F.lit(True)), fill).otherwise(v)))


def rayleigh_scattering_removal(
    stack: Stack,
    width_o1: float = 15,
    width_o2: float = 15,
    interpolation_dimension_o1: str = "2d",
    interpolation_dimension_o2: str = "2d",
    interpolation_method_o1: str = "zero",
    interpolation_method_o2: str = "linear",
    recover_original_nan: bool = True,
) -> Stack:
    """Zeroes emission up to excitation, then treats the first and the second order band in turn."""
    for name, method in (("o1", interpolation_method_o1), ("o2", interpolation_method_o2)):
        if method not in ("linear", "cubic", "nan", "zero", "none"):
            raise ValueError(f"interpolation_method_{name} must be linear, cubic, nan, zero or none; got {method!r}")
    ex, em = np.array(stack.ex), np.array(stack.em)
    below = em[None, :] <= ex[:, None]
    bands = [
        (K.rayleigh_mask(ex, em, width_o1, 1), interpolation_method_o1, interpolation_dimension_o1),
        (K.rayleigh_mask(ex, em, width_o2, 2), interpolation_method_o2, interpolation_dimension_o2),
    ]
    if all(method in ("nan", "zero", "none") for _, method, _ in bands):  # one projection
        kind = np.where(below, 1, 0)
        for mask, method, _ in bands:
            if method != "none":
                kind = np.where(mask, 1 if method == "zero" else 2, kind)
        marks = F.array(*[F.lit(int(k)) for k in kind.ravel()])

        def one(v: Column, k: Column) -> Column:
            new = F.when(k == 1, F.lit(0.0)).when(k == 2, F.lit(NAN)).otherwise(v)
            return F.when(F.isnan(v), v).otherwise(new) if recover_original_nan else new

        return stack.with_intensity(F.zip_with("intensity", marks, one))

    def kernel(x: np.ndarray) -> np.ndarray:
        out = np.where(below, 0.0, x)
        for mask, method, dimension in bands:
            if method in ("zero", "nan"):
                out = np.where(mask, 0.0 if method == "zero" else np.nan, out)
            elif method != "none":
                out = K.fill_band(out, mask, ex, em, method, dimension)
            out = _restored(x, out, recover_original_nan)
        return out

    return stack.map_kernel(kernel)


def ife_correction(stack: Stack, absorbance: DataFrame, ex_range_abs: Sequence[float]) -> Stack:
    """Inner filter effect: I * 10 ** ((A(ex) + A(em)) / 2).

    absorbance: sample and an array of doubles on ex_range_abs; interpolated
    linearly, and extrapolated, to both axes. Samples without one are dropped.
    """
    to_ex, to_em = (K.linear_weights(ex_range_abs, axis, "extrapolate") for axis in (stack.ex, stack.em))
    a_ex, a_em = _product(F.col("__a"), to_ex), _product(F.col("__a"), to_em)
    joined = stack.frame.join(absorbance.select("sample", F.col("absorbance").alias("__a")), "sample").withColumn("__ex", a_ex).withColumn("__em", a_em)
    width = len(stack.em)

    def one(v: Column, i: Column) -> Column:
        return v * F.pow(F.lit(10.0), (F.get("__ex", F.floor(i / width).cast("int")) + F.get("__em", (i % width).cast("int"))) / 2)

    return stack.with_frame(joined.withColumn("intensity", F.transform("intensity", one)).drop("__a", "__ex", "__em"))


def _product(vector: Column, m: np.ndarray) -> Column:
    """m @ vector for a matrix with few weights in a row."""
    rows = []
    for r in m:
        at = np.flatnonzero(r)
        rows.append(sum((F.get(vector, F.lit(int(i))) * float(r[i]) for i in at[1:]), F.get(vector, F.lit(int(at[0]))) * float(r[at[0]])))
    return F.array(*rows)


def gaussian_filter(stack: Stack, sigma: float = 1, truncate: float = 3) -> Stack:
    m_ex, m_em = (K.gaussian_matrix(n, sigma, truncate) for n in stack.shape)
    return stack.map_kernel(lambda x: K.along(x, m_ex, m_em))


def median_filter(stack: Stack, window_size: tuple[int, int] = (3, 3), mode: str = "reflect") -> Stack:
    K.folded_index(np.zeros(1, int), 1, mode)  # raises for an unknown mode
    return stack.map_kernel(lambda x: K.median(x, window_size, mode))


def interpolation(stack: Stack, ex_range_new: Sequence[float], em_range_new: Sequence[float], method: str = "linear") -> Stack:
    """New axes; outside the old ones NaN."""
    m_ex, m_em = K.axis_weights(stack.ex, ex_range_new, method), K.axis_weights(stack.em, em_range_new, method)
    return stack.map_kernel(lambda x: K.resample(x, m_ex, m_em), ex_range_new, em_range_new)


def nan_imputing(stack: Stack, method: str = "linear", fill_value: float | str = "linear_ex") -> Stack:
    if method not in ("linear", "cubic"):
        raise ValueError(f"method must be linear or cubic; got {method!r}")
    ex, em = np.array(stack.ex), np.array(stack.em)
    return stack.map_kernel(lambda x: np.stack([K.impute(s, ex, em, method, fill_value) for s in x]))


def zscore(stack: Stack) -> DataFrame:
    """sample, ex, em, zscore: by pixel over samples, with the population's deviation; null where that is 0."""
    each = stack.by_pixel()
    stats = each.groupBy("pos").agg(F.avg("intensity").alias("mean"), F.stddev_pop("intensity").alias("std"))
    joined = each.join(stats, "pos")
    return joined.select("sample", *stack.place(F.col("pos")), F.try_divide(F.col("intensity") - F.col("mean"), F.when(F.col("std") != 0, F.col("std"))).alias("zscore"))


def weighted_sum(weights: np.ndarray) -> Column:
    """A sample's pixels times constant weights, summed; zero weights ignore NaN."""
    at = np.flatnonzero(weights.ravel())
    if not len(at):
        return F.lit(0.0)
    w = weights.ravel()[at]
    ids = F.array(*[F.lit(int(i)) for i in at])
    return F.aggregate(F.zip_with(ids, numbers(w), lambda i, c: F.get("intensity", i) * c), F.lit(0.0), lambda s, v: s + v)
