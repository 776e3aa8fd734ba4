"""The tables behind plots; drawing is left to the reader's tool."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frames import Stack, numbers
from ..operators import stats as T
from .models import Fitted, PARAFAC


def eem_grid(stack: Stack, scale_type: str = "linear") -> DataFrame:
    """Pixels, on a log scale the logarithm to 10 of positive ones."""
    long = stack.pixels()
    if scale_type == "linear":
        return long
    if scale_type != "log":
        raise ValueError(f"scale_type must be linear or log; got {scale_type!r}")
    return long.withColumn("intensity", F.when(F.col("intensity") > 0, F.log10("intensity")))


def absorbance_series(absorbances: DataFrame, axis: Sequence[float]) -> DataFrame:
    """sample, wl, absorbance: the points of absorbance spectra on an axis."""
    points = absorbances.select("sample", F.posexplode("absorbance").alias("at", "absorbance"))
    return points.select("sample", F.get(numbers(axis), F.col("at")).alias("wl"), "absorbance")


def index_series(values: DataFrame, column: str, q: float = 0.05) -> DataFrame:
    return values.join(F.broadcast(T.series_summary(values, column, q)))


def index_correlation(values: DataFrame, column: str, ref: DataFrame, variable: str) -> DataFrame:
    """n, slope, intercept, r_square, pearson and its p-value of an index against a reference."""
    return T.calibrate(values.select("sample", F.lit(column).alias("indicator"), F.col(column).alias("value")), ref.select("sample", F.lit(variable).alias("variable"), F.col(variable).alias("value")), p_values=True)


def loadings(models: Mapping[str, PARAFAC]) -> DataFrame:
    """model, axis, wavelength, component, value."""
    out = None
    for name, m in models.items():
        for axis, table in zip(("ex", "em"), m.loading_tables(), strict=True):
            d = table.select(F.lit(str(name)).alias("model"), F.lit(axis).alias("axis"), "wavelength", "component", "value")
            out = d if out is None else out.unionByName(d)
    return out


def fmax_table(model: Fitted) -> DataFrame:
    """sample, index, cluster, component, fmax."""
    named = model.fmax.join(model.stack.frame.select("sample", "index", "cluster"), "sample")
    return named.select("sample", "index", "cluster", F.posexplode("fmax").alias("component", "fmax"))


def error_histogram(errors: DataFrame, column: str = "rmse") -> DataFrame:
    return T.histogram(errors, column, "sample")


def reconstruction_errors(clustered: DataFrame, unified: DataFrame) -> DataFrame:
    return clustered.select("sample", F.col("rmse").alias("clustered")).join(unified.select("sample", F.col("rmse").alias("unified")), "sample").join(T.rmse_reduction(clustered, unified), "sample")


def dendrogram(linkage: np.ndarray, spark) -> DataFrame:
    rows = [(i, int(a), int(b), float(d), int(n)) for i, (a, b, d, n) in enumerate(linkage)]
    return spark.createDataFrame(rows, "step int, a int, b int, distance double, size int")
