"""Statistics over samples: of pixels, against reference variables, of predictions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..frames import Stack
from ..functions.special import correlation_p_value
from ..shipping import ship


def pixel_statistics(stack: Stack) -> DataFrame:
    """ex, em, mean, variance, std over samples, of the population; NaN spreads."""
    agg = stack.by_pixel().groupBy("pos").agg(F.avg("intensity").alias("mean"), F.var_pop("intensity").alias("variance"), F.stddev_pop("intensity").alias("std"))
    return agg.select(*stack.place(F.col("pos")), "mean", "variance", "std")


def _joined(stack: Stack, variable: str) -> DataFrame:
    if stack.ref is None:
        raise ValueError("the stack has no reference table")
    ref = stack.ref.select("sample", F.col(variable).cast("double").alias("x")).where("x is not null and not isnan(x)")
    return stack.by_pixel().join(ref, "sample")


def average_ranks(df: DataFrame, column: str, by: Sequence[str], name: str) -> DataFrame:
    """Adds ranks from 1 in which ties share their mean."""
    first = F.rank().over(W.partitionBy(*by).orderBy(column))
    ties = F.count(F.lit(1)).over(W.partitionBy(*by, column))
    return df.withColumn(name, first + (ties - 1) / 2.0)


def correlation(stack: Stack, variables: Sequence[str], fit_intercept: bool = True) -> DataFrame:
    """variable, ex, em, n, slope, intercept, r_square, pearson, spearman and their p-values for every pixel and variable.

    Samples without the variable are left out. Without an intercept the line
    goes through the origin and r_square is one minus the residual over the
    total sum of squares about the mean.
    """
    parts = []
    for name in variables:
        d = _joined(stack, name)
        ranked = average_ranks(average_ranks(d, "x", ["pos"], "rx"), "intensity", ["pos"], "ry")
        y, x = F.col("intensity"), F.col("x")
        if fit_intercept:
            line = [F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r_square")]
        else:
            slope = F.try_divide(F.sum(x * y), F.sum(x * x))
            rest = F.sum(y * y) - 2 * slope * F.sum(x * y) + slope * slope * F.sum(x * x)
            line = [slope.alias("slope"), F.lit(0.0).alias("intercept"), (1 - F.try_divide(rest, F.var_pop(y) * F.count(y))).alias("r_square")]
        agg = ranked.groupBy("pos").agg(F.count(F.lit(1)).alias("n"), *line, F.corr("intensity", "x").alias("pearson"), F.corr("ry", "rx").alias("spearman"))
        parts.append(agg.select(F.lit(name).alias("variable"), *stack.place(F.col("pos")), "n", "slope", "intercept", "r_square", "pearson", "spearman"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return with_p_values(out, ("pearson", "spearman"))


def with_p_values(df: DataFrame, columns: Sequence[str], n: str = "n") -> DataFrame:
    """Adds <column>_p: two-sided p-values of correlations over n pairs."""
    names = df.columns
    ship(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for c in columns:
                pdf[f"{c}_p"] = [correlation_p_value(r, k) for r, k in zip(pdf[c], pdf[n], strict=True)]
            yield pdf[[*names, *[f"{c}_p" for c in columns]]]

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"`{c}_p` double" for c in columns])
    return df.mapInPandas(run, schema)


def residuals(stack: Stack, variable: str) -> DataFrame:
    """sample, ex, em, residual: the line's prediction minus the pixel."""
    d = _joined(stack, variable)
    line = d.groupBy("pos").agg(F.regr_slope("intensity", "x").alias("slope"), F.regr_intercept("intensity", "x").alias("b"))
    return d.join(line, "pos").select("sample", *stack.place(F.col("pos")), (F.col("slope") * F.col("x") + F.col("b") - F.col("intensity")).alias("residual"))


def calibrate(indicators: DataFrame, ref: DataFrame, p_values: bool = False) -> DataFrame:
    """Lines y = indicator over x = reference for each pair of them.

    indicators: sample, indicator, value; ref: sample, variable, value. Returns
    indicator, variable, n, slope, intercept, r_square, pearson, and with
    p_values pearson_p.
    """
    pairs = indicators.select("sample", "indicator", F.col("value").alias("y")).join(ref.select("sample", "variable", F.col("value").alias("x")).where("value is not null and not isnan(value)"), "sample")
    lines = pairs.groupBy("indicator", "variable").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r_square"), F.corr("y", "x").alias("pearson"))
    return with_p_values(lines, ("pearson",)) if p_values else lines


def predict_reference(indicators: DataFrame, lines: DataFrame) -> DataFrame:
    """sample, indicator, variable, predicted: lines read backwards."""
    joined = indicators.join(lines, "indicator")
    return joined.select("sample", "indicator", "variable", F.try_divide(F.col("value") - F.col("intercept"), F.col("slope")).alias("predicted"))


def prediction_rmse(predicted: DataFrame, ref: DataFrame) -> DataFrame:
    pairs = predicted.join(ref.select("sample", "variable", F.col("value").alias("truth")).where("value is not null and not isnan(value)"), ["sample", "variable"])
    return pairs.groupBy("indicator", "variable").agg(F.sqrt(F.avg(F.pow(F.col("truth") - F.col("predicted"), F.lit(2)))).alias("rmse"))


def cross_correlation(scores: DataFrame) -> DataFrame:
    """Lines between the scores of every two components; scores: sample, component, value."""
    a, b = (scores.select("sample", F.col("component").alias(x), F.col("value").alias(f"v{x}")) for x in ("a", "b"))
    return a.join(b, "sample").where("a < b").groupBy("a", "b").agg(F.regr_slope("vb", "va").alias("slope"), F.regr_intercept("vb", "va").alias("intercept"), F.regr_r2("vb", "va").alias("r_square"), F.corr("va", "vb").alias("pearson"))


def rmse_reduction(clustered: DataFrame, unified: DataFrame) -> DataFrame:
    """sample, reduction in per cent of (sample, rmse) against that of the unified model."""
    joined = clustered.select("sample", F.col("rmse").alias("c")).join(unified.select("sample", F.col("rmse").alias("u")), "sample")
    return joined.select("sample", (100 * (1 - F.try_divide("c", "u"))).alias("reduction"))


def error_means(history: DataFrame) -> DataFrame:
    """run, iter, error: the mean over samples of (run, iter, sample, error)."""
    return history.groupBy("run", "iter").agg(F.avg("error").alias("error"))


def histogram(values: DataFrame, column: str, id_col: str) -> DataFrame:
    """bin, low, high, n, members: as many equal bins as the larger of Sturges' and Freedman and Diaconis' rules.

    Few bins; members are listed, as a plot of samples needs them.
    """
    s = values.where(F.col(column).isNotNull()).agg(F.count(column).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi"), F.expr(f"percentile({column}, 0.75) - percentile({column}, 0.25)").alias("iqr"))
    span = F.col("hi") - F.col("lo")
    sturges = F.try_divide(span, F.log2("n") + 1)
    fd = F.try_divide(2 * F.col("iqr"), F.cbrt(F.col("n").cast("double")))
    width = F.when(fd > 0, F.least(sturges, fd)).otherwise(sturges)
    s = s.withColumn("bins", F.greatest(F.lit(1), F.ceil(F.coalesce(F.try_divide(span, width), F.lit(1)))))
    joined = values.where(F.col(column).isNotNull()).join(F.broadcast(s))
    place = F.least(F.col("bins") - 1, F.floor(F.coalesce(F.try_divide((F.col(column) - F.col("lo")) * F.col("bins"), span), F.lit(0.0))))
    grouped = joined.withColumn("bin", place.cast("int")).groupBy("bin", "lo", "hi", "bins").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(id_col)).alias("members"))
    step = (F.col("hi") - F.col("lo")) / F.col("bins")
    return grouped.select("bin", (F.col("lo") + step * F.col("bin")).alias("low"), (F.col("lo") + step * (F.col("bin") + 1)).alias("high"), "n", "members")


def series_summary(values: DataFrame, column: str, q: float = 0.05) -> DataFrame:
    """mean, std (population), cv, and the band of quantiles q and 1 - q."""
    return values.agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), F.try_divide(F.stddev_pop(column), F.avg(column)).alias("cv"), F.expr(f"percentile({column}, {q})").alias("low"), F.expr(f"percentile({column}, {1 - q})").alias("high"))
