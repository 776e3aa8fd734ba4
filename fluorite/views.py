"""The driver's tables as stacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import Stack, axes_of, fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> Stack:
    """E: each embedding is an 8 by 8 matrix; its label is the cluster. No shuffle."""
    frame = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample"), F.col("vec_id").cast("string").alias("index"), F.col("label").cast("string").alias("cluster"), F.transform("embedding", lambda v: v.cast("double")).alias("intensity"))
    return Stack(frame, tuple(240.0 + 10 * i for i in range(8)), tuple(300.0 + 10 * i for i in range(8)), parts(spark, sf_dir))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sample"), F.col("p_retailprice").cast("double").alias("price"), F.col("p_size").cast("double").alias("size"))


def lineitems(spark: SparkSession, sf_dir: str) -> Stack:
    """L: a supplier's sales by discount and tax, a non-negative matrix; absent cells are 0."""
    cells = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("sample"), (240 + 10 * F.round(F.col("l_discount") * 100)).cast("double").alias("ex"),
        (300 + 10 * F.round(F.col("l_tax") * 100)).cast("double").alias("em"), "l_extendedprice",
    )
    long = cells.groupBy("sample", "ex", "em").agg(F.sum("l_extendedprice").cast("double").alias("intensity"))
    ref = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sample"), F.col("s_acctbal").cast("double").alias("balance"))
    return fold(long, *axes_of(cells), fill=0.0, ref=ref)  # the grid is read from the rows themselves, before they are summed


#: A synthetic absorbance on five wavelengths: 0.01 + sample % 7 / 100 + (wavelength - 240) / 10000
ABSORBANCE_AXIS = (240.0, 280.0, 320.0, 350.0, 400.0)


def absorbances(stack: Stack) -> DataFrame:
    base = 0.01 + (F.col("sample") % 7) / 100.0
    return stack.frame.select("sample", F.array(*[base + (w - 240) / 10000.0 for w in ABSORBANCE_AXIS]).alias("absorbance"))
