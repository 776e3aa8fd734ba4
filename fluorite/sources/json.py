"""Stacks as JSON documents and Parquet tables; models as OpenFluor text."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..frames import Stack, numbers

SCHEMA = "eem_stack array<array<array<double>>>, ex_range array<double>, em_range array<double>, index array<string>, ref array<array<string>>, cluster array<string>"
NAN = float("nan")


def to_json(stack: Stack) -> DataFrame:
    """One row, one JSON document with the whole stack; NaN is null. For stacks that fit a document."""
    width = len(stack.em)
    place = W.orderBy("sample")
    clean = F.transform("intensity", lambda v: F.when(~F.isnan(v), v))
    matrix = F.array(*[F.slice(F.col("c"), i * width + 1, width) for i in range(len(stack.ex))])
    rows = stack.frame.withColumn("c", clean).withColumn("at", F.row_number().over(place)).select("at", "sample", "index", "cluster", matrix.alias("m"))
    ordered = rows.agg(F.array_sort(F.collect_list(F.struct("at", "m", F.coalesce("index", F.lit("")).alias("i"), F.coalesce("cluster", F.lit("")).alias("k")))).alias("r"), F.count("index").alias("ni"), F.count("cluster").alias("nk"))
    doc = [F.col("r.m").alias("eem_stack"), numbers(stack.ex).alias("ex_range"), numbers(stack.em).alias("em_range"), F.when(F.col("ni") > 0, F.col("r.i")).alias("index")]
    if stack.ref is not None:
        names = [c for c in stack.ref.columns if c != "sample"]
        cells = F.array(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("string")) for c in names])
        held = stack.ref.select("sample", cells.alias("v")).agg(F.array_sort(F.collect_list(F.struct("sample", "v"))).alias("rr"))
        ordered = ordered.join(F.broadcast(held))
        doc.append(F.concat(F.array(F.array(*[F.lit(n) for n in names])), F.col("rr.v")).alias("ref"))
    doc.append(F.when(F.col("nk") > 0, F.col("r.k")).alias("cluster"))
    return ordered.select(F.to_json(F.struct(*doc), {"ignoreNullFields": "false"}).alias("value"))


def write_json(stack: Stack, path: str) -> None:
    to_json(stack).coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> Stack:
    """The inverse of write_json; null pixels are NaN, references that aren't numbers too."""
    text = spark.read.text(path, wholetext=True).where(F.trim("value") != "")
    doc = text.select(F.from_json("value", SCHEMA).alias("d")).select("d.*")
    head = doc.select("ex_range", "em_range", F.get("ref", F.lit(0)).alias("names")).first()
    each = doc.select(F.posexplode("eem_stack").alias("at", "m"), "index", "cluster", "ref")
    flat = F.transform(F.flatten("m"), lambda v: F.coalesce(v, F.lit(NAN)))
    frame = each.select(F.col("at").cast("long").alias("sample"), F.get("index", F.col("at")).alias("index"), F.get("cluster", F.col("at")).alias("cluster"), flat.alias("intensity"))
    stack = Stack(frame, tuple(head["ex_range"]), tuple(head["em_range"]))
    if head["names"]:
        row = F.get("ref", F.col("at") + 1)
        ref = each.select(F.col("at").cast("long").alias("sample"), *[F.coalesce(F.get(row, F.lit(i)).try_cast("double"), F.lit(NAN)).alias(n) for i, n in enumerate(head["names"])])
        stack = replace(stack, ref=ref)
    return stack


def write_parquet(stack: Stack, path: str) -> None:
    """The stack as a table; the axes go along as columns that compress to nothing."""
    stack.frame.withColumn("ex_range", numbers(stack.ex)).withColumn("em_range", numbers(stack.em)).write.mode("overwrite").parquet(path)


def read_parquet(spark: SparkSession, path: str) -> Stack:
    table = spark.read.parquet(path)
    head = table.select("ex_range", "em_range").first()
    if head is None:
        raise ValueError(f"{path} is empty")
    return Stack(table.drop("ex_range", "em_range"), tuple(head["ex_range"]), tuple(head["em_range"]))


def openfluor_lines(ex: DataFrame, em: DataFrame, info: Mapping[str, str], spark: SparkSession, scores: DataFrame | None = None) -> DataFrame:
    """(place, value): the lines of a model file. ex and em: wavelength, component, value; scores: time, component, value."""
    head = ["#", "# Fluorescence model", "#", *[f"{k}\t{v}" for k, v in info.items()], "#"]
    first = spark.createDataFrame([(0, f"{i:09d}", line) for i, line in enumerate(head)], "part int, place string, value string")

    def rows(df: DataFrame, part: int, kind: str, key: str) -> DataFrame:
        packed = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("component", "value"))).alias("v"))
        line = F.concat_ws("\t", F.lit(kind), F.col(key).cast("string"), F.transform("v", lambda x: x["value"].cast("string")))
        order = F.row_number().over(W.orderBy(key))
        return packed.select(F.lit(part).alias("part"), F.format_string("%09d", order).alias("place"), line.alias("value"))

    out = first.unionByName(rows(ex, 1, "Ex", "wavelength")).unionByName(rows(em, 2, "Em", "wavelength"))
    if scores is not None:
        out = out.unionByName(rows(scores, 3, "Score", "time"))
    end = spark.createDataFrame([(4, "0", "# end #")], "part int, place string, value string")
    return out.unionByName(end).orderBy("part", "place")


def write_openfluor(path: str, **tables) -> None:
    openfluor_lines(**tables).select("value").coalesce(1).write.mode("overwrite").text(path)
