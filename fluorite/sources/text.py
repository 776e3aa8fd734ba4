"""Spectra and matrices in text files. Files are parsed by expressions on their lines; only Spark opens them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..frames import Stack, fold, nearest
from ..operators import kernels as K
from ..shipping import ship
from .workbook import read_workbook

NUMBER = r"\d+(?:\.\d+)?"
# strptime's letters and Spark's
_LETTERS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%f": "SSSSSS", "%j": "DDD", "%b": "MMM", "%B": "MMMM", "%p": "a", "%I": "hh"}


def spark_format(pattern: str) -> str:
    """A strptime pattern as Spark's; other letters are quoted."""
    out, i = "", 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two in _LETTERS:
            out, i = out + _LETTERS[two], i + 2
        else:
            out, i = out + (f"'{pattern[i]}'" if pattern[i].isalpha() else pattern[i]), i + 1
    return out


def base_name(path: Column) -> Column:
    return F.url_decode(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\+", "%2B"))


def label_of(name: Column, index_pos: tuple[int, int] | None, as_timestamp: bool = False, timestamp_format: str | None = None) -> Column:
    """A label from places of the file name, from 1 and inclusive; as a timestamp's text if asked."""
    if index_pos is None:
        return name
    label = F.substring(name, index_pos[0], index_pos[1] - index_pos[0] + 1)
    if not as_timestamp:
        return label
    return F.to_timestamp(label, spark_format(timestamp_format or "%Y-%m-%d-%H-%M")).cast("string")


def file_list(spark: SparkSession, folder: str, mandatory_keywords: str | Sequence[str] | None = None, optional_keywords: str | Sequence[str] | None = None) -> list[str]:
    """Names of files with all mandatory and any optional keyword, sorted."""
    from ..operators.samples import label_matches

    names = spark.read.format("binaryFile").load(folder).select(base_name(F.col("path")).alias("name"))
    return [r["name"] for r in names.where(label_matches(mandatory_keywords, optional_keywords, F.col("name"))).orderBy("name").collect()]


def _whole(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """name and lines of every file."""
    read = spark.read.text([paths] if isinstance(paths, str) else list(paths), wholetext=True)
    return read.select(base_name(F.input_file_name()).alias("name"), F.split(F.regexp_replace("value", "\r\n?", "\n"), "\n").alias("lines"))


def _cells(line: Column, delimiter: str | None) -> Column:
    if delimiter is None:
        return F.filter(F.split(F.trim(line), r"\s+"), lambda c: c != "")
    return F.transform(F.split(line, "\\Q" + delimiter + "\\E"), lambda c: F.trim(c))


def read_matrices(spark: SparkSession, paths: str | Sequence[str], delimiter: str | None = None, file_first_row: str = "ex") -> DataFrame:
    """name, ex, em, intensity of every pixel of matrix files.

    The first line is the header: its numbers are one axis (with a delimiter,
    its fields after the first that are numbers). A line whose first field is
    not a number is skipped. Other fields must be numbers, as many as the
    header has; anything else raises when it is read.
    """
    if file_first_row not in ("ex", "em"):
        raise ValueError("file_first_row must be ex or em")
    files = _whole(spark, paths)
    head = F.get("lines", F.lit(0))
    if delimiter is None:
        header = F.transform(F.regexp_extract_all(head, F.lit(NUMBER), F.lit(0)), lambda c: c.cast("double"))
    else:
        fields = F.slice(_cells(head, delimiter), 2, F.size(_cells(head, delimiter)))
        header = F.filter(F.transform(fields, lambda c: c.try_cast("double")), lambda c: c.isNotNull())
    rows = files.select("name", header.alias("header"), F.posexplode(F.slice("lines", 2, F.size("lines"))).alias("at", "line"))
    rows = rows.where(F.trim("line") != "").select("name", "header", "at", _cells(F.col("line"), delimiter).alias("cells"))
    first = F.get("cells", F.lit(0)).try_cast("double")
    data = rows.where(first.isNotNull()).select("name", "header", first.alias("row"), F.slice("cells", 2, F.size("cells")).alias("cells"))
    wrong = F.concat(F.lit("header and data differ in width in "), F.col("name"))
    checked = F.when(F.size("cells") == F.size("header"), F.col("cells")).otherwise(F.raise_error(wrong).cast("array<string>"))
    cells = data.select("name", "row", "header", F.posexplode(checked).alias("at", "cell"))
    value = F.coalesce(F.col("cell").try_cast("double"), F.raise_error(F.concat(F.lit("not a number in "), F.col("name"), F.lit(": "), F.col("cell"))).cast("double"))
    column = F.get("header", F.col("at"))
    ex, em = (column, F.col("row")) if file_first_row == "ex" else (F.col("row"), column)
    return cells.select("name", ex.alias("ex"), em.alias("em"), value.alias("intensity"))


def read_eem(spark: SparkSession, path: str, index_pos: tuple[int, int] | None = None, as_timestamp: bool = False, timestamp_format: str | None = None, delimiter: str | None = None, file_first_row: str = "ex") -> Stack:
    return read_eem_dataset(spark, path, index_pos=index_pos, as_timestamp=as_timestamp, timestamp_format=timestamp_format, delimiter=delimiter, file_first_row=file_first_row)


def read_eem_dataset(
    spark: SparkSession,
    folder_path: str,
    mandatory_keywords: str | Sequence[str] | None = None,
    optional_keywords: str | Sequence[str] | None = None,
    index_pos: tuple[int, int] | None = None,
    as_timestamp: bool = False,
    timestamp_format: str | None = None,
    delimiter: str | None = None,
    file_first_row: str = "ex",
    custom_filename_list: Sequence[str] | None = None,
    wavelength_alignment: bool = False,
    interpolation_method: str = "linear",
) -> Stack:
    """All matrices of a folder, in order of their names, as a stack.

    Files with other axes raise, unless wavelength_alignment brings all to one
    grid: the overlap of all, cut from the file with most points in it (the last
    of several), and interpolated.
    """
    from ..operators.samples import label_matches

    pixels = read_matrices(spark, folder_path, delimiter, file_first_row)
    pixels = pixels.where(F.col("name").isin(list(custom_filename_list))) if custom_filename_list else pixels.where(label_matches(mandatory_keywords, optional_keywords, F.col("name")))
    axes = pixels.groupBy("name").agg(F.array_sort(F.collect_set("ex")).alias("ex"), F.array_sort(F.collect_set("em")).alias("em")).persist()
    kinds = [(tuple(r["ex"]), tuple(r["em"])) for r in axes.groupBy("ex", "em").agg(F.max("name").alias("last")).orderBy("last").select("ex", "em").toLocalIterator()]  # axis-sized
    if not kinds:
        raise ValueError(f"no matching file in {folder_path}")
    names = axes.select("name").withColumn("sample", (F.row_number().over(W.orderBy("name")) - 1).cast("long"))
    labels = names.select("sample", label_of(F.col("name"), index_pos, as_timestamp, timestamp_format).alias("index"), F.lit(None).cast("string").alias("cluster"))
    if len(kinds) == 1:
        return fold(pixels.join(names, "name").select("sample", "ex", "em", "intensity"), *kinds[0], labels=labels)
    if not wavelength_alignment:
        raise ValueError(f"files have {len(kinds)} different grids; set wavelength_alignment")
    grid = [common_axis([k[i] for k in kinds]) for i in (0, 1)]
    return Stack(_aligned(pixels, names, grid, interpolation_method).join(labels, "sample").select("sample", "index", "cluster", "intensity"), *grid)


def _aligned(pixels: DataFrame, names: DataFrame, grid: Sequence[Sequence[float]], method: str) -> DataFrame:
    """sample and intensity on one grid, however many grids the files have: a row for each file, one pass."""
    ship(pixels.sparkSession)
    packed = pixels.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("ex", "em", "intensity"))).alias("p"))
    packed = packed.select("name", F.array_distinct("p.ex").alias("ex"), F.array_sort(F.array_distinct("p.em")).alias("em"), F.col("p.intensity").alias("intensity"))

    def run(batches):
        weights = {}
        for pdf in batches:
            out = []
            for ex, em, x in zip(pdf["ex"], pdf["em"], pdf["intensity"], strict=True):
                if len(x) != len(ex) * len(em):
                    raise ValueError("a file has a wavelength twice")
                kind = (tuple(ex), tuple(em))
                if kind not in weights:
                    if len(weights) > 256:
                        weights.clear()
                    weights[kind] = [K.axis_weights(axis, target, method) for axis, target in zip(kind, grid, strict=True)]
                out.append(K.resample(np.asarray(x, float).reshape(1, len(ex), len(em)), *weights[kind]).ravel().tolist())
            yield pdf[["sample"]].assign(intensity=out)

    return packed.join(names, "name").select("sample", "ex", "em", "intensity").mapInPandas(run, "sample long, intensity array<double>")


def common_axis(axes: Sequence[Sequence[float]]) -> tuple[float, ...]:
    """The overlap of all, as the axis with most points in it has it; of several the last."""
    low, high = max(min(a) for a in axes), min(max(a) for a in axes)
    if low > high:
        raise ValueError("the files' axes do not overlap")
    cut = [tuple(a[nearest(a, low) : nearest(a, high) + 1]) for a in axes]
    best = cut[0]
    for c in cut[1:]:
        if len(c) >= len(best):
            best = c
    return tuple(v for v in best if low <= v <= high)


def read_absorbances(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """name, wl, absorbance of two-column files; lines without a wavelength are skipped, a bad value is NaN."""
    lines = _whole(spark, paths).select("name", F.explode("lines").alias("line"))
    cells = lines.select("name", _cells(F.col("line"), None).alias("c"))
    wl = F.get("c", F.lit(0)).try_cast("double")
    return cells.where(wl.isNotNull()).select("name", wl.alias("wl"), F.coalesce(F.get("c", F.lit(1)).try_cast("double"), F.lit(float("nan"))).alias("absorbance"))


def read_abs(spark: SparkSession, path: str, index_pos: tuple[int, int] | None = None) -> tuple[DataFrame, tuple[float, ...]]:
    return read_abs_dataset(spark, path, mandatory_keywords=None, index_pos=index_pos)


def read_abs_dataset(
    spark: SparkSession,
    folder_path: str,
    mandatory_keywords: str | Sequence[str] | None = "ABS",
    optional_keywords: str | Sequence[str] | None = None,
    index_pos: tuple[int, int] | None = None,
    custom_filename_list: Sequence[str] | None = None,
    wavelength_alignment: bool = False,
    interpolation_method: str = "linear",
) -> tuple[DataFrame, tuple[float, ...]]:
    """(sample, index, absorbance array) in order of file names, and the axis; aligned axes extrapolate linearly."""
    from ..operators.samples import label_matches

    points = read_absorbances(spark, folder_path)
    points = points.where(F.col("name").isin(list(custom_filename_list))) if custom_filename_list else points.where(label_matches(mandatory_keywords, optional_keywords, F.col("name")))
    packed = points.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("wl", "absorbance"))).alias("p"))
    packed = packed.select("name", F.col("p.wl").alias("axis"), F.col("p.absorbance").alias("absorbance")).persist()
    axes = [tuple(r["axis"]) for r in packed.orderBy("name").select("axis").toLocalIterator()]
    if not axes:
        raise ValueError(f"no matching file in {folder_path}")
    numbered = packed.withColumn("sample", (F.row_number().over(W.orderBy("name")) - 1).cast("long")).withColumn("index", label_of(F.col("name"), index_pos))
    if len(set(axes)) == 1:
        return numbered.select("sample", "index", "absorbance"), axes[0]
    if not wavelength_alignment:
        raise ValueError(f"files have {len(set(axes))} different axes; set wavelength_alignment")
    target = common_axis(axes)
    ship(spark)

    def run(batches):
        for pdf in batches:
            out = []
            for axis, a in zip(pdf["axis"], pdf["absorbance"], strict=True):
                m = K.linear_weights(axis, target, "extrapolate") if interpolation_method == "linear" else K.axis_weights(axis, target, interpolation_method)
                out.append((m @ a).tolist())
            pdf["absorbance"] = out
            yield pdf[["sample", "index", "absorbance"]]

    return numbered.mapInPandas(run, "sample long, index string, absorbance array<double>"), target


def read_reference_from_text(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """(position, value) and the header: the first word of the first line; a value on each other line."""
    lines = _whole(spark, path).select(F.posexplode("lines").alias("at", "line"))
    head = lines.where("at = 0").select(F.get(F.split(F.trim("line"), r"\s+"), F.lit(0)).alias("h")).first()
    rows = lines.where("at > 0").where(F.trim("line") != "")
    return rows.select((F.row_number().over(W.orderBy("at")) - 1).cast("long").alias("position"), F.trim("line").cast("double").alias("value")), head["h"]


def read_reference_table(spark: SparkSession, path: str, stack: Stack) -> Stack:
    """A CSV or XLSX table whose first column is the label, left-joined to the samples; unmatched samples have NaN."""
    table = read_workbook(spark, path) if path.lower().endswith(".xlsx") else spark.read.csv(path, header=True)
    label, *names = table.columns
    values = table.select(F.col(label).alias("index"), *[F.col(c).try_cast("double").alias(c) for c in names]).dropDuplicates(["index"])
    joined = stack.frame.select("sample", "index").join(values, "index", "left")
    from dataclasses import replace

    return replace(stack, ref=joined.select("sample", *[F.coalesce(F.col(c), F.lit(float("nan"))).alias(c) for c in names]))


def companion(name: Column, keyword: str, other: str) -> Column:
    """The name of a sample's blank or absorbance file."""
    return F.replace(name, F.lit(keyword), F.lit(other))


def read_openfluor(spark: SparkSession, paths: str | Sequence[str]) -> dict[str, DataFrame]:
    """ex, em, scores and info of model files: name, then wavelength (time for scores), component and value; key and value for info.

    The first tab-separated field says what a line is; lines that start with #
    are comments.
    """
    lines = _whole(spark, paths).select("name", F.posexplode("lines").alias("at", "line")).where((F.trim("line") != "") & ~F.col("line").startswith("#"))
    cells = lines.select("name", "at", F.transform(F.split("line", "\t"), lambda c: F.trim(c)).alias("c"))
    kind = F.get("c", F.lit(0))

    def table(which: str, key: Column, name: str) -> DataFrame:
        some = cells.where(kind == which).select("name", key.alias(name), F.posexplode(F.slice("c", 3, F.size("c"))).alias("k", "v"))
        return some.where("v <> ''").select("name", name, (F.col("k") + 1).alias("component"), F.col("v").cast("double").alias("value"))

    second = F.get("c", F.lit(1))
    info = cells.where(~kind.isin("Ex", "Em", "Score")).select("name", kind.alias("key"), F.coalesce(second, F.lit("")).alias("value"))
    return {"ex": table("Ex", second.cast("double"), "wavelength"), "em": table("Em", second.cast("double"), "wavelength"), "scores": table("Score", second, "time"), "info": info}


def read_parafac_models(spark: SparkSession, folder: str, keyword: str) -> dict[str, DataFrame]:
    """Model files of a folder whose names have the keyword."""
    return read_openfluor(spark, [f"{folder.rstrip('/')}/{n}" for n in file_list(spark, folder, keyword)])


