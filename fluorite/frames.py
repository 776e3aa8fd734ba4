"""The data model: a stack of excitation-emission matrices as one row for each sample.

A row has sample (long), index (label), cluster and intensity, an array of
doubles in row-major order: excitation by emission, both ascending. NaN is a
missing pixel. The axes are an instrument's wavelengths; they are plain numbers
on the driver, so that a bound snapped to the grid is a constant in the plan.
All steps within a sample are narrow; only steps across samples shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shipping import ship

#: An axis longer than this isn't an instrument's.
LONGEST_AXIS = 20_000
SCHEMA = T.StructType([T.StructField("sample", T.LongType()), T.StructField("index", T.StringType()), T.StructField("cluster", T.StringType()), T.StructField("intensity", T.ArrayType(T.DoubleType()))])


#: Bytes of pixels that the rows of a partition have, where they come from narrower rows.
PART_BYTES = 16 << 20


def dealt(rows: DataFrame, pixels: int, key: str) -> DataFrame:
    """Rows that will have so many pixels each in enough partitions: a small file, which one task reads, can make a large stack."""
    n = -(-rows.count() * pixels * 8 // PART_BYTES)
    return rows.repartition(n, key) if n > 1 else rows


def nearest(axis: Sequence[float], target: float) -> int:
    """Place of the grid point nearest to target; of two equally near the lower."""
    a = np.asarray(axis, float)
    return int(np.argmin(np.abs(a - target)))


def numbers(values) -> Column:
    """A constant array of doubles."""
    return F.array(*[F.lit(float(v)) for v in np.asarray(values, float).ravel()])


def flags(values) -> Column:
    return F.array(*[F.lit(bool(v)) for v in np.asarray(values, bool).ravel()])


@dataclass(frozen=True)
class Stack:
    """A stack with its axes; ref has a row for each sample and a column for each reference variable."""

    frame: DataFrame
    ex: tuple[float, ...]
    em: tuple[float, ...]
    ref: DataFrame | None = field(default=None)

    def __post_init__(self) -> None:
        ship(self.frame.sparkSession)

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.ex), len(self.em)

    @property
    def spark(self) -> SparkSession:
        return self.frame.sparkSession

    @property
    def extent(self) -> tuple[float, float, float, float]:
        return min(self.em), max(self.em), min(self.ex), max(self.ex)

    @property
    def grid(self) -> tuple[np.ndarray, np.ndarray]:
        """Excitation and emission of every pixel, as matrices."""
        return np.meshgrid(np.array(self.ex), np.array(self.em), indexing="ij")

    def with_frame(self, frame: DataFrame) -> Stack:
        return replace(self, frame=frame)

    def with_intensity(self, column: Column, ex: Sequence[float] | None = None, em: Sequence[float] | None = None) -> Stack:
        frame = self.frame.withColumn("intensity", column)
        return replace(self, frame=frame, ex=tuple(ex if ex is not None else self.ex), em=tuple(em if em is not None else self.em))

    def map_kernel(self, kernel: Callable[[np.ndarray], np.ndarray], ex: Sequence[float] | None = None, em: Sequence[float] | None = None) -> Stack:
        """Applies kernel to (samples, ex, em) blocks on the executors, without a shuffle."""
        ex, em = tuple(ex if ex is not None else self.ex), tuple(em if em is not None else self.em)
        shape = self.shape
        names = self.frame.columns
        at = names.index("intensity")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = block(batch.column(at), shape)
                columns = list(batch.columns)
                columns[at] = arrays(kernel(x).reshape(len(x), -1))
                yield pa.RecordBatch.from_arrays(columns, names)

        return replace(self, frame=self.frame.mapInArrow(run, self.frame.schema), ex=ex, em=em)

    def pixels(self) -> DataFrame:
        """Long form: sample, ex_idx, em_idx, ex, em, intensity."""
        width = len(self.em)
        long = self.frame.select("sample", F.posexplode("intensity").alias("pos", "intensity"))
        ex_idx, em_idx = F.floor(F.col("pos") / width).cast("int"), (F.col("pos") % width).cast("int")
        return long.select("sample", ex_idx.alias("ex_idx"), em_idx.alias("em_idx"), F.get(numbers(self.ex), ex_idx).alias("ex"), F.get(numbers(self.em), em_idx).alias("em"), "intensity")

    def by_pixel(self) -> DataFrame:
        """sample, pos, intensity: for statistics over samples, which then combine before the shuffle."""
        return self.frame.select("sample", F.posexplode("intensity").alias("pos", "intensity"))

    def place(self, pos: Column) -> list[Column]:
        width = len(self.em)
        return [F.get(numbers(self.ex), F.floor(pos / width).cast("int")).alias("ex"), F.get(numbers(self.em), (pos % width).cast("int")).alias("em")]


def block(column: pa.Array, shape: tuple[int, int]) -> np.ndarray:
    """A list column as (rows, ex, em); null lists and items are NaN."""
    size = shape[0] * shape[1]
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == size * len(column) and not column.null_count:
        return flat.astype(float).reshape(len(column), *shape)
    out = np.full((len(column), size), np.nan)
    for i, row in enumerate(column.to_pylist()):
        if row is not None and len(row) == size:
            out[i] = [np.nan if v is None else v for v in row]
        elif row is not None:
            raise ValueError(f"a sample has {len(row)} pixels; the axes have {size}")
    return out.reshape(len(column), *shape)


def arrays(x: np.ndarray) -> pa.Array:
    ends = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(x, float).ravel()))


def axes_of(long: DataFrame) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Distinct values of ex and em, ascending, from the distinct pairs: one job."""
    most = 50 * LONGEST_AXIS
    pairs = long.select("ex", "em").where("ex is not null and em is not null").distinct().limit(most + 1).collect()
    ex, em = (tuple(sorted({float(p[i]) for p in pairs})) for i in (0, 1))
    if len(pairs) > most or max(len(ex), len(em)) > LONGEST_AXIS:
        raise ValueError(f"an axis has more than {LONGEST_AXIS} values, or the grid more than {most}")
    return ex, em


def fold(long: DataFrame, ex: Sequence[float] | None = None, em: Sequence[float] | None = None, fill: float = float("nan"), labels: DataFrame | None = None, ref: DataFrame | None = None) -> Stack:
    """A stack from rows (sample, ex, em, intensity). labels: sample, index, cluster.

    Pixels without a row are ``fill``, rows off the axes are left out, and of
    rows for the same pixel the largest counts.
    """
    if ex is None or em is None:
        found = axes_of(long)
        ex, em = ex if ex is not None else found[0], em if em is not None else found[1]
    ex, em = tuple(ex), tuple(em)
    width = len(em)
    pos = (F.array_position(numbers(ex), F.col("ex")) - 1) * width + F.array_position(numbers(em), F.col("em")) - 1
    cells = long.select(F.col("sample").cast("long").alias("sample"), pos.cast("int").alias("pos"), F.col("intensity").cast("double").alias("v")).where("pos >= 0")
    packed = cells.groupBy("sample").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("cells"))
    size = len(ex) * width
    ship(long.sparkSession)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat, counts = lists.flatten(), np.diff(lists.offsets.to_numpy())
            out = np.full((batch.num_rows, size), fill)
            out[np.repeat(np.arange(batch.num_rows), counts), flat.field(0).to_numpy()] = flat.field(1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), arrays(out)], ["sample", "intensity"])

    filled = packed.mapInArrow(spread, "sample long, intensity array<double>")
    if labels is None:
        frame = filled.select("sample", F.col("sample").cast("string").alias("index"), F.lit(None).cast("string").alias("cluster"), "intensity")
    else:
        frame = filled.join(labels, "sample", "left").select("sample", "index", "cluster", "intensity")
    return Stack(frame, ex, em, ref)


def from_numpy(spark: SparkSession, x: np.ndarray, ex: Sequence[float], em: Sequence[float], index: Sequence[str] | None = None, cluster: Sequence[str] | None = None, ref: DataFrame | None = None) -> Stack:
    """A small stack from a (samples, ex, em) array."""
    x = np.asarray(x, float)
    rows = [(i, str(index[i]) if index is not None else None, str(cluster[i]) if cluster is not None else None, [float(v) for v in x[i].ravel()]) for i in range(len(x))]
    return Stack(spark.createDataFrame(rows, SCHEMA), tuple(map(float, ex)), tuple(map(float, em)), ref)


def to_numpy(stack: Stack) -> np.ndarray:
    """All samples on the driver in order of sample; for small stacks."""
    rows = stack.frame.select("sample", "intensity").orderBy("sample").collect()
    return np.array([r["intensity"] for r in rows], float).reshape(len(rows), *stack.shape)
