"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

__all__ = ["KEY", "ascii_lower", "attach", "held_out", "materialize", "maybe_broadcast", "pieces", "read", "release", "row_key", "ship", "small"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A row is told from another by its id and this hash of its text.
KEY = "__row_key"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and cut its lineage.

    The folder is the one in spark.checkpoint.dir. Where none is set a local
    master (tests) gets a temporary one; a cluster, whose machines don't share
    such a folder, raises.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint"))
    return df.checkpoint(eager=True)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows, so that what is made of one at a time stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of frames that nothing refers to any more.

    Spark's cleaner finds them when the driver's JVM collects garbage, by
    default every half hour; between two steps that shuffle as much as the
    input that is too late for the executors' disks.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ascii_lower(col: Column) -> Column:
    """Lower case of A-Z alone. Texts without other capitals take the fast way, which changes nothing else in them."""
    others = col.rlike(r"[\P{ASCII}&&[\p{javaUpperCase}\p{Lt}]]")
    return F.when(others, F.translate(col, UPPER, LOWER)).otherwise(F.lower(col))


def row_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels no classifier may learn from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def small(df: DataFrame, bound: int) -> bool:
    """Whether df has at most bound rows; reads no more than it needs for that."""
    return df.limit(bound + 1).count() <= bound


def maybe_broadcast(df: DataFrame, bound: int = 200_000) -> DataFrame:
    """df, marked for broadcast if it is proven to have at most bound (narrow) rows."""
    return F.broadcast(df) if small(df, bound) else df


def attach(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, found): every row of docs with what was found for its id and text; found has id_col and __row_key, each pair once."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("__id"), row_key(F.col(text_col)).alias("__key"))
    rest = [c for c in found.columns if c not in (id_col, KEY)]
    said = found.select(F.col(id_col).alias("__of"), F.col(KEY).alias("__its"), F.struct(*rest).alias("found"))
    return rows.join(said, F.col("__id").eqNullSafe(F.col("__of")) & (F.col("__key") == F.col("__its"))).select("row", "found")
