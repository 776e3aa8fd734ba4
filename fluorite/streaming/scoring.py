"""Scoring samples as they arrive: a fitted model's step is per sample, so it runs in any micro-batch."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..frames import SCHEMA, Stack
from ..operators.algebra import fit_components


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """Stacks written as Parquet into a folder, as a stream."""
    return spark.readStream.schema(SCHEMA).parquet(path)


def score_stream(stream: DataFrame, ex: tuple[float, ...], em: tuple[float, ...], components: np.ndarray) -> DataFrame:
    """sample, scores, fmax, intercept of a stream of samples; stateless."""
    return fit_components(Stack(stream, ex, em), components)
