"""Mixing sources to target weights: random keys, distributed prefix sums, exact cuts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import KEY, materialize, read, row_key

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets by water-filling over (source, source_size); one row for each source.

    Sources take the weights in turn by code point, a null source last. Targets
    share ``share`` of all words by weight; where that is above ``most`` times a
    source's size the target stops there and the excess goes to the others by
    weight. In order of cap / weight the capped sources come first, so running
    sums over the table of sources give the level at once.
    """
    table = F.array(*[F.lit(float(w)) for w in weights])
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.select("source", "source_size", F.element_at(table, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).alias("weight"))
    weighed = weighed.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after, every = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing), W.partitionBy()
    level = weighed.select(
        "*",
        (F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).alias("rest"),
        F.sum("weight").over(after).alias("open_weight"),
    ).withColumn("free", F.col("cap") * F.col("open_weight") >= F.col("weight") * F.col("rest"))
    first = level.withColumn("level", F.max(F.when(F.col("free"), F.col("rest") / F.col("open_weight"))).over(every))
    return first.select("source", "source_size", F.when(F.col("free"), F.col("weight") * F.col("level")).otherwise(F.col("cap")).alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    with_key: bool = False,
) -> DataFrame:
    """How many words of each document a mix takes.

    Returns id, size, source, source_size, target and taken, a row for each row
    of docs. Every document gets a random key, the md5 of seed and id
    (or text, without an id). Within a
    source documents stand in order of their keys; the first three hex digits
    are ranges of equal expected size, so a source with a third of all rows is
    split over 4096 of them. Prefix sums are range totals summed over ranges,
    plus a running sum within the range. A pass over a source is an epoch; the
    mix takes whole passes and then the first words up to the target, rounded
    to a word.

    Null or blank text: size 0, takes 0. Null source: a source of its own, last.
    Repeated rows and ties of keys stand by id, then size; which of two equal
    rows comes first does not show. Empty input: no rows. Other columns of docs
    are ignored, whatever their names. With ``with_key`` the hash of the text
    follows.
    """
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        row_key(F.col(text_col)).alias(KEY),
        F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.md5(F.col(text_col).cast("binary")), F.lit(""))).cast("binary")).alias("key"),
    ).withColumn("range", F.substring("key", 1, 3))
    rows = materialize(rows)
    ranges = materialize(rows.groupBy("source", "range").agg(F.sum("size").alias("words")))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    ahead = F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead")
    offsets = ranges.select("source", "range", ahead).alias("o").join(targets.alias("t"), F.expr("o.source <=> t.source")).select("o.source", "range", "ahead", "source_size", "target")
    within = W.partitionBy("source", "range").orderBy("key", F.col("id").asc_nulls_first(), "size").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = placed.alias("d").join(offsets.alias("o"), F.expr("d.source <=> o.source and d.range = o.range"))
    budget = F.round("target").cast("long")
    start = F.col("ahead") + F.col("before")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - epochs * F.col("source_size") - start
    taken = epochs * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest))
    return joined.select(F.col("d.id").alias(id_col), "size", F.col("d.source").alias(source_col), "source_size", "target", taken.cast("long").alias("taken"), *[KEY] * with_key)


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = {
    "op5_source_mix": r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), md5(text), '')) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight,
             2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, 1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE)
               - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM w),
f AS (SELECT *, cap * open_weight >= weight * rest AS free FROM l),
t AS (SELECT source, source_size,
             CASE WHEN free THEN weight * max(CASE WHEN free THEN rest / open_weight END) OVER () ELSE cap END AS target FROM f),
p AS (SELECT d.*, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS budget,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - start)) AS BIGINT) AS taken
FROM e
""",
}
QUERIES = {"op5_source_mix": op5_source_mix}
