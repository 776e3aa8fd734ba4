"""Selecting, ordering, splitting and combining samples."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..frames import Stack


def _restricted(stack: Stack, condition: Column) -> Stack:
    frame = stack.frame.where(condition)
    ref = stack.ref.join(frame.select("sample"), "sample", "left_semi") if stack.ref is not None else None
    return replace(stack, frame=frame, ref=ref)


def _listed(words: str | Sequence[str] | None) -> list[str]:
    return [] if words is None else [words] if isinstance(words, str) else list(words)


def label_matches(mandatory: str | Sequence[str] | None, optional: str | Sequence[str] | None, label: Column) -> Column:
    """Whether a label has all mandatory keywords, and one of the optional if there are any."""
    must, may = _listed(mandatory), _listed(optional)
    out = F.lit(True)
    for w in must:
        out = out & F.contains(label, F.lit(w))
    if may:
        out = out & reduce(lambda a, b: a | b, [F.contains(label, F.lit(w)) for w in may])
    return out


def filter_by_index(stack: Stack, mandatory_keywords: str | Sequence[str] | None = None, optional_keywords: str | Sequence[str] | None = None) -> Stack:
    return _restricted(stack, label_matches(mandatory_keywords, optional_keywords, F.col("index")))


def filter_by_cluster(stack: Stack, cluster_names: str | Sequence[str]) -> Stack:
    """Samples of the named clusters; ValueError if no sample has a cluster."""
    names = [str(c) for c in (cluster_names if isinstance(cluster_names, (list, tuple, set)) else [cluster_names])]
    if stack.frame.where("cluster is not null").isEmpty():
        raise ValueError("the stack has no clusters")
    return _restricted(stack, F.col("cluster").isin(names))


def sort_by_index(stack: Stack) -> DataFrame:
    """The frame with its order by label, then sample, as position from 0."""
    return stack.frame.withColumn("position", F.row_number().over(W.orderBy("index", "sample")) - 1)


def hash_order(seed: int | str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("sample").cast("string")).cast("binary"))


#: Rows that are put in order by one task.
IN_ORDER = 1 << 17


def placed(rows: DataFrame, seed: int | str | None) -> tuple[DataFrame, int]:
    """rows with their place from 0 by a seeded hash of the sample, or without a seed by the sample, and how many there are.

    Ranges of the order are numbered each on its own, and from where the rows
    of those before end: no task has all of them.
    """
    n = rows.count()
    k = -(-n // IN_ORDER)
    if seed is not None:
        digits = F.conv(F.substring(hash_order(seed), 1, 8), 16, 10).cast("long")
        at, order = F.floor(digits * k / (1 << 32)).cast("int"), [hash_order(seed), F.col("sample")]
    else:
        bounds = rows.agg(F.percentile_approx("sample", [i / k for i in range(1, k)], 100 * k)).first()[0] if k > 1 else []
        at, order = F.lit(0), [F.col("sample")]
        for b in bounds:
            at = at + (F.col("sample") > b).cast("int")
    ranged = rows.withColumn("__range", F.coalesce(at, F.lit(0)))
    sizes = {r["__range"]: r["count"] for r in ranged.groupBy("__range").count().collect()} if k > 1 else {}
    before, total = [], 0
    for i in range(max(k, 1)):
        before.append(total)
        total += sizes.get(i, 0)
    start = F.get(F.array(*[F.lit(v).cast("long") for v in before]), F.col("__range"))
    place = F.row_number().over(W.partitionBy("__range").orderBy(*order)) - 1 + start
    return ranged.withColumn("place", place).drop("__range"), n


def in_parts(rows: tuple[DataFrame, int], n_split: int) -> DataFrame:
    """Placed rows with split from 1: parts of equal size, the first ones longer by one, as ntile has them."""
    frame, n = rows
    size, longer = divmod(n, n_split)
    first = longer * (size + 1)
    place = F.col("place")
    split = F.when(place < first, F.floor(place / (size + 1))).otherwise(longer + F.floor((place - first) / max(size, 1))) + 1
    return frame.withColumn("split", split.cast("int"))


def split_numbers(stack: Stack, n_split: int, rule: str = "random", random_state: int | None = None, kw_top: str | Sequence[int] | None = None, kw_bot: str | Sequence[int] | None = None) -> DataFrame:
    """sample, split from 1: parts of equal size, the first ones longer by one.

    rule: random (by a seeded hash) or sequential. With kw_top and kw_bot the
    k-th samples of both keywords are a pair and stay together; others are left
    out.
    """
    if rule not in ("random", "sequential"):
        raise ValueError("rule should be either random or sequential")
    if (kw_top is None) != (kw_bot is None):
        raise ValueError("only one of kw_top and kw_bot is given")
    seed = (random_state if random_state is not None else 0) if rule == "random" else None
    if kw_top is None:
        return in_parts(placed(stack.frame.select("sample"), seed), n_split).select("sample", "split")
    pairs = paired(stack.frame, kw_top, kw_bot)
    sides = pairs.groupBy("side").count().collect()
    if len(sides) != 2 or sides[0]["count"] != sides[1]["count"]:
        raise ValueError("both keywords must match as many samples")
    tops = in_parts(placed(pairs.where("side = 'top'").select("sample", "pair"), seed), n_split).select("pair", "split")
    return pairs.join(tops, "pair").select("sample", "split")


def paired(frame: DataFrame, top: str | Sequence[int], bot: str | Sequence[int]) -> DataFrame:
    """sample, side (top, bot), pair: the place among the samples whose label has that keyword, or in a list of samples."""
    if isinstance(top, str):
        side = F.when(F.contains("index", F.lit(top)), "top").when(F.contains("index", F.lit(bot)), "bot")
        marked = frame.select("sample", side.alias("side")).where("side is not null")
        return marked.withColumn("pair", F.row_number().over(W.partitionBy("side").orderBy("sample")))
    if len(top) != len(bot):
        raise ValueError("both lists of samples must be as long")
    at = [F.array_position(F.array(*[F.lit(int(i)).cast("long") for i in ids]), F.col("sample")).cast("int") for ids in (top, bot)]
    marked = frame.select("sample", F.when(at[0] > 0, "top").when(at[1] > 0, "bot").alias("side"), F.when(at[0] > 0, at[0]).otherwise(at[1]).alias("pair"))
    return marked.where("side is not null")


def splitting(stack: Stack, n_split: int, **rule) -> list[Stack]:
    numbers = split_numbers(stack, n_split, **rule).persist()
    return [_among(stack, numbers.where(F.col("split") == i)) for i in range(1, n_split + 1)]


def _among(stack: Stack, chosen: DataFrame) -> Stack:
    ids = chosen.select("sample")
    ref = stack.ref.join(ids, "sample", "left_semi") if stack.ref is not None else None
    return replace(stack, frame=stack.frame.join(ids, "sample", "left_semi"), ref=ref)


def subsample_ids(stack: Stack, portion: float = 0.8, random_state: int = 0) -> DataFrame:
    """The int(n * portion) samples that come first by a seeded hash."""
    rows, n = placed(stack.frame.select("sample"), random_state)
    return rows.where(F.col("place") < int(n * portion)).select("sample")


def subsampling(stack: Stack, portion: float = 0.8, random_state: int = 0) -> Stack:
    return _among(stack, subsample_ids(stack, portion, random_state))


def combine(stacks: Sequence[Stack]) -> Stack:
    """All samples of all stacks, numbered anew in order; missing labels and clusters become N/A.

    ValueError if the axes differ. Reference variables of all stacks are kept;
    of two values for a label the first stack's counts.
    """
    first = stacks[0]
    if any(s.ex != first.ex or s.em != first.em for s in stacks):
        raise ValueError("the stacks have different axes")
    parts = [s.frame.select(F.lit(i).alias("part"), F.col("sample").alias("old"), "index", "cluster", "intensity") for i, s in enumerate(stacks)]
    every = reduce(DataFrame.unionByName, parts)
    placed = every.withColumn("sample", (F.row_number().over(W.orderBy("part", "old")) - 1).cast("long"))
    frame = placed.select("sample", F.coalesce("index", F.lit("N/A")).alias("index"), F.coalesce("cluster", F.lit("N/A")).alias("cluster"), "intensity")
    refs = [(i, s) for i, s in enumerate(stacks) if s.ref is not None]
    ref = None
    if refs:
        labelled = [s.ref.join(s.frame.select("sample", "index"), "sample").drop("sample").withColumn("part", F.lit(i)) for i, s in refs]
        every_ref = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), labelled)
        names = [c for c in every_ref.columns if c not in ("index", "part")]
        merged = every_ref.groupBy("index").agg(*[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("part"))).alias(c) for c in names])
        ref = frame.select("sample", "index").join(merged, "index", "left").drop("index")
    return Stack(frame, first.ex, first.em, ref)
