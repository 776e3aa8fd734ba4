"""Linear algebra over stacks: factor products, non-negative fits, errors, comparisons of components."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frames import Stack, arrays, block
from ..shipping import ship


def khatri_rao(spark: SparkSession, a: Sequence[Sequence[float]], b: Sequence[Sequence[float]], weights: Sequence[float] | None = None) -> DataFrame:
    """i, j, component, value: products of the rows of two factors, component by component."""

    def rows(m: Sequence[Sequence[float]], name: str, value: str) -> DataFrame:
        data = [(i, k, float(v)) for i, r in enumerate(m) for k, v in enumerate(r)]
        return spark.createDataFrame(data, f"{name} int, component int, {value} double")

    out = rows(a, "i", "x").join(rows(b, "j", "y"), "component")
    w = F.lit(1.0) if weights is None else F.get(F.array(*[F.lit(float(v)) for v in weights]), F.col("component"))
    return out.select("i", "j", "component", (F.col("x") * F.col("y") * w).alias("value"))


def khatri_rao_matrix(matrices: Sequence[np.ndarray], weights: np.ndarray | None = None, skip: int | None = None) -> np.ndarray:
    """Column-wise Kronecker product of all matrices but one; the last varies fastest."""
    some = [np.asarray(m, float) for i, m in enumerate(matrices) if i != skip]
    out = some[0] if weights is None else some[0] * np.asarray(weights)
    for m in some[1:]:
        out = np.einsum("ir,jr->ijr", out, m).reshape(-1, out.shape[1])
    return out


def project(stack: Stack, matrix: np.ndarray) -> DataFrame:
    """sample, projected: every sample's pixels times a (pixels, r) matrix; narrow."""
    m, shape = np.asarray(matrix, float), stack.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = block(batch.column(1), shape).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), arrays(x @ m)], ["sample", "projected"])

    return stack.frame.select("sample", "intensity").mapInArrow(run, "sample long, projected array<double>")


def mttkrp(stack: Stack, mode: int, scores: DataFrame | None = None, b: Sequence[Sequence[float]] | None = None, c: Sequence[Sequence[float]] | None = None) -> DataFrame:
    """The unfolded stack times the Khatri-Rao product of the other factors.

    mode 0: sample, component, value, without a shuffle. mode 1 and 2: ex or em,
    component, value; samples are summed in every task before the shuffle.
    scores: sample and an array with a value for each component.
    """
    if mode not in (0, 1, 2):
        raise ValueError(f"mode must be 0, 1 or 2; got {mode}")
    if mode == 0:
        d = project(stack, khatri_rao_matrix([b, c]))
        return d.select("sample", F.posexplode("projected").alias("component", "value"))
    sums = score_sums(stack, scores)
    n_ex, n_em = stack.shape
    at_ex, at_em = F.floor(F.col("pos") / n_em).cast("int"), (F.col("pos") % n_em).cast("int")
    other = np.asarray(c if mode == 1 else b, float)
    table = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in other])
    weight = F.get(F.get(table, at_em if mode == 1 else at_ex), F.col("component"))
    key, axis, name = (at_ex, stack.ex, "ex") if mode == 1 else (at_em, stack.em, "em")
    value = F.get(F.array(*[F.lit(float(v)) for v in axis]), key)
    return sums.groupBy(value.alias(name), "component").agg(F.sum(F.col("value") * weight).alias("value"))


def score_sums(stack: Stack, scores: DataFrame) -> DataFrame:
    """component, pos, value: sum over samples of score times pixel."""
    shape = stack.shape
    joined = stack.frame.select("sample", "intensity").join(scores.select("sample", "scores"), "sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = block(batch.column(1), shape).reshape(batch.num_rows, -1)
                w = np.array(batch.column(2).to_pylist(), float)
                part = w.T @ x
                total = part if total is None else total + part
        if total is not None:
            r, p = total.shape
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(r, dtype=np.int32), p)), pa.array(np.tile(np.arange(p, dtype=np.int32), r)), pa.array(total.ravel())], ["component", "pos", "value"])

    parts = joined.mapInArrow(run, "component int, pos int, value double")
    return parts.groupBy("component", "pos").agg(F.sum("value").alias("value"))


def nnls(gram: np.ndarray, target: np.ndarray, most: int = 500, tol: float = 1e-12, l1: float = 0.0, l2: float = 0.0, start: np.ndarray | None = None) -> np.ndarray:
    """Rows w >= 0 that minimise w G w' / 2 - t w' + l1 sum(w) + l2 w w' / 2, by coordinate descent to convergence."""
    g = gram + l2 * np.eye(len(gram))
    t = target - l1
    r = len(g)
    if r <= 10 and start is None:  # all active sets, exactly
        return _enumerated(g, t)
    w = np.zeros_like(t) if start is None else start.copy()
    for _ in range(most):
        moved = 0.0
        for k in range(r):
            if g[k, k] <= 0:
                continue
            new = np.maximum(0, w[:, k] + (t[:, k] - w @ g[:, k]) / g[k, k])
            moved = max(moved, float(np.abs(new - w[:, k]).max(initial=0)))
            w[:, k] = new
        if moved <= tol * max(1.0, float(np.abs(w).max(initial=0))):
            break
    return w


def _enumerated(g: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The best of the least-squares fits on every set of components, for few of them; blocks of rows at once."""
    n, r = t.shape
    best, out = np.full(n, 0.0), np.zeros((n, r))
    for code in range(1, 1 << r):
        on = [k for k in range(r) if code >> k & 1]
        sub = g[np.ix_(on, on)]
        if np.linalg.cond(sub) > 1e14:
            continue
        w = np.linalg.solve(sub, t[:, on].T).T
        gain = np.einsum("nk,nk->n", w, t[:, on]) / 2
        better = (w >= 0).all(1) & (gain > best + 1e-12 * np.abs(best))
        best[better] = gain[better]
        out[better] = 0
        out[np.ix_(better, on)] = w[better]
    return out


def solve_scores(target: np.ndarray, gram: np.ndarray, non_negativity: bool = True, reg: float = 0.0) -> np.ndarray:
    if not non_negativity:
        return np.linalg.solve(gram + reg * np.eye(len(gram)), target.T).T
    return nnls(gram, target, l2=reg)


def mean_components(stack: Stack, by: Column | None = None) -> np.ndarray:
    """(components, ex, em): mean matrices of all samples, or of each group in order; as many numbers as groups have pixels."""
    grouped = stack.frame.select((by if by is not None else F.lit(0)).alias("g"), F.posexplode("intensity").alias("pos", "v")).groupBy("g", "pos").agg(F.avg("v").alias("v"))
    rows = grouped.orderBy("g", "pos").collect()
    return np.array([r["v"] for r in rows]).reshape(-1, *stack.shape)


def fit_components(stack: Stack, components: np.ndarray, fit_intercept: bool = False, positive: bool = True) -> DataFrame:
    """sample, scores, fmax, intercept: every sample on given components; NaN pixels count as 0. Narrow."""
    parts = np.nan_to_num(np.asarray(components, float)).reshape(len(components), -1)
    largest, shape = parts.max(axis=1), stack.shape
    mean = parts.mean(axis=1) if fit_intercept else np.zeros(len(parts))
    centred = parts - mean[:, None]
    gram = centred @ centred.T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.nan_to_num(block(batch.column(1), shape).reshape(batch.num_rows, -1))
            level = x.mean(axis=1) if fit_intercept else np.zeros(len(x))
            w = solve_scores((x - level[:, None]) @ centred.T, gram, positive)
            yield pa.RecordBatch.from_arrays([batch.column(0), arrays(w), arrays(w * largest), pa.array(level - w @ mean)], ["sample", "scores", "fmax", "intercept"])

    return stack.frame.select("sample", "intensity").mapInArrow(run, "sample long, scores array<double>, fmax array<double>, intercept double")


def reconstructed(stack: Stack, scores: DataFrame, components: np.ndarray) -> DataFrame:
    """sample, intensity, fitted: arrays side by side."""
    parts = np.asarray(components, float).reshape(len(components), -1)
    shape = stack.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = block(batch.column(1), shape).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), arrays(x), arrays(np.array(batch.column(2).to_pylist(), float) @ parts)], ["sample", "intensity", "fitted"])

    joined = stack.frame.select("sample", "intensity").join(scores.select("sample", "scores"), "sample")
    return joined.mapInArrow(run, "sample long, intensity array<double>, fitted array<double>")


def residual(stack: Stack, scores: DataFrame, components: np.ndarray) -> DataFrame:
    """sample, residual: intensity minus fit."""
    return reconstructed(stack, scores, components).select("sample", F.zip_with("intensity", "fitted", lambda x, y: x - y).alias("residual"))


def _squares(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v)


def sample_errors(stack: Stack, scores: DataFrame, components: np.ndarray) -> DataFrame:
    """sample, rmse, relative_rmse: the root mean square residual, and over the mean intensity."""
    both = reconstructed(stack, scores, components)
    rmse = F.sqrt(_squares(F.zip_with("intensity", "fitted", lambda x, y: x - y)) / F.size("intensity"))
    mean = F.aggregate("intensity", F.lit(0.0), lambda s, v: s + v) / F.size("intensity")
    return both.select("sample", rmse.alias("rmse"), F.try_divide(rmse, mean).alias("relative_rmse"))


def variance_explained(stack: Stack, scores: DataFrame, components: np.ndarray) -> DataFrame:
    """explained and explained_centred in per cent, over all pixels of all samples."""
    both = reconstructed(stack, scores, components)
    d = both.select(F.explode(F.arrays_zip("intensity", "fitted")).alias("p")).select(F.col("p.intensity").alias("x"), (F.col("p.intensity") - F.col("p.fitted")).alias("e"))
    agg = d.agg(F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("e") * F.col("e")).alias("ee"), F.var_pop("x").alias("vx"), F.var_pop("e").alias("ve"))
    return agg.select((100 * F.try_divide(F.col("xx") - F.col("ee"), F.col("xx"))).alias("explained"), (100 * (1 - F.try_divide("ve", "vx"))).alias("explained_centred"))


def gram_of(scores: DataFrame) -> np.ndarray:
    """Scores' cross products, r by r."""
    e = scores.select(F.posexplode("scores").alias("a", "x"), "scores").select("a", "x", F.posexplode("scores").alias("b", "y"))
    rows = e.groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("v")).collect()
    r = max(row["a"] for row in rows) + 1
    g = np.zeros((r, r))
    for row in rows:
        g[row["a"], row["b"]] = row["v"]
    return g


def leverage(scores: DataFrame) -> DataFrame:
    """sample, leverage: the diagonal of F (F'F)^-1 F'."""
    inverse = np.linalg.pinv(gram_of(scores))
    r = len(inverse)
    value = sum((F.get("scores", F.lit(a)) * F.get("scores", F.lit(b)) * float(inverse[a, b]) for a in range(r) for b in range(r)), F.lit(0.0))
    return scores.select("sample", value.alias("leverage"))


def matrix_leverage(factor: np.ndarray) -> np.ndarray:
    f = np.asarray(factor, float)
    return np.einsum("ir,rs,is->i", f, np.linalg.pinv(f.T @ f), f)


def side_by_side(scores: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair, top, bot: score arrays of the samples of a pair."""
    named = scores.select("sample", "scores").join(pairs, "sample")
    t, b = (named.where(F.col("side") == s).select("pair", F.col("scores").alias(s)) for s in ("top", "bot"))
    return t.join(b, "pair")


def beta_ratio(scores: DataFrame, pairs: DataFrame, r: int, bounds: tuple[float, float] = (0.95, 2.0)) -> DataFrame:
    """component, beta: sum of top times bot over that of bot squared, within bounds."""
    both = side_by_side(scores, pairs).select(F.posexplode(F.arrays_zip("top", "bot")).alias("component", "p"))
    ratio = F.try_divide(F.sum(F.col("p.top") * F.col("p.bot")), F.sum(F.col("p.bot") * F.col("p.bot")))
    return both.where(F.col("component") < r).groupBy("component").agg(F.greatest(F.lit(bounds[0]), F.least(F.lit(bounds[1]), ratio)).alias("beta"))


def quenching(scores: DataFrame, pairs: DataFrame, r: int) -> DataFrame:
    """pair, ratio: top over bot for every component."""
    return side_by_side(scores, pairs).select("pair", F.transform(F.sequence(F.lit(0), F.lit(r - 1)), lambda k: F.try_divide(F.get("top", k), F.get("bot", k))).alias("ratio"))


def similarity(a: DataFrame, b: DataFrame, key: str, kind: str = "pearson") -> DataFrame:
    """a, b, similarity of all components of two tables (component, key, value)."""
    x, y = a.select(F.col("component").alias("a"), key, F.col("value").alias("x")), b.select(F.col("component").alias("b"), key, F.col("value").alias("y"))
    if kind == "pearson":
        value = F.corr("x", "y")
    elif kind == "tucker":
        value = F.try_divide(F.sum(F.col("x") * F.col("y")), F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("y") * F.col("y"))))
    else:
        raise ValueError(f"kind must be pearson or tucker; got {kind!r}")
    return x.join(y, key).groupBy("a", "b").agg(value.alias("similarity"))


def seen_by(labels: DataFrame) -> DataFrame:
    """sample, seen: the runs that have a sample, with its label in each, in order of runs; labels: run, sample, label, a row for each sample of a run."""
    known = labels.where("run is not null and sample is not null")
    return known.groupBy("sample").agg(F.array_sort(F.collect_list(F.struct("run", "label"))).alias("seen"))


def label_codes(*blocks: pa.Array) -> list[np.ndarray]:
    """Lists of runs and labels as matrices of samples by runs, with the same numbers for the same labels: -1 is a null label, -2 a run without the sample."""
    every = pa.concat_arrays([*blocks])
    flat = every.flatten()
    run = flat.field(0).dictionary_encode()
    label = flat.field(1).dictionary_encode().indices.fill_null(-1)
    out = np.full((len(every), len(run.dictionary)), -2, np.int32)
    out[np.repeat(np.arange(len(every)), np.diff(every.offsets.to_numpy())), run.indices.to_numpy()] = label.to_numpy()
    return np.split(out, np.cumsum([len(b) for b in blocks])[:-1])


def agreement(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every row of a and of b in how many runs their labels are the same, and in how many both are."""
    same, runs = (np.zeros((len(a), len(b)), np.int32) for _ in range(2))
    for x, y in zip(a.T, b.T, strict=True):
        runs += (x > -2)[:, None] & (y > -2)
        same += (x[:, None] == y) & (x >= 0)[:, None]
    return same, runs


#: Rows of a block, and how many pairs of rows are held at a time.
BLOCK, HELD_PAIRS = 1024, 1 << 16


def _pairs_of_blocks(rows: DataFrame, key: str, both_ways: bool) -> DataFrame:
    """(a, b, left, right): blocks of rows as arrays, every two of them in a row, a <= b or both ways."""
    ship(rows.sparkSession)
    rows = rows.persist()
    n = max(1, -(-rows.count() // BLOCK))
    blocks = rows.groupBy(F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("a")).agg(F.collect_list(F.struct(*rows.columns)).alias("left"))
    left = blocks.withColumn("b", F.explode(F.sequence(F.lit(0) if both_ways else F.col("a"), F.lit(n - 1))))
    right = blocks.select(F.col("a").alias("b"), F.col("left").alias("right"))
    return left.join(right, "b").select("a", "b", "left", "right").repartition(min(1024, n * n if both_ways else n * (n + 1) // 2))


def consensus(labels: DataFrame) -> DataFrame:
    """i, j, together, runs, consensus of every two samples that a run has; labels: run, sample, label, a row for each sample of a run.

    Samples are dealt to blocks, and pairs of blocks to tasks: what is shuffled
    are blocks, and a task holds two blocks and a bounded number of pairs.
    """
    pairs = _pairs_of_blocks(seen_by(labels), "sample", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                left, right = (batch.column(c)[k].values for c in (2, 3))
                x, y = (side.field(0).to_numpy() for side in (left, right))
                a, b = label_codes(left.field(1), right.field(1))
                step = max(1, HELD_PAIRS // len(y))
                for at in range(0, len(x), step):
                    same, runs = agreement(a[at : at + step], b)
                    wanted = runs > 0
                    if batch.column(0)[k] == batch.column(1)[k]:
                        wanted &= x[at : at + step, None] < y
                    i, j = np.nonzero(wanted)
                    one, other = x[at + i], y[j]
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (np.minimum(one, other), np.maximum(one, other), same[i, j], runs[i, j])], ["i", "j", "together", "runs"])

    kind = labels.schema["sample"].dataType.simpleString()
    found = pairs.mapInArrow(run, f"i {kind}, j {kind}, together int, runs int")
    return found.select("i", "j", F.col("together").cast("long").alias("together"), F.col("runs").cast("long").alias("runs"), (F.col("together") / F.col("runs")).alias("consensus"))


def consensus_silhouette(labels: DataFrame, clusters: DataFrame) -> DataFrame:
    """sample, silhouette on distances of 1 - consensus, as silhouette() gives from all pairs that a run has; clusters: sample, label.

    Samples of a cluster with the same labels in the same runs are as far from
    all others; they are one class, and sums are over pairs of classes.
    """
    named = seen_by(labels).join(clusters.select("sample", F.col("label").alias("cluster")), "sample")
    classes = named.groupBy("seen", "cluster").agg(F.min("sample").alias("key"), F.count(F.lit(1)).alias("n"))
    pairs = _pairs_of_blocks(classes.select("key", "seen", "n", "cluster"), "key", True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                left, right = (batch.column(c)[k].values for c in (2, 3))
                x, y = (side.field(0).to_numpy() for side in (left, right))
                a, b = label_codes(left.field(1), right.field(1))
                n, of = right.field(2).to_numpy(), right.field(3).dictionary_encode()
                at_cluster = np.where(of.indices.is_null(), len(of.dictionary), of.indices.fill_null(0).to_numpy())
                to = np.eye(len(of.dictionary) + 1)[at_cluster]  # the last is null
                step = max(1, HELD_PAIRS // len(y))
                for at in range(0, len(x), step):
                    same, runs = agreement(a[at : at + step], b)
                    others = np.where(runs > 0, n - (x[at : at + step, None] == y), 0)
                    far = np.where(runs > 0, 1 - same / np.maximum(runs, 1), 0.0)
                    count, total = others @ to, (others * far) @ to
                    i, j = np.nonzero(count)
                    names = pa.concat_arrays([of.dictionary, pa.nulls(1, of.dictionary.type)])
                    yield pa.RecordBatch.from_arrays([pa.array(x[at + i]), names.take(pa.array(j)), pa.array(total[i, j]), pa.array(count[i, j])], ["key", "other", "total", "n"])

    kinds = named.schema["sample"].dataType.simpleString(), named.schema["cluster"].dataType.simpleString()
    sums = pairs.mapInArrow(run, f"key {kinds[0]}, other {kinds[1]}, total double, n double").groupBy("key", "other").agg((F.sum("total") / F.sum("n")).alias("d"))
    means = sums.join(classes.select("key", "cluster"), "key")
    value = _silhouette_of(means, "key", "cluster", "other").join(classes, "key").select("silhouette", F.col("seen").alias("__seen"), F.col("cluster").alias("__cluster"))
    return named.join(value, F.col("seen").eqNullSafe(F.col("__seen")) & F.col("cluster").eqNullSafe(F.col("__cluster"))).select("sample", "silhouette")


def silhouette(distance: DataFrame, labels: DataFrame) -> DataFrame:
    """sample, silhouette from distances of pairs (i < j) and labels; 0 for a sample alone in its cluster."""
    both = distance.select("i", "j", "distance").union(distance.select(F.col("j").alias("i"), F.col("i").alias("j"), "distance"))
    named = both.join(labels.select(F.col("sample").alias("i"), F.col("label").alias("li")), "i").join(labels.select(F.col("sample").alias("j"), F.col("label").alias("lj")), "j")
    means = named.groupBy("i", "li", "lj").agg(F.avg("distance").alias("d"))
    return _silhouette_of(means, "i", "li", "lj").withColumnRenamed("i", "sample")


def _silhouette_of(means: DataFrame, key: str, own: str, other: str) -> DataFrame:
    """key, silhouette from its mean distances d to its own cluster and to others."""
    s = means.groupBy(key).agg(F.max(F.when(F.col(own) == F.col(other), F.col("d"))).alias("a"), F.min(F.when(F.col(own) != F.col(other), F.col("d"))).alias("b"))
    most = F.greatest("a", "b")
    value = F.when(F.col("a").isNull() | F.col("b").isNull() | (most == 0), 0.0).otherwise(F.try_divide(F.col("b") - F.col("a"), most))
    return s.select(key, value.alias("silhouette"))


def unfold_by_mode(tensor: np.ndarray, mode: int) -> np.ndarray:
    """The mode's fibres as rows; the other modes keep their order."""
    if not 0 <= mode < np.ndim(tensor):
        raise ValueError(f"a tensor of {np.ndim(tensor)} modes has no mode {mode}")
    return np.moveaxis(tensor, mode, 0).reshape(np.shape(tensor)[mode], -1)


def masked_norm_error(stack: Stack, scores: DataFrame, components: np.ndarray, mask: np.ndarray | None = None) -> DataFrame:
    """error: the Frobenius norm of the residual where mask is true; one row."""
    if mask is not None and np.shape(mask) != stack.shape:
        raise ValueError(f"the mask is {np.shape(mask)}; a sample is {stack.shape}")
    keep = F.array(*[F.lit(float(m)) for m in (np.ones(stack.shape) if mask is None else np.asarray(mask, bool)).ravel()])
    rest = F.zip_with(F.zip_with("intensity", "fitted", lambda x, y: x - y), keep, lambda e, m: e * m)
    return reconstructed(stack, scores, components).agg(F.sqrt(F.sum(_squares(rest))).alias("error"))


def replace_factor_with_prior(factors: Sequence[np.ndarray], prior: Sequence[float], mode: int, rank: int | str = "best-fit", unfolded: np.ndarray | None = None, frozen: int | None = None) -> tuple[list[np.ndarray], int]:
    """The factors with one column of a mode replaced by the prior, and which column it was.

    best-fit takes the column most correlated with the prior. With the mode's
    unfolding the columns of the other of two factors are fitted anew to what
    the kept column leaves (all of them, or all but a frozen one), negatives 0.
    """
    out = [np.array(f, float) for f in factors]
    p = np.asarray(prior, float)
    if rank == "best-fit":
        size = [np.corrcoef(p, column)[0, 1] for column in out[mode].T]
        rank = int(np.nanargmax(size))
    out[mode][:, rank] = p
    if unfolded is not None and len(out) == 2:
        other = 1 - mode
        data = np.asarray(unfolded, float) if mode == 0 else np.asarray(unfolded, float).T
        free = [k for k in range(out[mode].shape[1]) if k != frozen]
        rest = data - (np.outer(out[mode][:, frozen], out[other][:, frozen]) if frozen is not None else 0)
        out[other][:, free] = np.maximum(0, np.linalg.lstsq(out[mode][:, free], rest, rcond=None)[0].T)
    return out, rank
