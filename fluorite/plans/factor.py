"""Alternating non-negative factorisation of a stack.

Samples stay distributed. A pass solves every sample's scores on the current
components and returns, summed over samples, scores' cross products G and
scores times pixels T. These suffice to update all spectral factors on the
driver, so a sweep is one job whatever the number of samples, and nothing that
grows with them is collected.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frames import Stack, block
from ..operators.algebra import nnls, solve_scores

EPS = 1e-8


@dataclass
class Pass:
    """What a pass sums over samples."""

    t: np.ndarray  # (r, pixels)
    g: np.ndarray  # (r, r)
    xx: float
    top_bot: np.ndarray  # (r,) sums of top times bot
    bot_bot: np.ndarray
    lower: np.ndarray | None = None  # (r, pixels), the denominator of multiplicative updates


@dataclass
class ScoreRule:
    """How a sample's scores are solved."""

    non_negative: bool = True
    alpha: float = 0.0
    l1_ratio: float = 0.0
    gamma: np.ndarray | None = None  # by component, with the frame's column "prior"
    lam: np.ndarray | None = None  # by component, with pairs
    beta: np.ndarray | None = None
    loss: str = "frobenius"
    fill: int = 5  # rounds in which missing pixels take their fit

    def scores(self, x: np.ndarray, h: np.ndarray, prior: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Scores of rows x, and x with missing pixels filled."""
        if self.loss != "frobenius":
            x = np.nan_to_num(x)
            return multiplicative_scores(x, h, self.loss), x
        missing = np.isnan(x)
        g = h @ h.T
        full = np.where(missing, 0.0, x)
        for i in range(self.fill if missing.any() else 1):
            w = self._solve(full @ h.T, g, prior)
            if missing.any():
                full = np.where(missing, w @ h, x)
        return w, full

    def _solve(self, target: np.ndarray, g: np.ndarray, prior: np.ndarray | None) -> np.ndarray:
        l1, l2 = self.alpha * self.l1_ratio, self.alpha * (1 - self.l1_ratio)
        if not self.non_negative:
            return solve_scores(target, g, False, 1e-10 + l2)
        if self.gamma is None or prior is None:
            return nnls(g, target, l1=l1, l2=l2)
        w = np.empty_like(target)
        for i, p in enumerate(prior):  # a sample's prior may hold for some components only
            on = np.isfinite(p) & (self.gamma > 0)
            pull = np.where(on, self.gamma, 0)
            w[i] = nnls(g + np.diag(pull), (target[i] + pull * np.where(on, np.nan_to_num(p), 0))[None], l1=l1, l2=l2)[0]
        return w

    def pair_scores(self, top: np.ndarray, bot: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of pairs, drawn to top = beta * bot by lam."""
        g, r = h @ h.T, len(h)
        lam, beta = np.diag(self.lam), self.beta
        both = np.block([[g + lam, -lam * beta], [-lam * beta, g + lam * beta**2]])
        both = (both + both.T) / 2
        target = np.concatenate([np.nan_to_num(top) @ h.T, np.nan_to_num(bot) @ h.T], axis=1)
        w = nnls(both, target, l1=self.alpha * self.l1_ratio, l2=self.alpha * (1 - self.l1_ratio))
        return w[:, :r], w[:, r:]


def multiplicative_scores(x: np.ndarray, h: np.ndarray, loss: str, rounds: int = 60) -> np.ndarray:
    w = np.full((len(x), len(h)), max(float(x.mean()), EPS) / max(float(h.mean() * len(h)), EPS))
    for _ in range(rounds):
        up, down = beta_parts(x, w @ h, loss)
        w *= (up @ h.T) / np.maximum(down @ h.T, EPS)
    return w


def beta_parts(x: np.ndarray, fit: np.ndarray, loss: str) -> tuple[np.ndarray, np.ndarray]:
    fit = np.maximum(fit, EPS)
    if loss == "frobenius":
        return x, fit
    if loss == "kullback-leibler":
        return x / fit, np.ones_like(fit)
    if loss == "itakura-saito":
        return x / fit**2, 1 / fit
    raise ValueError(f"loss must be frobenius, kullback-leibler or itakura-saito; got {loss!r}")


def one_pass(frame: DataFrame, shape: tuple[int, int], h: np.ndarray, rule: ScoreRule) -> Pass:
    """One job. frame: intensity, and prior or partner (the pair's bottom sample) where the rule needs them; start: given scores, not solved."""
    r, p = h.shape
    columns = [c for c in ("intensity", "partner", "prior", "start") if c in frame.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, g, xx, tb, bb, low = np.zeros((r, p)), np.zeros((r, r)), 0.0, np.zeros(r), np.zeros(r), np.zeros((r, p))
        for batch in batches:
            if not batch.num_rows:
                continue
            at = {c: batch.column(i) for i, c in enumerate(columns)}
            x = block(at["intensity"], shape).reshape(batch.num_rows, -1)
            parts = []
            if "partner" in at:
                y = block(at["partner"], shape).reshape(batch.num_rows, -1)
                paired = ~np.isnan(y).all(axis=1)
                if paired.any():
                    u, v = rule.pair_scores(x[paired], y[paired], h)
                    parts += [(u, np.nan_to_num(x[paired])), (v, np.nan_to_num(y[paired]))]
                    tb += (u * v).sum(0)
                    bb += (v * v).sum(0)
                x = x[~paired]
            if "start" in at:
                parts.append((np.array(at["start"].to_pylist(), float), np.nan_to_num(x)))
            elif len(x):
                prior = np.array([q if q is not None else [np.nan] * r for q in at["prior"].to_pylist()], float) if "prior" in at else None
                parts.append(rule.scores(x, h, prior))
            for w, full in parts:
                g += w.T @ w
                xx += float((full * full).sum())
                if rule.loss == "frobenius":
                    t += w.T @ full
                else:
                    up, down = beta_parts(full, w @ h, rule.loss)
                    t += w.T @ up
                    low += w.T @ down
        flat = np.concatenate([t.ravel(), g.ravel(), [xx], tb, bb, low.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int64)), pa.array(flat)], ["at", "v"])

    sums = frame.select(*columns).mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
    flat = np.zeros(2 * r * p + r * r + 1 + 2 * r)
    flat[sums["at"].to_numpy()] = sums["v"].to_numpy()
    t, g, xx, tb, bb, low = np.split(flat, np.cumsum([r * p, r * r, 1, r, r]))
    return Pass(t.reshape(r, p), g.reshape(r, r), float(xx[0]), tb, bb, low.reshape(r, p))


def error_of(s: Pass, h: np.ndarray) -> float:
    """Squared residual of scores of the pass on components h."""
    return max(s.xx - 2 * float((s.t * h).sum()) + float((s.g * (h @ h.T)).sum()), 0.0)


def hals(target: np.ndarray, gram: np.ndarray, v: np.ndarray, prior: Mapping[int, np.ndarray] | None = None, gamma: Mapping[int, float] | float = 0.0, alpha: float = 0.0, l1_ratio: float = 0.0, fixed: tuple[int, ...] = (), most: int = 500, tol: float = 1e-8, floor: float = EPS) -> np.ndarray:
    """Rows of v >= floor for target = gram v, row by row in turns; priors draw their finite entries."""
    v = v.copy()
    l1, l2 = alpha * l1_ratio, alpha * (1 - l1_ratio)
    pulls = {}
    for k, p in (prior or {}).items():
        strength = gamma.get(k, 0.0) if isinstance(gamma, Mapping) else float(gamma)
        if strength > 0:
            p = np.asarray(p, float).ravel()
            on = np.isfinite(p)
            pulls[k] = (strength * on, strength * np.where(on, np.nan_to_num(p), 0))
    before = None
    for it in range(most):
        moved = 0.0
        for k in range(len(v)):
            if k in fixed or gram[k, k] < 1e-300:
                continue
            on, to = pulls.get(k, (0.0, 0.0))
            new = np.maximum(floor, (target[k] - gram[k] @ v + gram[k, k] * v[k] + to - l1) / (gram[k, k] + l2 + on))
            moved += float(((new - v[k]) ** 2).sum())
            v[k] = new
        if moved == 0 or (before is not None and moved < tol * before):
            break
        before = before or moved
    return v


def gram_times(frame: DataFrame, shape: tuple[int, int], m: np.ndarray) -> np.ndarray:
    """X'X m without X'X: one job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(m)
        for batch in batches:
            if batch.num_rows:
                x = np.nan_to_num(block(batch.column(0), shape).reshape(batch.num_rows, -1))
                total += x.T @ (x @ m)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int64)), pa.array(total.ravel())], ["at", "v"])

    sums = frame.select("intensity").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(m.size)
    out[sums["at"].to_numpy()] = sums["v"].to_numpy()
    return out.reshape(m.shape)


def right_vectors(stack: Stack, rank: int, rounds: int = 3, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The leading right singular vectors (pixels, rank) and singular values, by subspace iteration."""
    p = stack.shape[0] * stack.shape[1]
    k = min(p, rank + 8)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((p, k)))[0]
    for _ in range(rounds):
        q = np.linalg.qr(gram_times(stack.frame, stack.shape, q))[0]
    small = q.T @ gram_times(stack.frame, stack.shape, q)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values)[:rank]
    return q @ vectors[:, order], np.sqrt(np.maximum(values[order], 0))


def start_components(stack: Stack, rank: int, method: str = "svd", seed: int | None = None) -> np.ndarray:
    """(rank, pixels), non-negative.

    random; svd: absolute singular vectors; nndsvd: of the two signs of a
    singular pair the one whose halves have the larger product of norms, nndsvda
    with the mean for zeros, nndsvdar with small random numbers.
    """
    p = stack.shape[0] * stack.shape[1]
    rng = np.random.default_rng(seed if seed is not None else 0)
    if method == "random":
        return np.maximum(rng.random((rank, p)), EPS)
    v, sigma = right_vectors(stack, rank)
    if v.shape[1] < rank:
        v = np.concatenate([v, rng.random((p, rank - v.shape[1]))], axis=1)
        sigma = np.concatenate([sigma, np.full(rank - len(sigma), EPS)])
    if method == "svd":
        return np.maximum(np.abs(v.T) * np.sqrt(sigma)[:, None], 1e-6)
    if method not in ("nndsvd", "nndsvda", "nndsvdar"):
        raise ValueError(f"init must be random, svd, nndsvd, nndsvda or nndsvdar; got {method!r}")
    shape = stack.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * rank)
        for batch in batches:
            if batch.num_rows:
                u = np.nan_to_num(block(batch.column(0), shape).reshape(batch.num_rows, -1)) @ v
                total += np.concatenate([(np.maximum(u, 0) ** 2).sum(0), (np.minimum(u, 0) ** 2).sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * rank, dtype=np.int64)), pa.array(total)], ["at", "v"])

    sums = stack.frame.select("intensity").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
    norms = np.zeros(2 * rank)
    norms[sums["at"].to_numpy()] = sums["v"].to_numpy()
    h = np.zeros((rank, p))
    for k in range(rank):
        plus, minus = np.maximum(v[:, k], 0), np.maximum(-v[:, k], 0)
        if k == 0:
            h[0] = np.sqrt(sigma[0]) * np.abs(v[:, 0])
            continue
        a, b = np.sqrt(norms[k]) * np.linalg.norm(plus), np.sqrt(norms[rank + k]) * np.linalg.norm(minus)
        part = plus if a >= b else minus
        size = max(a, b) / max(sigma[k], EPS)
        h[k] = np.sqrt(sigma[k] * size) * part / max(np.linalg.norm(part), EPS)
    mean = float(h.mean())
    if method == "nndsvda":
        h[h < 1e-12] = mean
    elif method == "nndsvdar":
        h[h < 1e-12] = mean * rng.random(int((h < 1e-12).sum())) / 100
    return h


def rank_one(h: np.ndarray, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(ex, r) and (em, r): the leading singular pair of every component, its signs turned and cut at 0."""
    b, c = [], []
    for row in h:
        u, s, v = np.linalg.svd(row.reshape(shape), full_matrices=False)
        sign = 1 if u[:, 0].sum() + v[0].sum() >= 0 else -1
        b.append(np.maximum(sign * u[:, 0] * np.sqrt(s[0]), EPS))
        c.append(np.maximum(sign * v[0] * np.sqrt(s[0]), EPS))
    return np.array(b).T, np.array(c).T


def with_pairs(stack: Stack, kw_top: str | Sequence[int], kw_bot: str | Sequence[int]) -> DataFrame:
    """The frame with a pair's bottom sample in the row of its top one, as partner; samples in no pair stay."""
    from ..operators.samples import paired

    pairs = paired(stack.frame, kw_top, kw_bot)
    both = pairs.groupBy("pair").agg(F.max(F.when(F.col("side") == "top", F.col("sample"))).alias("top"), F.max(F.when(F.col("side") == "bot", F.col("sample"))).alias("bot")).where("top is not null and bot is not null")
    bottoms = stack.frame.select(F.col("sample").alias("bot"), F.col("intensity").alias("partner"))
    partner = both.join(bottoms, "bot").select(F.col("top").alias("sample"), "partner")
    rest = stack.frame.join(both.select(F.col("bot").alias("sample")), "sample", "left_anti")
    return rest.join(partner, "sample", "left")


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """The cheapest one-to-one matching of rows and columns: shortest augmenting paths with potentials."""
    cost = np.asarray(cost, float)
    if cost.shape[0] > cost.shape[1]:
        return sorted((i, j) for j, i in assignment(cost.T))
    n, m = cost.shape
    row_price, column_price = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for i in range(n):
        slack, parent, seen = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, last = i, -1
        rows = {i}
        while True:
            reduced = cost[row] - row_price[row] - column_price
            better = ~seen & (reduced < slack)
            slack[better], parent[better] = reduced[better], last
            j = int(np.argmin(np.where(seen, np.inf, slack)))
            step = slack[j]
            for x in rows:
                row_price[x] += step
            column_price[seen] -= step
            slack[~seen] -= step
            seen[j] = True
            if owner[j] < 0:
                break
            row, last = owner[j], j
            rows.add(row)
        while j >= 0:
            k = parent[j]
            owner[j] = i if k < 0 else owner[k]
            j = k
    return sorted((int(owner[j]), j) for j in range(m) if owner[j] >= 0)


def pearson_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a = a - a.mean(axis=1, keepdims=True)
    b = b - b.mean(axis=1, keepdims=True)
    size = np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))
    return np.divide(a @ b.T, size, out=np.zeros_like(size), where=size > 0)


def order_like(reference: Mapping[int, np.ndarray], h: np.ndarray) -> list[int]:
    """Which component goes to each place, so that those with a reference are most like it."""
    keys = list(reference)
    match = dict()
    for i, j in assignment(1 - pearson_rows(np.array([np.asarray(reference[k], float).ravel() for k in keys]), h)):
        match[keys[i]] = j
    free = [j for j in range(len(h)) if j not in match.values()]
    return [match[k] if k in match else free.pop(0) for k in range(len(h))]
