"""Trilinear and bilinear models of stacks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frames import Stack
from ..functions.sequences import random_split_columns
from ..operators import algebra as A
from ..operators import pixelwise as P
from .factor import EPS, Pass, ScoreRule, error_of, hals, one_pass, order_like, rank_one, start_components, with_pairs

Prior = Mapping[int, Sequence[float]]


def _each(value, rank: int) -> np.ndarray:
    return np.array([value.get(k, 0.0) for k in range(rank)] if isinstance(value, Mapping) else [float(value or 0)] * rank)


class Fitted:
    """What both models offer once they are fitted."""

    stack: Stack
    components: np.ndarray  # (r, ex, em), of maximum 1
    score: DataFrame  # sample, scores, fmax, intercept: refitted on the components
    fmax: DataFrame
    beta: np.ndarray | None
    kw_top: str | Sequence[int] | None  # a keyword of labels, or the samples themselves
    kw_bot: str | Sequence[int] | None

    @property
    def nnls_fmax(self) -> DataFrame:
        return self.score.select("sample", "fmax")

    def predict(self, stack: Stack, fit_intercept: bool = False, fit_beta: bool = False) -> DataFrame:
        """sample, scores, fmax, intercept of another stack; with fit_beta pairs are drawn to the model's ratios."""
        if not fit_beta:
            return A.fit_components(stack, self.components, fit_intercept)
        if self.beta is None or not (self.kw_top and self.kw_bot):
            raise ValueError("the model has no ratios of pairs")
        return paired_scores(stack, self.components, self.beta, self.kw_top, self.kw_bot)

    def component_peak_locations(self) -> list[tuple[float, float]]:
        """(ex, em) of every component's largest pixel, the first in row order of several."""
        where = [np.unravel_index(int(np.argmax(c)), c.shape) for c in self.components]
        return [(self.stack.ex[i], self.stack.em[j]) for i, j in where]

    def residual(self) -> DataFrame:
        return A.residual(self.stack, self.score, self.components)

    def sample_rmse(self) -> DataFrame:
        return A.sample_errors(self.stack, self.score, self.components).select("sample", "rmse")

    def sample_relative_rmse(self) -> DataFrame:
        return A.sample_errors(self.stack, self.score, self.components).select("sample", "relative_rmse")

    def _sort(self, h: np.ndarray) -> list[int]:
        shape = self.stack.shape
        peak = [int(np.unravel_index(int(np.argmax(c)), shape)[1]) for c in h]
        return sorted(range(len(h)), key=lambda k: (peak[k], k))

    def component_table(self) -> DataFrame:
        """component, ex, em, value."""
        rows = [(k, self.stack.ex[i], self.stack.em[j], float(v)) for k, c in enumerate(self.components) for (i, j), v in np.ndenumerate(c)]
        return self.stack.spark.createDataFrame(rows, "component int, ex double, em double, value double")


def paired_scores(stack: Stack, components: np.ndarray, beta: np.ndarray, kw_top, kw_bot) -> DataFrame:
    """Scores of both samples of each pair from one fit: top on beta times, bot on once the components."""
    from ..operators.samples import paired

    h = components.reshape(len(components), -1)
    largest = F.array(*[F.lit(float(v)) for v in h.max(axis=1)])
    gram = h @ h.T
    both = gram * np.outer(beta, beta) + gram
    projected = A.project(stack, h.T)
    pairs = A.side_by_side(projected.withColumnRenamed("projected", "scores"), paired(stack.frame, kw_top, kw_bot))

    def run(batches):
        for pdf in batches:
            if len(pdf):
                t, b = np.stack(pdf["top"].to_numpy()), np.stack(pdf["bot"].to_numpy())
                pdf["w"] = list(A.nnls(both, t * beta + b))
                yield pdf[["pair", "w"]]

    w = pairs.mapInPandas(run, "pair int, w array<double>")
    named = paired(stack.frame, kw_top, kw_bot).join(w, "pair")
    times = F.array(*[F.lit(float(v)) for v in beta])
    scores = F.when(F.col("side") == "top", F.zip_with("w", times, lambda x, y: x * y)).otherwise(F.col("w"))
    return named.select("sample", scores.alias("scores")).select("sample", "scores", F.zip_with("scores", largest, lambda x, y: x * y).alias("fmax"), F.lit(0.0).alias("intercept"))


def _prepared(stack: Stack, kw_top, kw_bot, prior: DataFrame | None) -> DataFrame:
    if (kw_top is None) != (kw_bot is None):
        raise ValueError("only one of kw_top and kw_bot is given")
    frame = with_pairs(stack, kw_top, kw_bot) if kw_top else stack.frame
    if prior is not None:
        frame = frame.join(prior.select("sample", "prior"), "sample", "left")
    return frame.persist()


def _held(stack: Stack, frame: DataFrame) -> Stack:
    """The stack with its persisted frame, so that starts don't make it anew; pairs have half of their samples in other rows."""
    return stack if "partner" in frame.columns else stack.with_frame(frame.select(*stack.frame.columns))


def _score_priors(w: DataFrame | None, a: DataFrame | None, flagged: Sequence[int], rank: int) -> DataFrame | None:
    """sample, prior: of rank-one components (flagged) a's entries, of others w's, NaN where there are none."""
    given = {"a": a, "w": w}
    sides = [d.select("sample", F.col("prior").alias(name)) for name, d in given.items() if d is not None]
    if not sides:
        return None
    both = sides[0] if len(sides) == 1 else sides[0].join(sides[1], "sample", "full")
    entries = []
    for k in range(rank):
        name = "a" if k in flagged else "w"
        entry = F.get(F.col(name), F.lit(k)) if given[name] is not None else F.lit(None).cast("double")
        entries.append(F.coalesce(entry, F.lit(float("nan"))))
    return both.select("sample", F.array(*entries).alias("prior"))


def _masked(stack: Stack, mask: np.ndarray | DataFrame) -> Stack:
    """Pixels that are false in mask become NaN: one mask for all samples, or sample and mask; samples without one stay."""
    nan = float("nan")
    if not isinstance(mask, DataFrame):
        return P._where(stack, ~np.asarray(mask, bool), nan)
    joined = stack.frame.join(mask.select("sample", F.col("mask").alias("__mask")), "sample", "left")
    own = F.zip_with("intensity", "__mask", lambda v, m: F.when(m, v).otherwise(F.lit(nan)))
    frame = joined.withColumn("intensity", F.when(F.col("__mask").isNull(), F.col("intensity")).otherwise(own))
    return stack.with_frame(frame.drop("__mask"))


@dataclass
class PARAFAC(Fitted):
    """Trilinear model: sample scores, excitation and emission loadings.

    solver: hals, mu (multiplicative), or als without non-negativity. Priors
    are vectors by component; NaN entries have none. prior_dict_sample: sample,
    prior (array). Ratios: the k-th samples of both keywords are a pair, drawn
    by lam to top = beta * bot. Missing pixels, and those that are false in mask
    (a matrix, or a table of sample and mask, an array of booleans), take their
    fit in every sweep. The start ordinary_cp is a fit without priors and pairs.
    """

    n_components: int
    non_negativity: bool = True
    solver: str = "hals"
    init: str = "svd"
    custom_init: tuple[np.ndarray, np.ndarray] | None = None  # ex and em loadings
    fixed_components: Sequence[int] = ()
    tf_normalization: bool = False
    loadings_normalization: str | None = "maximum"
    sort_components_by_em: bool = True
    alpha_sample: float = 0
    alpha_ex: float = 0
    alpha_em: float = 0
    l1_ratio: float = 1
    prior_dict_sample: DataFrame | None = None
    prior_dict_ex: Prior | None = None
    prior_dict_em: Prior | None = None
    gamma_sample: float | Mapping[int, float] = 0
    gamma_ex: float | Mapping[int, float] = 0
    gamma_em: float | Mapping[int, float] = 0
    ref_components: Mapping[int, np.ndarray] | None = None
    kw_top: str | Sequence[int] | None = None
    kw_bot: str | Sequence[int] | None = None
    lam: float | Mapping[int, float] = 0
    max_iter_als: int = 100
    tol: float = 1e-6
    max_iter_nnls: int = 500
    random_state: int | None = None
    mask: np.ndarray | DataFrame | None = None
    errors: list[float] = field(default_factory=list, init=False)

    def fit(self, stack: Stack) -> PARAFAC:
        if self.solver not in ("hals", "mu"):
            raise ValueError(f"solver must be hals or mu; got {self.solver!r}")
        self.stack, shape, r = stack, stack.shape, self.n_components
        work = P.tf_normalization(stack)[0] if self.tf_normalization else stack
        if self.mask is not None:
            work = _masked(work, self.mask)
        frame = _prepared(work, self.kw_top, self.kw_bot, self.prior_dict_sample)
        b, c = self._start(_held(work, frame))
        if self.ref_components:
            order = order_like(self.ref_components, _outer(b, c))
            b, c = b[:, order], c[:, order]
        paired = self.kw_top is not None
        self.beta = np.ones(r) if paired else None
        rule = ScoreRule(self.non_negativity, self.alpha_sample, self.l1_ratio, _each(self.gamma_sample, r) if self.prior_dict_sample is not None else None, _each(self.lam, r) if paired else None, self.beta)
        self.errors = []
        for _ in range(self.max_iter_als):
            # scale lives in the scores
            for m in (b, c):
                m /= np.maximum(np.linalg.norm(m, axis=0), EPS)
            s = one_pass(frame, shape, _outer(b, c), rule)
            self.errors.append(float(np.sqrt(error_of(s, _outer(b, c)) / max(s.xx, 1e-300))))
            if len(self.errors) > 1 and abs(self.errors[-2] - self.errors[-1]) < self.tol:
                break
            b, c = self._update(s, b, c)
            if paired:
                with np.errstate(invalid="ignore", divide="ignore"):
                    self.beta = np.clip(np.where(s.bot_bot > 0, s.top_bot / s.bot_bot, 1.0), 0.95, 2)
                rule.beta = self.beta
        self.last_pass = s
        frame.unpersist()
        if not self.non_negativity:  # of two signs the one that makes loadings positive
            for m in (b, c):
                m *= np.where(m.sum(axis=0) < 0, -1.0, 1.0)
        if self.loadings_normalization == "sd":
            b, c = b / np.maximum(b.std(axis=0), EPS), c / np.maximum(c.std(axis=0), EPS)
        elif self.loadings_normalization == "maximum":
            b, c = b / np.maximum(np.abs(b).max(axis=0), EPS), c / np.maximum(np.abs(c).max(axis=0), EPS)
        elif self.loadings_normalization is not None:
            raise ValueError(f"loadings_normalization must be maximum, sd or None; got {self.loadings_normalization!r}")
        if self.ref_components:
            order = order_like(self.ref_components, _outer(b, c))
        else:
            order = self._sort(_outer(b, c).reshape(r, *shape)) if self.sort_components_by_em else list(range(r))
        self.ex_loadings, self.em_loadings = b[:, order], c[:, order]
        self.beta = self.beta[order] if self.beta is not None else None
        self.components = _outer(self.ex_loadings, self.em_loadings).reshape(r, *shape)
        self.score = A.fit_components(stack, self.components, positive=self.non_negativity)
        self.fmax = self.score.select("sample", "fmax")
        return self

    def _start(self, stack: Stack) -> tuple[np.ndarray, np.ndarray]:
        if self.init == "custom":
            b, c = self.custom_init
            return np.array(b, float), np.array(c, float)
        if self.init == "random":
            rng = np.random.default_rng(self.random_state or 0)
            return tuple(np.maximum(rng.random((n, self.n_components)), EPS) for n in stack.shape)
        if self.init == "ordinary_cp":
            plain = PARAFAC(self.n_components, sort_components_by_em=False, max_iter_als=self.max_iter_als, tol=self.tol, random_state=self.random_state).fit(stack)
            return plain.ex_loadings.copy(), plain.em_loadings.copy()
        b, c = rank_one(start_components(stack, self.n_components, self.init, self.random_state), stack.shape)
        rng = np.random.default_rng(self.random_state or 0)  # no two components start alike
        return b * (1 + 0.01 * rng.random(b.shape)) + 1e-6, c * (1 + 0.01 * rng.random(c.shape)) + 1e-6

    def _update(self, s: Pass, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t = s.t.reshape(self.n_components, *self.stack.shape)
        fixed = tuple(self.fixed_components)
        for _ in range(2):
            for mode in (1, 2):
                own, other = (b, c) if mode == 1 else (c, b)
                target = np.einsum("rjk,kr->rj", t, c) if mode == 1 else np.einsum("rjk,jr->rk", t, b)
                gram = s.g * (other.T @ other)
                if not self.non_negativity:
                    new = np.linalg.lstsq(gram + 1e-12 * np.eye(len(gram)), target, rcond=None)[0]
                    new[list(fixed)] = own.T[list(fixed)]
                elif self.solver == "mu":
                    new = own.T.copy()
                    for _ in range(20):
                        step = new * target.clip(EPS) / np.maximum(gram @ new, EPS)
                        step[list(fixed)] = new[list(fixed)]
                        new = step
                else:
                    prior, gamma, alpha = (self.prior_dict_ex, self.gamma_ex, self.alpha_ex) if mode == 1 else (self.prior_dict_em, self.gamma_em, self.alpha_em)
                    new = hals(target, gram, own.T, prior, gamma, alpha, self.l1_ratio, fixed, self.max_iter_nnls)
                b, c = (new.T, c) if mode == 1 else (b, new.T)
        return b, c

    def variance_explained(self) -> float:
        return A.variance_explained(self.stack, self.score, self.components).first()["explained"]

    def core_consistency(self) -> float:
        """How near the least-squares core is to the superdiagonal one, in per cent."""
        sums = A.score_sums(self.stack, self.score).toPandas()
        r = self.n_components
        t = np.zeros((r, self.stack.shape[0] * self.stack.shape[1]))
        t[sums["component"], sums["pos"]] = sums["value"]
        core = np.linalg.pinv(A.gram_of(self.score)) @ t
        core = np.einsum("pj,rjk,qk->rpq", np.linalg.pinv(self.ex_loadings), core.reshape(r, *self.stack.shape), np.linalg.pinv(self.em_loadings))
        ideal = np.zeros_like(core)
        ideal[np.arange(r), np.arange(r), np.arange(r)] = 1
        return float(100 * (1 - ((core - ideal) ** 2).sum() / r))

    def leverage(self, mode: str = "sample"):
        """sample: a DataFrame; ex, em: arrays."""
        if mode == "sample":
            return A.leverage(self.score)
        if mode in ("ex", "em"):
            return A.matrix_leverage(self.ex_loadings if mode == "ex" else self.em_loadings)
        raise ValueError(f"mode must be sample, ex or em; got {mode!r}")

    def sample_summary(self) -> DataFrame:
        errors = A.sample_errors(self.stack, self.score, self.components)
        return self.score.select("sample", "scores", "fmax").join(self.leverage(), "sample").join(errors, "sample")

    def loading_tables(self) -> tuple[DataFrame, DataFrame]:
        """wavelength, component (from 1), value of both axes."""
        spark = self.stack.spark

        def table(axis: Sequence[float], m: np.ndarray) -> DataFrame:
            return spark.createDataFrame([(float(axis[i]), k + 1, float(v)) for (i, k), v in np.ndenumerate(m)], "wavelength double, component int, value double")

        return table(self.stack.ex, self.ex_loadings), table(self.stack.em, self.em_loadings)

    def export(self, path: str, info: Mapping[str, str]) -> None:
        from ..sources.json import write_openfluor

        ex, em = self.loading_tables()
        named = self.score.join(self.stack.frame.select("sample", "index"), "sample")
        scores = named.select(F.coalesce("index", F.col("sample").cast("string")).alias("time"), F.posexplode("scores").alias("component", "value"))
        write_openfluor(path, ex=ex, em=em, info=info, spark=self.stack.spark, scores=scores)


def _outer(b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.einsum("jr,kr->rjk", b, c).reshape(b.shape[1], -1)


@dataclass
class EEMNMF(Fitted):
    """Bilinear model: scores and component matrices.

    solver: cd or hals (both by coordinate), or mu with beta_loss. Components in
    fit_rank_one (True for all) are products of an excitation and an emission
    vector; priors of their scores are prior_dict_A, of the others' prior_dict_W
    (both sample, prior). Other parameters as in PARAFAC; priors of components
    are matrices. The starts ordinary_nmf and ordinary_cp are fits of a plain
    bilinear or trilinear model. custom_init may have scores (sample, scores)
    before the components; the components are then updated from them first.
    """

    n_components: int
    solver: str = "cd"
    init: str = "nndsvda"
    custom_init: np.ndarray | tuple[DataFrame, np.ndarray] | None = None  # components, or scores and components
    fixed_components: Sequence[int] = ()
    beta_loss: str = "frobenius"
    alpha_sample: float = 0
    alpha_component: float = 0
    l1_ratio: float = 1
    prior_dict_W: DataFrame | None = None
    prior_dict_A: DataFrame | None = None
    prior_dict_H: Mapping[int, np.ndarray] | None = None
    prior_dict_B: Prior | None = None
    prior_dict_C: Prior | None = None
    gamma_W: float | Mapping[int, float] = 0
    gamma_A: float | Mapping[int, float] = 0
    gamma_H: float | Mapping[int, float] = 0
    gamma_B: float | Mapping[int, float] = 0
    gamma_C: float | Mapping[int, float] = 0
    ref_components: Mapping[int, np.ndarray] | None = None
    kw_top: str | Sequence[int] | None = None
    kw_bot: str | Sequence[int] | None = None
    lam: float | Mapping[int, float] = 0
    fit_rank_one: bool | Mapping[int, bool] = False
    normalization: str | None = None
    sort_components_by_em: bool = True
    max_iter_als: int = 100
    max_iter_nnls: int = 500
    tol: float = 1e-5
    random_state: int = 42
    errors: list[float] = field(default_factory=list, init=False)

    def fit(self, stack: Stack) -> EEMNMF:
        if self.solver not in ("cd", "hals", "mu"):
            raise ValueError(f"solver must be cd, hals or mu; got {self.solver!r}")
        if self.beta_loss != "frobenius" and self.solver != "mu":
            raise ValueError("beta_loss needs solver mu")
        self.stack, shape, r = stack, stack.shape, self.n_components
        clean = stack.with_intensity(F.transform("intensity", lambda v: F.when(F.isnan(v) | (v < 0), F.lit(0.0)).otherwise(v)))
        scale = np.ones(shape[0] * shape[1])
        work = clean
        if self.normalization == "pixel_std":
            std = clean.by_pixel().groupBy("pos").agg(F.stddev_pop("intensity").alias("s")).orderBy("pos").collect()
            scale = np.array([row["s"] if row["s"] and row["s"] > 0 else 1.0 for row in std])
            table = F.array(*[F.lit(float(v)) for v in scale])
            work = clean.with_intensity(F.zip_with("intensity", table, lambda v, s: v / s))
        elif self.normalization is not None:
            raise ValueError(f"normalization must be pixel_std or None; got {self.normalization!r}")
        flagged = [k for k in range(r) if (self.fit_rank_one.get(k, False) if isinstance(self.fit_rank_one, Mapping) else self.fit_rank_one)]
        score_priors = _score_priors(self.prior_dict_W, self.prior_dict_A, flagged, r)
        frame = _prepared(work, self.kw_top, self.kw_bot, score_priors)
        begun = None
        if self.init == "custom":
            begun, parts = self.custom_init if isinstance(self.custom_init, tuple) else (None, self.custom_init)
            h = np.array(parts, float).reshape(r, -1) / scale
        elif self.init in ("ordinary_nmf", "ordinary_cp"):
            options = {"max_iter_als": self.max_iter_als, "tol": self.tol, "sort_components_by_em": False, "random_state": self.random_state}
            plain = EEMNMF(r, **options) if self.init == "ordinary_nmf" else PARAFAC(r, **options)
            h = plain.fit(work).components.reshape(r, -1)
        else:
            h = start_components(_held(work, frame), r, self.init, self.random_state)
        place = list(range(r))
        if self.ref_components:
            place = order_like(self.ref_components, h)
            h = h[place]
        b = c = None
        if flagged:
            b, c = rank_one(h[flagged], shape)
            h[flagged] = _outer(b, c)
        paired = self.kw_top is not None
        self.beta = np.ones(r) if paired else None
        pull = np.where(np.isin(np.arange(r), flagged), _each(self.gamma_A, r), _each(self.gamma_W, r)) if score_priors is not None else None
        rule = ScoreRule(True, self.alpha_sample, self.l1_ratio, pull, _each(self.lam, r) if paired else None, self.beta, self.beta_loss)
        priors = {k: np.asarray(p, float).ravel() / scale for k, p in (self.prior_dict_H or {}).items()}
        own_scale = priors or self.fixed_components or score_priors is not None  # then components may not be rescaled

        def update(s: Pass, h: np.ndarray) -> np.ndarray:
            nonlocal b, c
            held = list(self.fixed_components)
            if self.solver == "mu":
                new = h
                if self.beta_loss == "frobenius":
                    for _ in range(20):
                        new = new * s.t.clip(EPS) / np.maximum(s.g @ new, EPS)
                else:
                    new = new * s.t / np.maximum(s.lower, EPS)
                new[held] = h[held]
                return new
            h = h.copy()
            free = [k for k in range(r) if k not in flagged]
            if free:
                target = s.t[free] - s.g[np.ix_(free, flagged)] @ h[flagged]
                own = {i: priors[k] for i, k in enumerate(free) if k in priors}
                strength = {i: _each(self.gamma_H, r)[k] for i, k in enumerate(free)}
                fixed = tuple(i for i, k in enumerate(free) if k in held)
                h[free] = hals(target, s.g[np.ix_(free, free)], h[free], own, strength, self.alpha_component, self.l1_ratio, fixed, self.max_iter_nnls)
            if flagged:
                t = (s.t[flagged] - s.g[np.ix_(flagged, free)] @ h[free]).reshape(len(flagged), *shape)
                g = s.g[np.ix_(flagged, flagged)]
                inner = tuple(i for i, k in enumerate(flagged) if k in held)
                at = {k: i for i, k in enumerate(flagged)}
                pick = lambda d: {at[k]: v for k, v in (d or {}).items() if k in at}
                gb, gc = ({i: _each(v, r)[k] for i, k in enumerate(flagged)} for v in (self.gamma_B, self.gamma_C))
                b = hals(np.einsum("rjk,kr->rj", t, c), g * (c.T @ c), b.T, pick(self.prior_dict_B), gb, 0, 0, inner).T
                c = hals(np.einsum("rjk,jr->rk", t, b), g * (b.T @ b), c.T, pick(self.prior_dict_C), gc, 0, 0, inner).T
                h[flagged] = _outer(b, c)
            return h

        if begun is not None:
            scores = F.transform(F.array(*[F.lit(k) for k in place]), lambda k: F.get("scores", k))
            h = update(one_pass(work.frame.join(begun.select("sample", scores.alias("start")), "sample"), shape, h, ScoreRule(loss=self.beta_loss)), h)
        self.errors = []
        for _ in range(self.max_iter_als):
            size = np.ones(r) if own_scale else np.maximum(np.linalg.norm(h, axis=1), EPS)
            h = h / size[:, None]
            if flagged:
                b = b / np.sqrt(size[flagged])
                c = c / np.sqrt(size[flagged])
            s = one_pass(frame, shape, h, rule)
            self.errors.append(float(np.sqrt(error_of(s, h) / max(s.xx, 1e-300))) if self.beta_loss == "frobenius" else float("nan"))
            if len(self.errors) > 1 and abs(self.errors[-2] - self.errors[-1]) < self.tol:
                break
            before = h
            h = update(s, h)
            if self.beta_loss != "frobenius" and np.abs(h - before).max() < self.tol * np.abs(before).max():
                break
            if paired:
                with np.errstate(invalid="ignore", divide="ignore"):
                    self.beta = np.clip(np.where(s.bot_bot > 0, s.top_bot / s.bot_bot, 1.0), 0.95, 2)
                rule.beta = self.beta
        self.last_pass = s
        frame.unpersist()
        h = h * scale
        h = h / np.maximum(h.max(axis=1, keepdims=True), EPS)
        if self.ref_components:
            order = order_like(self.ref_components, h)
        else:
            order = self._sort(h.reshape(r, *shape)) if self.sort_components_by_em else list(range(r))
        self.components = h[order].reshape(r, *shape)
        self.beta = self.beta[order] if self.beta is not None else None
        self.stack = clean
        self.score = A.fit_components(clean, self.components)
        self.fmax = self.score.select("sample", "fmax")
        return self

    def variance_explained(self) -> float:
        """Centred, in per cent."""
        return A.variance_explained(self.stack, self.score, self.components).first()["explained_centred"]

    sample_normalized_rmse = Fitted.sample_relative_rmse


@dataclass
class HED:
    """Splits parent components into children that stay near them.

    child_structure_dict: parent to number of children; 0 keeps the parent as it
    is, 1 lets it move. Every child starts at, and has as a prior, its parent's
    spectrum. parent_scores (sample, scores): random parts of the parent's scores
    keep children apart; without them random changes of the spectra do.
    prior_dict_W (sample, prior, an entry for each parent) draws the scores of a
    parent's first child by gamma_W, which like gamma_H goes by child.
    """

    parent_components: np.ndarray
    child_structure_dict: Mapping[int, int]
    solver: str = "hals"
    gamma_H: float | Mapping[int, float] = 0
    kw_top: str | Sequence[int] | None = None
    kw_bot: str | Sequence[int] | None = None
    lam: float | Mapping[int, float] = 0
    normalization: str | None = None
    parent_scores: DataFrame | None = None
    prior_dict_W: DataFrame | None = None
    gamma_W: float | Mapping[int, float] = 0
    max_iter_als: int = 300
    max_iter_nnls: int = 300
    tol: float = 1e-6
    random_state: int | None = None

    def fit(self, stack: Stack) -> HED:
        parents = np.asarray(self.parent_components, float)
        order = [k for k, n in sorted(self.child_structure_dict.items()) for _ in range(max(int(n), 1))]
        still = [i for i, k in enumerate(order) if self.child_structure_dict[k] == 0]
        start = parents[order].reshape(len(order), -1)
        if self.parent_scores is None:
            noise = 1 + 0.2 * (np.random.default_rng(self.random_state or 0).random(start.shape) - 0.5)
            alone = np.array([order.count(k) == 1 for k in order])
            begin = np.where(alone[:, None], start, start * noise)
        else:
            begin = (self._child_scores(), start)
        drawn = None
        if self.prior_dict_W is not None:
            first = [F.get("prior", F.lit(k)) if order.index(k) == i else F.lit(None).cast("double") for i, k in enumerate(order)]
            drawn = self.prior_dict_W.select("sample", F.array(*first).alias("prior"))
        model = EEMNMF(
            len(order), self.solver, "custom", begin, still, prior_dict_W=drawn, gamma_W=self.gamma_W, prior_dict_H={i: parents[k] for i, k in enumerate(order)}, gamma_H=self.gamma_H, kw_top=self.kw_top, kw_bot=self.kw_bot,
            lam=self.lam, normalization=self.normalization, sort_components_by_em=False, max_iter_als=self.max_iter_als, max_iter_nnls=self.max_iter_nnls, tol=self.tol,
        )
        self.model = model.fit(stack)
        self.parents, self.components, self.score, self.fmax = order, model.components, model.score, model.fmax
        return self

    def _child_scores(self) -> DataFrame:
        """sample, scores: every parent's scores in random parts that sum to them, for its children."""
        sizes = {f"parent_{k}": int(n) for k, n in sorted(self.child_structure_dict.items())}
        wide = self.parent_scores.select("sample", *[F.get("scores", F.lit(int(k))).alias(f"parent_{k}") for k in sorted(self.child_structure_dict)])
        split = random_split_columns(wide, sizes, self.random_state or 0)
        return split.select("sample", F.array(*[c for c in split.columns if c != "sample"]).alias("scores"))


def renumbered(model: Fitted, order: Sequence[int]) -> Fitted:
    """The model with its components, loadings, scores and ratios in another order."""
    import copy

    out = copy.copy(model)
    order = list(order)
    out.components = model.components[order]
    if isinstance(model, PARAFAC):
        out.ex_loadings, out.em_loadings = model.ex_loadings[:, order], model.em_loadings[:, order]
    out.beta = model.beta[order] if model.beta is not None else None
    pick = F.array(*[F.lit(int(k)) for k in order])
    turn = lambda c: F.transform(pick, lambda i: F.get(c, i))
    out.score = model.score.select("sample", turn(F.col("scores")).alias("scores"), turn(F.col("fmax")).alias("fmax"), "intercept")
    out.fmax = out.score.select("sample", "fmax")
    return out
