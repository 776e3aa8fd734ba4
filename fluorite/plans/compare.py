"""Comparing and aligning components; split validation."""

from __future__ import annotations

import copy
import itertools
import string
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frames import Stack
from ..operators import kernels as K
from ..operators import samples as S
from ..operators import stats as T
from .factor import assignment, pearson_rows
from .models import PARAFAC, Fitted, renumbered


def congruence_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    size = np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))
    return np.divide(a @ b.T, size, out=np.zeros_like(size), where=size > 0)


def loadings_similarity(loadings1: np.ndarray, loadings2: np.ndarray, axis1: Sequence[float] | None = None, axis2: Sequence[float] | None = None, wavelength_alignment: bool = False, kind: str = "pearson") -> np.ndarray:
    """(r1, r2) similarity of columns; aligned, the coarser axis goes to the finer inside their overlap."""
    a, b = np.asarray(loadings1, float), np.asarray(loadings2, float)
    if wavelength_alignment:
        if axis1 is None or axis2 is None:
            raise ValueError("alignment needs both axes")
        fine, coarse = (axis1, axis2) if len(axis1) >= len(axis2) else (axis2, axis1)
        keep = [i for i, x in enumerate(fine) if min(coarse) <= x <= max(coarse)]
        m = K.linear_weights(coarse, [fine[i] for i in keep])
        a, b = (a[keep], m @ b) if len(axis1) >= len(axis2) else (m @ a, b[keep])
    return (pearson_rows if kind == "pearson" else congruence_rows)(a.T, b.T)


def component_similarity(components1: np.ndarray, components2: np.ndarray, kind: str = "pearson") -> np.ndarray:
    a, b = (np.asarray(c, float).reshape(len(c), -1) for c in (components1, components2))
    return (pearson_rows if kind == "pearson" else congruence_rows)(a, b)


def _matched(similar: np.ndarray) -> list[int]:
    """Order of the model's components (columns) by the references (rows); those without one come last."""
    pairs = dict(assignment(1 - similar))
    order = [pairs[i] for i in range(similar.shape[0]) if i in pairs]
    return order + [j for j in range(similar.shape[1]) if j not in order]


def align_components_by_components(models: Mapping[object, Fitted], reference: np.ndarray) -> dict:
    """Models with components, scores and loadings in the order of the reference components most like them."""
    return {k: renumbered(m, _matched(component_similarity(reference, m.components))) for k, m in models.items()}


def align_components_by_loadings(models: Mapping[object, PARAFAC], ex_ref: np.ndarray, em_ref: np.ndarray, ex_axis: Sequence[float] | None = None, em_axis: Sequence[float] | None = None, wavelength_alignment: bool = False) -> dict:
    out = {}
    for k, m in models.items():
        both = [loadings_similarity(r, own, axis, at, wavelength_alignment) for r, own, axis, at in ((ex_ref, m.ex_loadings, ex_axis, m.stack.ex), (em_ref, m.em_loadings, em_axis, m.stack.em))]
        out[k] = renumbered(m, _matched((both[0] + both[1]) / 2))
    return out


class SplitValidation:
    """Fits a model to combinations of parts of the samples and compares the fits."""

    def __init__(self, base_model: Fitted, n_splits: int = 4, combination_size: int | str = "half", rule: str = "random", random_state: int | None = None) -> None:
        self.base_model, self.n_splits, self.rule, self.random_state = base_model, n_splits, rule, random_state
        self.size = n_splits // 2 if combination_size == "half" else int(combination_size)

    def fit(self, stack: Stack) -> SplitValidation:
        top, bot = getattr(self.base_model, "kw_top", None), getattr(self.base_model, "kw_bot", None)
        self.stack = stack = stack.with_frame(stack.frame.persist())  # every part and fit reads it
        self.numbers = S.split_numbers(stack, self.n_splits, self.rule, self.random_state, top, bot).persist()
        self.full = copy.deepcopy(self.base_model).fit(stack)
        fitted, self.members = {}, {}
        for combination in itertools.combinations(range(1, self.n_splits + 1), self.size):
            name = "".join(string.ascii_uppercase[i - 1] for i in combination) if self.n_splits <= 26 else "-".join(map(str, combination))
            part = S._among(stack, self.numbers.where(F.col("split").isin(list(combination))))
            self.members[name] = part
            fitted[name] = copy.deepcopy(self.base_model).fit(part)
        self.models = align_components_by_components(fitted, self.full.components)
        return self

    def pairs(self) -> list[tuple[str, str]]:
        """Combinations with those that share no part with them: the k-th and the k-th from the end."""
        names = list(self.models)
        return [(names[i], names[-1 - i]) for i in range(len(names) // 2)]

    def compare_components(self) -> dict[tuple[str, str], list[float]]:
        return {p: np.diag(component_similarity(*(self.models[n].components for n in p))).tolist() for p in self.pairs()}

    def compare_parafac_loadings(self) -> dict[tuple[str, str], dict[str, list[float]]]:
        if not isinstance(self.full, PARAFAC):
            raise TypeError("loadings are those of a trilinear model")
        return {
            p: {axis: np.diag(loadings_similarity(*(getattr(self.models[n], f"{axis}_loadings") for n in p))).tolist() for axis in ("ex", "em")}
            for p in self.pairs()
        }

    def correlation_cv(self, ref_col: str) -> DataFrame:
        """train, test, component, r_square and rmse of lines from scores to a reference, learned in one half and read in the other."""
        if self.stack.ref is None:
            raise ValueError("the stack has no reference table")
        ref = self.stack.ref.select("sample", F.col(ref_col).cast("double").alias("y")).where("y is not null and not isnan(y)")
        out = []
        for a, b in self.pairs():
            for train, test in ((a, b), (b, a)):
                line = self._scores(self.models[train].fmax).join(ref, "sample").groupBy("component").agg(F.regr_slope("y", "value").alias("slope"), F.regr_intercept("y", "value").alias("at"))
                seen = self._scores(self.models[train].predict(self.members[test])).join(ref, "sample").join(line, "component")
                error = F.col("y") - F.col("slope") * F.col("value") - F.col("at")
                total = F.var_pop("y") * F.count("y")
                agg = seen.groupBy("component").agg((1 - F.try_divide(F.sum(error * error), total)).alias("r_square"), F.sqrt(F.avg(error * error)).alias("rmse"))
                out.append(agg.select(F.lit(train).alias("train"), F.lit(test).alias("test"), "component", "r_square", "rmse"))
        result = out[0]
        for d in out[1:]:
            result = result.unionByName(d)
        return result

    @staticmethod
    def _scores(frame: DataFrame) -> DataFrame:
        return frame.select("sample", F.posexplode("fmax").alias("component", "value"))


def component_correlations(model: Fitted) -> DataFrame:
    """Lines between the maxima of every two components of a model."""
    return T.cross_correlation(model.fmax.select("sample", F.posexplode("fmax").alias("component", "value")))
