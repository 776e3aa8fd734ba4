"""The user's object: a stack with the methods of the library. Every method returns a new dataset or a table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import frames
from .frames import Stack
from .operators import indices as I
from .operators import pixelwise as P
from .operators import samples as S
from .operators import stats as T
from .sources import json as J
from .sources import text as X


class EEMDataset:
    """Excitation-emission matrices of samples, lazily evaluated."""

    def __init__(self, stack: Stack) -> None:
        self.stack = stack

    @classmethod
    def from_arrays(cls, spark: SparkSession, eem_stack: np.ndarray, ex_range: Sequence[float], em_range: Sequence[float], index: Sequence[str] | None = None, ref: DataFrame | None = None, cluster: Sequence[str] | None = None) -> EEMDataset:
        return cls(frames.from_numpy(spark, eem_stack, ex_range, em_range, index, cluster, ref))

    @classmethod
    def read(cls, spark: SparkSession, folder_path: str, mandatory_keywords=None, optional_keywords=None, **options) -> EEMDataset:
        return cls(X.read_eem_dataset(spark, folder_path, mandatory_keywords, optional_keywords, **options))

    @classmethod
    def read_json(cls, spark: SparkSession, path: str) -> EEMDataset:
        return cls(J.read_json(spark, path))

    ex_range = property(lambda self: self.stack.ex)
    em_range = property(lambda self: self.stack.em)
    extent = property(lambda self: self.stack.extent)
    ref = property(lambda self: self.stack.ref)

    @property
    def index(self) -> DataFrame:
        return self.stack.frame.select("sample", "index")

    @property
    def cluster(self) -> DataFrame:
        return self.stack.frame.select("sample", "cluster")

    def _with(self, stack: Stack) -> EEMDataset:
        return EEMDataset(stack)

    def process(
        self,
        kernel: Callable[..., np.ndarray | tuple],
        ex_range: Sequence[float] | None = None,
        em_range: Sequence[float] | None = None,
        absorbance: DataFrame | None = None,
        blank: EEMDataset | None = None,
        outputs: str | None = None,
    ) -> EEMDataset | tuple[EEMDataset, DataFrame]:
        """Any function of a (ex, em) matrix, sample by sample; with outputs, what it returns besides is a table."""
        if absorbance is None and blank is None and outputs is None:
            alone = lambda m: m[0] if isinstance(m, tuple) else m
            return self._with(self.stack.map_kernel(lambda x: np.stack([alone(kernel(s)) for s in x]), ex_range, em_range))
        stack, table = P.process_samples(self.stack, kernel, ex_range, em_range, absorbance, blank.stack if blank else None, outputs)
        return (self._with(stack), table) if outputs else self._with(stack)

    # tables
    def zscore(self) -> DataFrame:
        return P.zscore(self.stack)

    def mean(self) -> DataFrame:
        return T.pixel_statistics(self.stack).select("ex", "em", "mean")

    def variance(self) -> DataFrame:
        return T.pixel_statistics(self.stack).select("ex", "em", "variance")

    def std(self) -> DataFrame:
        return T.pixel_statistics(self.stack).select("ex", "em", "std")

    def total_fluorescence(self) -> DataFrame:
        return I.total_fluorescence(self.stack)

    def regional_integration(self, ex_min: float, ex_max: float, em_min: float, em_max: float) -> DataFrame:
        return I.regional_integration(self.stack, ex_min, ex_max, em_min, em_max)

    def peak_picking(self, ex: float, em: float) -> DataFrame:
        return I.peak_picking(self.stack, ex, em)

    def hix(self) -> DataFrame:
        return I.hix(self.stack)

    def bix(self) -> DataFrame:
        return I.bix(self.stack)

    def fi(self) -> DataFrame:
        return I.fi(self.stack)

    def aqy(self, abs_stack: DataFrame, ex_range_abs: Sequence[float], target_ex: float | None = None) -> DataFrame:
        return I.aqy(self.stack, abs_stack, ex_range_abs, target_ex)

    def correlation(self, variables: Sequence[str], fit_intercept: bool = True) -> DataFrame:
        return T.correlation(self.stack, variables, fit_intercept)

    # new datasets
    def threshold_masking(self, threshold: float, fill: float, mask_type: str = "greater") -> EEMDataset:
        return self._with(P.threshold_masking(self.stack, threshold, fill, mask_type))

    def gaussian_filter(self, sigma: float = 1, truncate: float = 3) -> EEMDataset:
        return self._with(P.gaussian_filter(self.stack, sigma, truncate))

    def median_filter(self, window_size: tuple[int, int] = (3, 3), mode: str = "reflect") -> EEMDataset:
        return self._with(P.median_filter(self.stack, window_size, mode))

    def region_masking(self, ex_min: float, ex_max: float, em_min: float, em_max: float, fill_value: str = "nan") -> EEMDataset:
        return self._with(P.region_masking(self.stack, ex_min, ex_max, em_min, em_max, fill_value))

    def cutting(self, ex_min: float, ex_max: float, em_min: float, em_max: float) -> EEMDataset:
        return self._with(P.cutting(self.stack, ex_min, ex_max, em_min, em_max))

    def nan_imputing(self, method: str = "linear", fill_value: float | str = "linear_ex") -> EEMDataset:
        return self._with(P.nan_imputing(self.stack, method, fill_value))

    def raman_normalization(self, blank: EEMDataset | None = None, from_blank: bool = False, integration_time: float = 1, ex_target: float = 350, bandwidth: float = 5, rsu_standard: float = 20000, manual_rsu: float = 1) -> EEMDataset:
        return self._with(P.raman_normalization(self.stack, blank.stack if blank else None, from_blank, integration_time, ex_target, bandwidth, rsu_standard, manual_rsu))

    def tf_normalization(self) -> tuple[EEMDataset, DataFrame]:
        stack, weights = P.tf_normalization(self.stack)
        return self._with(stack), weights

    def raman_scattering_removal(self, width: float = 5, interpolation_method: str = "linear", interpolation_dimension: str = "2d", recover_original_nan: bool = True) -> EEMDataset:
        return self._with(P.raman_scattering_removal(self.stack, width, interpolation_method, interpolation_dimension, recover_original_nan))

    def rayleigh_scattering_removal(self, *bands, **options) -> EEMDataset:
        return self._with(P.rayleigh_scattering_removal(self.stack, *bands, **options))

    def ife_correction(self, absorbance: DataFrame, ex_range_abs: Sequence[float]) -> EEMDataset:
        return self._with(P.ife_correction(self.stack, absorbance, ex_range_abs))

    def interpolation(self, ex_range_new: Sequence[float], em_range_new: Sequence[float], method: str = "linear") -> EEMDataset:
        return self._with(P.interpolation(self.stack, ex_range_new, em_range_new, method))

    def splitting(self, n_split: int, rule: str = "random", random_state: int | None = None, kw_top: str | None = None, kw_bot: str | None = None) -> list[EEMDataset]:
        return [self._with(s) for s in S.splitting(self.stack, n_split, rule=rule, random_state=random_state, kw_top=kw_top, kw_bot=kw_bot)]

    def subsampling(self, portion: float = 0.8, random_state: int = 0) -> EEMDataset:
        return self._with(S.subsampling(self.stack, portion, random_state))

    def sort_by_index(self) -> DataFrame:
        return S.sort_by_index(self.stack)

    def filter_by_index(self, mandatory_keywords=None, optional_keywords=None) -> EEMDataset:
        return self._with(S.filter_by_index(self.stack, mandatory_keywords, optional_keywords))

    def filter_by_cluster(self, cluster_names) -> EEMDataset:
        return self._with(S.filter_by_cluster(self.stack, cluster_names))

    def with_ref(self, ref: DataFrame) -> EEMDataset:
        return self._with(replace(self.stack, ref=ref))

    def to_json(self, filepath: str | None = None) -> DataFrame:
        if filepath is not None:
            J.write_json(self.stack, filepath)
        return J.to_json(self.stack)


def combine_eem_datasets(datasets: Sequence[EEMDataset]) -> EEMDataset:
    return EEMDataset(S.combine([d.stack for d in datasets]))
