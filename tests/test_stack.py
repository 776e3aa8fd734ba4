"""Hand-computed arrays and invariants of the per-sample operators."""

import numpy as np
import pytest

from fluorite.dataset import EEMDataset, combine_eem_datasets
from fluorite.frames import from_numpy, nearest, to_numpy
from fluorite.functions.sequences import dynamic_time_warping, random_split_columns
from fluorite.functions.special import correlation_p_value, integers, strings
from fluorite.operators import kernels as K
from fluorite.operators import pixelwise as P
from fluorite.operators import samples as S
from fluorite.operators import stats as T

EX, EM = np.arange(240.0, 331, 10), np.arange(260.0, 421, 10)


@pytest.fixture(scope="module")
def data(spark):
    x = np.random.default_rng(1).random((6, len(EX), len(EM))) + 0.1
    return x, from_numpy(spark, x, EX, EM, index=[f"s{i // 2}_{'top' if i % 2 else 'bot'}" for i in range(6)], cluster=["a", "b"] * 3)


def test_quantum_yield(spark):
    d = EEMDataset.from_arrays(spark, [[[1, 2], [3, 4], [5, 6]], [[2, 3], [4, 5], [6, 7]]], [250, 260, 270], [300, 310])
    a = spark.createDataFrame([(0, [1.0, 2.0, 5.0]), (1, [2.0, 4.0, 10.0])], "sample long, absorbance array<double>")
    got = {(r["sample"], r["ex"]): r["aqy"] for r in d.aqy(a, [250, 260, 270]).collect()}
    assert got == {(0, 250.0): 3.0, (0, 260.0): 3.5, (0, 270.0): 2.2, (1, 250.0): 2.5, (1, 260.0): 2.25, (1, 270.0): 1.3}
    assert {r["sample"]: (r["ex"], r["aqy"]) for r in d.aqy(a, [250, 260, 270], 261).collect()} == {0: (260.0, 3.5), 1: (260.0, 2.25)}


def test_nearest_takes_the_lower_of_ties_and_clamps():
    assert [nearest([1, 2, 4], t) for t in (0, 1.5, 3, 3.1, 9)] == [0, 0, 1, 2, 2]


def test_masks_and_cuts(data):
    x, stack = data
    assert np.array_equal(to_numpy(P.threshold_masking(stack, 0.5, 0.0)), np.where(x > 0.5, 0, x))
    assert np.isnan(to_numpy(P.threshold_masking(stack, 0.5, np.nan, "smaller"))).sum() == (x < 0.5).sum()
    cut = P.cutting(stack, 252, 301, 288, 402)
    assert cut.ex[0] == 250 and cut.ex[-1] == 300 and cut.em[0] == 290 and cut.em[-1] == 400
    assert np.array_equal(to_numpy(cut), x[:, 1:7, 3:15])
    masked = to_numpy(P.region_masking(stack, 252, 301, 288, 402, "zero"))
    assert (masked[:, 1:7, 3:15] == 0).all() and (masked != 0).sum() == x.size - 6 * 6 * 12
    with pytest.raises(ValueError):
        P.region_masking(stack, fill="one")
    with pytest.raises(ValueError):
        P.threshold_masking(stack, 1, mask_type="other")


def test_filters_against_plain_loops(data):
    x, stack = data
    got = to_numpy(P.median_filter(stack))
    padded = np.pad(x, ((0, 0), (1, 1), (1, 1)), mode="symmetric")
    want = np.median(np.stack([padded[:, a : a + len(EX), b : b + len(EM)] for a in range(3) for b in range(3)]), axis=0)
    assert np.allclose(got, want)
    w = np.exp(-(np.arange(-3, 4) ** 2) / 2)
    w /= w.sum()
    wide = np.pad(x, ((0, 0), (3, 3), (3, 3)), mode="symmetric")
    rows = sum(w[k] * wide[:, k : k + len(EX)] for k in range(7))
    assert np.allclose(to_numpy(P.gaussian_filter(stack)), sum(w[k] * rows[:, :, k : k + len(EM)] for k in range(7)))
    for mode in ("reflect", "mirror", "nearest", "wrap", "constant"):
        assert to_numpy(P.median_filter(stack, (3, 1), mode)).shape == x.shape


def test_interpolation_and_splines(data):
    x, stack = data
    same = P.interpolation(stack, EX, EM, "cubic")
    assert np.allclose(to_numpy(same), x)
    t = np.linspace(250, 320, 8)
    for degree in (3, 5):
        m = K.spline_weights(EX, t, degree)
        assert np.allclose(m @ (EX / 100) ** degree, (t / 100) ** degree)
    assert np.isnan(to_numpy(P.interpolation(stack, [230, 250], [300], "linear"))[:, 0]).all()
    assert np.allclose(to_numpy(P.interpolation(stack, [244, 246], [300], "nearest"))[:, :, 0], x[:, [0, 1], 4])


def test_imputing_is_exact_on_planes(spark):
    plane = (2 * EX[:, None] + 3 * EM[None, :])[None]
    hole = plane.copy()
    hole[0, 3:6, 4:9] = np.nan
    hole[0, :, -2:] = np.nan
    stack = from_numpy(spark, hole, EX, EM)
    for method in ("linear", "cubic"):
        got = to_numpy(P.nan_imputing(stack, method, "linear_em"))
        assert np.allclose(got, plane)
    assert (to_numpy(P.nan_imputing(stack, "linear", 7.0))[0, :, -1] == 7).all()


def test_scatter_removal(data):
    x, stack = data
    for dimension in ("1d-ex", "1d-em", "2d"):
        for method in ("linear", "cubic"):
            got = to_numpy(P.raman_scattering_removal(stack, 20, method, dimension))
            band = K.raman_mask(EX, EM, 20)
            assert not np.isnan(got).any() and np.allclose(got[:, ~band], x[:, ~band])
    both = to_numpy(P.rayleigh_scattering_removal(stack, 20, 20, interpolation_method_o1="zero", interpolation_method_o2="nan"))
    below = EM[None, :] <= EX[:, None]
    second = K.rayleigh_mask(EX, EM, 20, 2)
    assert (both[:, below & ~second] == 0).all() and np.isnan(both[:, second]).all()
    with pytest.raises(ValueError):
        P.raman_scattering_removal(stack, 5, "spline")


def test_missing_pixels_stay_missing(spark, data):
    x, _ = data
    y = x.copy()
    y[0, 2, 3] = np.nan
    stack = from_numpy(spark, y, EX, EM)
    for got in (P.rayleigh_scattering_removal(stack, interpolation_method_o2="zero"), P.rayleigh_scattering_removal(stack, interpolation_method_o2="linear", interpolation_dimension_o2="1d-em"), P.raman_scattering_removal(stack, 5, "zero")):
        assert np.isnan(to_numpy(got)[0, 2, 3])


def test_normalisations(data):
    x, stack = data
    assert np.allclose(to_numpy(P.raman_normalization(stack, manual_rsu=2)), x / 2)
    totals = to_numpy(P.tf_normalization(stack)[0]).sum(axis=(1, 2))
    assert np.allclose(totals, x.sum(axis=(1, 2)).mean())


def test_samples(data):
    x, stack = data
    assert [s.frame.count() for s in S.splitting(stack, 4, rule="sequential")] == [2, 2, 1, 1]
    pairs = S.split_numbers(stack, 3, "random", 1, "top", "bot").collect()
    by = {}
    for r in pairs:
        by.setdefault(r["split"], set()).add(r["sample"] // 2)
    assert all(len(v) == 1 for v in by.values())
    assert S.subsampling(stack, 0.7).frame.count() == 4
    assert S.filter_by_index(stack, "top", ["s0", "s2"]).frame.count() == 2
    assert S.filter_by_index(stack).frame.count() == 6
    assert S.filter_by_cluster(stack, "a").frame.count() == 3
    both = combine_eem_datasets([EEMDataset(stack), EEMDataset(S.filter_by_cluster(stack, ["b"]))])
    assert both.stack.frame.count() == 9
    with pytest.raises(ValueError):
        S.combine([stack, P.cutting(stack, 250, 300, 300, 400)])
    with pytest.raises(ValueError):
        S.split_numbers(stack, 2, "other")


def test_correlation_values(spark, data):
    x, stack = data
    ref = spark.createDataFrame([(i, float(i * i)) for i in range(6)], "sample long, doc double")
    from dataclasses import replace

    got = T.correlation(replace(stack, ref=ref), ["doc"]).where("ex = 250 and em = 300").first()
    v = np.arange(6.0) ** 2
    y = x[:, 1, 4]
    assert np.isclose(got["pearson"], np.corrcoef(v, y)[0, 1])
    assert np.isclose(got["slope"], np.polyfit(v, y, 1)[0])
    ranks = np.argsort(np.argsort(y)) + 1
    assert np.isclose(got["spearman"], np.corrcoef(np.arange(6), ranks)[0, 1])
    assert 0 <= got["pearson_p"] <= 1
    assert np.isclose(correlation_p_value(0.5, 20), 0.024769558804109734)


def test_small_functions(spark):
    assert strings(" a, b") == ["a", "b"] and integers("1, 2") == [1, 2]
    with pytest.raises(ValueError):
        integers("1, x")
    a, b = dynamic_time_warping([1, 2, 3], [1, 2, 2, 3])
    assert len(a) == len(b)
    d = random_split_columns(spark.createDataFrame([(1, 2.0, 5.0)], "sample long, u double, v double"), {"u": 3})
    r = d.first()
    assert d.columns == ["sample", "u_1", "u_2", "u_3", "v"] and np.isclose(r["u_1"] + r["u_2"] + r["u_3"], 2)


def test_processing_with_each_samples_own(spark):
    x = np.arange(24.0).reshape(2, 3, 4)
    data = EEMDataset.from_arrays(spark, x, [1, 2, 3], [1, 2, 3, 4])
    own = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "sample long, absorbance array<double>")
    blank = EEMDataset.from_arrays(spark, x * 10, [1, 2, 3], [1, 2, 3, 4])
    with_absorbance = data.process(lambda m, absorbance: m + absorbance.sum(), absorbance=own)
    assert np.allclose(to_numpy(with_absorbance.stack), x + np.array([3, 7])[:, None, None])
    assert np.allclose(to_numpy(data.process(lambda m, blank: m + blank, blank=blank).stack), 11 * x)
    halves, table = data.process(lambda m: (m[:2], m > 5, float(m.max())), ex_range=[1, 2], outputs="mask array<boolean>, top double")
    assert halves.stack.shape == (2, 4) and np.allclose(to_numpy(halves.stack), x[:, :2])
    got = {r["sample"]: r for r in table.collect()}
    assert got[1]["top"] == 23 and list(got[0]["mask"]) == (x[0] > 5).ravel().tolist()
    assert np.allclose(to_numpy(data.process(lambda m: (2 * m, None)).stack), 2 * x)


def test_calibration_with_p_values(spark):
    values = spark.createDataFrame([(i, "a", float(v)) for i, v in enumerate([1.0, 2.5, 2.0, 4.0, 5.5])], "sample long, indicator string, value double")
    ref = spark.createDataFrame([(i, "b", float(i)) for i in range(5)], "sample long, variable string, value double")
    row = T.calibrate(values, ref, p_values=True).first()
    # t = r sqrt((n - 2) / (1 - r r)) on 3 degrees of freedom, whose distribution is elementary
    t = row["pearson"] * np.sqrt(3 / (1 - row["pearson"] ** 2))
    expected = 1 - 2 / np.pi * (np.arctan(t / np.sqrt(3)) + t / np.sqrt(3) / (1 + t * t / 3))
    assert np.isclose(row["pearson_p"], expected) and "pearson_p" not in T.calibrate(values, ref).columns
