"""Planted factors are found; invariants of fits, comparisons and clusterings."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluorite.frames import SCHEMA, from_numpy
from fluorite.operators import algebra as A
from fluorite.plans.cluster import KMethod, complete_linkage, cut_tree
from fluorite.plans.compare import SplitValidation, component_similarity, loadings_similarity
from fluorite.plans.factor import assignment, hals, start_components
from fluorite.plans.models import EEMNMF, HED, PARAFAC
from fluorite.sources.text import read_openfluor
from fluorite.streaming.scoring import score_stream

EX, EM = np.arange(240.0, 451, 15), np.arange(300.0, 551, 15)


def bump(x, at, width):
    return np.exp(-(((x - at) / width) ** 2) / 2)


B = np.stack([bump(EX, 270, 20), bump(EX, 370, 30)], 1)
C = np.stack([bump(EM, 340, 25), bump(EM, 450, 30)], 1)


@pytest.fixture(scope="module")
def planted(spark):
    scores = np.random.default_rng(5).random((12, 2)) + 0.1
    x = np.einsum("ir,jr,kr->ijk", scores, B, C)
    stack = from_numpy(spark, x, EX, EM, index=[f"s{i // 2:02d}_{'top' if i % 2 == 0 else 'bot'}" for i in range(12)])
    stack.frame.persist()
    return scores, x, stack


def test_assignment_is_the_best():
    rng = np.random.default_rng(0)
    for n, m in ((3, 3), (4, 6), (5, 3)):
        cost = rng.random((n, m))
        got = sum(cost[i, j] for i, j in assignment(cost))
        small, wide = (cost, m) if n <= m else (cost.T, n)
        assert np.isclose(got, min(sum(small[i, p[i]] for i in range(len(small))) for p in itertools.permutations(range(wide), len(small))))


def test_nnls_and_hals_meet_the_conditions():
    rng = np.random.default_rng(1)
    h, x = rng.random((4, 30)), rng.standard_normal((20, 30))
    w = A.nnls(h @ h.T, x @ h.T)
    slope = w @ (h @ h.T) - x @ h.T
    assert (w >= 0).all() and (slope > -1e-8).all() and np.abs(slope * w).max() < 1e-8
    v = hals(h @ x.T, h @ h.T, np.ones((4, 20)), most=5000, tol=1e-16)
    assert np.allclose(v.T, w, atol=1e-4)


@pytest.mark.parametrize("solver", ["hals", "mu"])
def test_trilinear_fit(planted, solver):
    _, _, stack = planted
    m = PARAFAC(2, solver=solver, max_iter_als=30).fit(stack)
    assert m.errors[-1] < (1e-4 if solver == "hals" else 0.05)
    assert m.component_peak_locations() == [(270.0, 345.0), (375.0, 450.0)]
    assert 99 < m.variance_explained() <= 100
    assert all(a >= b - 1e-6 for a, b in zip(m.errors, m.errors[1:], strict=False))
    assert (m.ex_loadings >= 0).all() and np.isclose(m.ex_loadings.max(axis=0), 1).all()
    if solver == "hals":
        assert m.core_consistency() > 99
        assert np.isclose(sum(r["leverage"] for r in m.leverage().collect()), 2)
        assert m.sample_summary().count() == 12


def test_missing_pixels_are_ignored(spark, planted):
    _, x, _ = planted
    y = x.copy()
    y[np.random.default_rng(2).random(x.shape) < 0.05] = np.nan
    m = PARAFAC(2, max_iter_als=30).fit(from_numpy(spark, y, EX, EM))
    assert component_similarity(np.einsum("jr,kr->rjk", B, C), m.components).diagonal().min() > 0.999


def test_bilinear_fits(planted):
    _, _, stack = planted
    for options in ({"solver": "hals"}, {"solver": "mu", "beta_loss": "kullback-leibler"}, {"solver": "hals", "fit_rank_one": True}):
        m = EEMNMF(2, max_iter_als=15, **options).fit(stack)
        assert m.variance_explained() > 99, options
    with pytest.raises(ValueError):
        EEMNMF(2, solver="cd", beta_loss="itakura-saito").fit(stack)


def test_priors_hold_a_component(planted):
    _, _, stack = planted
    m = EEMNMF(2, solver="hals", init="custom", custom_init=np.einsum("jr,kr->rjk", B, C), fixed_components=[0], max_iter_als=5, sort_components_by_em=False).fit(stack)
    assert np.allclose(m.components[0], np.outer(B[:, 0], C[:, 0]) / np.outer(B[:, 0], C[:, 0]).max())


def test_pairs_give_ratios(spark):
    bottoms = np.random.default_rng(3).random((6, 2)) + 0.2
    scores = np.empty((12, 2))
    scores[1::2], scores[::2] = bottoms, bottoms * [1.2, 1.6]
    x = np.einsum("ir,jr,kr->ijk", scores, B, C)
    stack = from_numpy(spark, x, EX, EM, index=[f"s{i // 2:02d}_{'top' if i % 2 == 0 else 'bot'}" for i in range(12)])
    m = PARAFAC(2, kw_top="top", kw_bot="bot", lam=1.0, max_iter_als=40, tol=1e-9).fit(stack)
    assert np.allclose(m.beta, [1.2, 1.6], atol=0.02)
    assert m.predict(stack, fit_beta=True).count() == 12
    same = PARAFAC(2, kw_top=list(range(0, 12, 2)), kw_bot=list(range(1, 12, 2)), lam=1.0, max_iter_als=40, tol=1e-9).fit(stack)
    assert np.allclose(same.beta, m.beta)


def test_hierarchy_keeps_what_has_no_children(planted):
    _, _, stack = planted
    parents = np.einsum("jr,kr->rjk", B, C)
    h = HED(parents, {0: 0, 1: 2}, gamma_H=1.0, max_iter_als=5).fit(stack)
    assert h.parents == [0, 1, 1] and np.allclose(h.components[0], parents[0] / parents[0].max())


def test_parts_of_parent_scores_keep_children_apart(spark):
    scores = np.random.default_rng(8).random((12, 2)) + 0.1
    x = np.einsum("ir,jr,kr->ijk", scores, B, C)
    stack = from_numpy(spark, x, EX, EM)
    parent = x.mean(axis=0)[None]
    given = spark.createDataFrame([(i, [float(s.sum())]) for i, s in enumerate(scores)], "sample long, scores array<double>")
    h = HED(parent, {0: 2}, gamma_H=0.0, parent_scores=given, max_iter_als=60, tol=1e-9).fit(stack)
    assert h.parents == [0, 0] and h.model.errors[-1] < 0.02
    assert not np.allclose(h.components[0], h.components[1], atol=0.1)
    again = HED(parent, {0: 2}, gamma_H=0.0, parent_scores=given, max_iter_als=60, tol=1e-9).fit(stack)
    assert np.allclose(h.components, again.components)
    split = {r["sample"]: r["scores"] for r in HED(parent, {0: 2}, parent_scores=given)._child_scores().collect()}
    assert all(np.isclose(sum(split[i]), s.sum()) for i, s in enumerate(scores))


def test_priors_draw_the_first_child(spark, planted):
    scores, _, stack = planted
    parents = np.einsum("jr,kr->rjk", B, C)
    to = spark.createDataFrame([(i, [None, 5.0]) for i in range(12)], "sample long, prior array<double>")
    h = HED(parents, {0: 0, 1: 1}, prior_dict_W=to, gamma_W={1: 1e9}, max_iter_als=3).fit(stack)
    # scores of 5 for all samples: the least squares component is smaller by their mean over 5
    own = h.model.last_pass.g[1, 1]
    assert np.isclose(own, 12 * 25, rtol=1e-3)


def test_priors_of_rank_one_scores(spark, planted):
    _, _, stack = planted
    to = spark.createDataFrame([(i, [2.0, 3.0]) for i in range(12)], "sample long, prior array<double>")
    m = EEMNMF(2, solver="hals", prior_dict_A=to, gamma_A=1e9, prior_dict_W=to, gamma_W=0, fit_rank_one={0: True}, max_iter_als=3).fit(stack)
    assert np.isclose(m.last_pass.g[0, 0], 12 * 4, rtol=1e-3) and not np.isclose(m.last_pass.g[1, 1], 12 * 9, rtol=0.1)
    free = EEMNMF(2, solver="hals", prior_dict_A=to, gamma_A=1e9, max_iter_als=3).fit(stack)
    assert not np.isclose(free.last_pass.g[0, 0], 12 * 4, rtol=1e-3)


@pytest.mark.parametrize("init", ["ordinary_nmf", "ordinary_cp"])
def test_fitted_starts(planted, init):
    _, _, stack = planted
    m = EEMNMF(2, solver="hals", init=init, max_iter_als=20).fit(stack)
    assert m.errors[0] < 0.1 and m.variance_explained() > 99
    with pytest.raises(ValueError):
        EEMNMF(2, init="none such").fit(stack)


def test_trilinear_start_and_masks_by_sample(spark, planted):
    _, x, _ = planted
    observed = np.random.default_rng(9).random(x.shape) > 0.05
    spoilt = np.where(observed, x, 50.0)
    masks = spark.createDataFrame([(i, [bool(v) for v in m.ravel()]) for i, m in enumerate(observed) if i], "sample long, mask array<boolean>")
    spoilt[0] = x[0]  # has no mask
    m = PARAFAC(2, init="ordinary_cp", mask=masks, max_iter_als=40).fit(from_numpy(spark, spoilt, EX, EM))
    assert component_similarity(np.einsum("jr,kr->rjk", B, C), m.components).diagonal().min() > 0.99
    plain = PARAFAC(2, max_iter_als=40).fit(from_numpy(spark, spoilt, EX, EM))
    assert plain.errors[-1] > 0.1


def test_small_files_of_large_stacks_are_dealt(tmp_path, spark, monkeypatch):
    """A table in one small file makes a stack whose pixels one task would read."""
    from fluorite import frames, roundtrips

    rows = [(i, i % 50 + 1, 900.0 + i % 100) for i in range(4000)]
    spark.createDataFrame(rows, "p_partkey long, p_size int, p_retailprice double").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    monkeypatch.setattr(frames, "PART_BYTES", 4000 * 30 * 8 // 6, raising=False)
    for make in (roundtrips.planted, roundtrips._two_kinds, roundtrips._planes):
        sizes = [r["count"] for r in make(spark, str(tmp_path)).frame.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 4000 and max(sizes) < 1000, sizes


def test_starts_are_non_negative(planted):
    _, _, stack = planted
    for method in ("random", "svd", "nndsvd", "nndsvda", "nndsvdar"):
        assert (start_components(stack, 2, method, 1) >= 0).all()


def test_split_validation(spark, planted):
    _, _, stack = planted
    v = SplitValidation(PARAFAC(2, max_iter_als=20), n_splits=2, random_state=0).fit(stack)
    assert min(v.compare_components()[("A", "B")]) > 0.99
    assert min(v.compare_parafac_loadings()[("A", "B")]["ex"]) > 0.99
    with pytest.raises(TypeError):
        SplitValidation(EEMNMF(1, max_iter_als=2), n_splits=2).fit(stack).compare_parafac_loadings()


def test_similarity_of_loadings():
    fine, coarse = np.arange(0, 11.0), np.arange(0, 11, 2.0)
    a, b = fine[:, None] ** 2, coarse[:, None] ** 2
    assert loadings_similarity(a, b, fine, coarse, True)[0, 0] > 0.99
    assert np.isclose(loadings_similarity(a, 2 * a)[0, 0], 1)


def test_linkage_and_cut():
    points = np.array([0, 1, 10, 11, 30.0])
    z = complete_linkage(np.abs(points[:, None] - points[None, :]))
    assert cut_tree(z, 3).tolist() == [1, 1, 2, 2, 3] and cut_tree(z, 2).tolist() == [1, 1, 1, 1, 2]
    assert np.allclose(z[:, 2], [1, 1, 11, 30])


def _odd_runs(spark):
    """Runs with lost samples, null labels, words for labels, and a sample that meets nobody."""
    rows = [(run, i, None if (i + run) % 11 == 0 else f"c{(i * (run + 3)) % 4}") for run in range(3) for i in range(40) if (i + run) % 5] + [(9, 99, "c0")]
    return spark.createDataFrame(rows, "run int, sample long, label string"), rows


def test_consensus_by_blocks(spark, monkeypatch):
    """Pairs are made after the last shuffle; a join with a sum for each pair shuffled them all."""
    monkeypatch.setattr(A, "BLOCK", 7, raising=False)
    monkeypatch.setattr(A, "HELD_PAIRS", 20, raising=False)
    labels, rows = _odd_runs(spark)
    found = A.consensus(labels)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan[: plan.index("MapInArrow")]
    want = {}
    for run, i, x in rows:
        for other, j, y in rows:
            if run == other and i < j:
                together, runs = want.get((i, j), (0, 0))
                want[i, j] = together + (x is not None and x == y), runs + 1
    assert sorted(map(tuple, found.collect())) == sorted((i, j, t, n, t / n) for (i, j), (t, n) in want.items())


def test_silhouettes_by_classes_of_samples(spark, monkeypatch):
    """The same as from all pairs, without a row for any two samples."""
    monkeypatch.setattr(A, "BLOCK", 7)
    labels, _ = _odd_runs(spark)
    clusters = labels.select("sample").distinct().selectExpr("sample", "case when sample % 13 = 0 then null when sample = 7 then 5 else sample % 3 end as label")
    want = A.silhouette(A.consensus(labels).selectExpr("i", "j", "1 - consensus as distance"), clusters)
    got = A.consensus_silhouette(labels, clusters)
    found, known = ({r["sample"]: r["silhouette"] for r in d.collect()} for d in (got, want))
    assert found.keys() == known.keys() and np.allclose([found[k] for k in known], list(known.values()))


def _plain_linkage(distance):
    d = np.array(distance, float)
    n = len(d)
    np.fill_diagonal(d, np.inf)
    name, size, out = list(range(n)), [1] * n, []
    for step in range(n - 1):
        i, j = sorted(np.unravel_index(int(np.argmin(d)), d.shape))
        out.append((*sorted((name[i], name[j])), d[i, j], size[i] + size[j]))
        d[i] = d[:, i] = np.maximum(d[i], d[j])
        d[j] = d[:, j] = d[i, i] = np.inf
        name[i], size[i] = n + step, size[i] + size[j]
    return np.array(out)


def test_linkage_takes_the_first_of_equal_distances():
    rng = np.random.default_rng(11)
    for n in (2, 7, 30):
        for most in (2, 5, 1000):
            d = np.triu(rng.integers(0, most, (n, n)), 1)
            assert np.array_equal(complete_linkage(d + d.T), _plain_linkage(d + d.T))


def test_classes_of_samples_cluster_as_samples_do(spark):
    """Of 60 samples the driver held 3 600 distances; of their classes it holds those of the classes."""
    rng = np.random.default_rng(12)
    kind = rng.integers(0, 8, 60)
    rows = [(run, i, f"c{(k * (run + 2)) % 3}") for i, k in enumerate(kind.tolist()) for run in range(4) if (k + run) % 4 and i != 17]
    runs = spark.createDataFrame(rows, "run int, sample long, label string")
    stack = from_numpy(spark, rng.random((60, len(EX), len(EM))), EX, EM)
    m = np.zeros((60, 60))
    for r in A.consensus(runs).collect():
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["consensus"]
    np.fill_diagonal(m, 1)
    for n_clusters, power in ((2, 1), (3, 2), (5, 1), (40, 1)):
        method = KMethod(EEMNMF(1, solver="hals", init="random", max_iter_als=1), 2)
        method.runs = runs
        method.cluster_specific_models = None
        method.base_model.fit = lambda stack: None  # what counts here are the labels
        found = {r["sample"]: r["label"] for r in method.hierarchical_clustering(stack, n_clusters, power).collect()}
        plain = _plain_linkage((1 - m) ** power)
        want = cut_tree(plain, n_clusters)
        assert [found[i] for i in range(60)] == want.tolist()
        heights = np.sort(plain[:, 2])
        assert np.isclose(method.threshold, (heights[-n_clusters] + heights[1 - n_clusters]) / 2)
        assert len(method.distance_matrix) == (9 if n_clusters < 4 else 60)
        every = spark.createDataFrame([(i, j, float((1 - m[i, j]) ** power)) for i in range(60) for j in range(i + 1, 60)], "i long, j long, distance double")
        labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(want)], "sample long, label int")
        assert np.isclose(method.silhouette, np.mean([r["silhouette"] for r in A.silhouette(every, labels).collect()]))


def test_rounds_of_clustering_read_their_source_once(spark, planted):
    """Every fit, start and distance made the stack anew."""
    _, _, stack = planted
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    source = stack.with_frame(stack.frame.mapInArrow(counted, stack.frame.schema))
    labels, _ = KMethod(EEMNMF(1, solver="hals", init="svd", max_iter_als=2), 2, max_iter=2, elimination=0).base_clustering(source)
    assert labels.count() == 12 and read.value <= 2 * 12, read.value


@pytest.mark.parametrize("n", [0, 1, 10, 1003])
def test_places_by_ranges(spark, monkeypatch, n):
    """The parts that ntile over all rows gives, without one task that has all of them."""
    from pyspark.sql import Window

    from fluorite.frames import Stack
    from fluorite.operators import samples as S

    monkeypatch.setattr(S, "IN_ORDER", 100)
    rows = spark.range(n).select((F.col("id") * 7 - 300).alias("sample"))
    stack = Stack(rows.select("sample", F.col("sample").cast("string").alias("index")), (1.0,), (1.0,))
    for rule, order in (("random", [S.hash_order(4), F.col("sample")]), ("sequential", [F.col("sample")])):
        for parts in (1, 4, 7):
            want = rows.select("sample", F.ntile(parts).over(Window.orderBy(*order)).alias("split"))
            got = S.split_numbers(stack, parts, rule, 4)
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert n <= 100 or "SinglePartition" not in plan
    assert S.subsample_ids(stack, 0.8, 4).count() == int(n * 0.8)


def test_clusters_of_two_kinds(spark):
    rng = np.random.default_rng(4)
    kinds = [np.outer(B[:, k], C[:, k]) for k in range(2)]
    x = np.array([kinds[i % 2] * (1 + rng.random()) for i in range(12)])
    stack = from_numpy(spark, x, EX, EM)
    method = KMethod(EEMNMF(1, solver="hals", init="svd", max_iter_als=5), 2, max_iter=6, elimination=0, random_state=2)
    labels, history = method.base_clustering(stack)
    assert history.count() >= 12
    method.consensus_frame = A.consensus(labels.selectExpr("0 as run", "sample", "label"))
    found = {r["sample"]: r["label"] for r in method.hierarchical_clustering(stack, 2).collect()}
    assert len(set(found.values())) == 2
    assert method.predict(stack).count() == 12


def test_export_can_be_read(spark, planted, tmp_path):
    _, _, stack = planted
    m = PARAFAC(2, max_iter_als=5).fit(stack)
    m.export(str(tmp_path / "model"), {"name": "planted"})
    back = read_openfluor(spark, str(tmp_path / "model" / "*.txt"))
    assert back["ex"].count() == 2 * len(EX) and back["em"].count() == 2 * len(EM) and back["scores"].count() == 24
    assert back["info"].first()["value"] == "planted"


def test_streamed_scores(spark, planted, tmp_path):
    scores, x, stack = planted
    stack.frame.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    parts = np.einsum("jr,kr->rjk", B, C)
    done = score_stream(stream, stack.ex, stack.em, parts).writeStream.format("memory").queryName("scored").option("checkpointLocation", str(tmp_path / "c")).start()
    done.processAllAvailable()
    done.stop()
    got = np.array([r["scores"] for r in spark.table("scored").orderBy("sample").collect()])
    assert np.allclose(got, scores)


def test_helpers_of_the_algebra(planted):
    scores, x, stack = planted
    assert A.unfold_by_mode(x, 1).shape == (len(EX), 12 * len(EM))
    with pytest.raises(ValueError):
        A.unfold_by_mode(x, 3)
    parts = np.einsum("jr,kr->rjk", B, C)
    fitted = A.fit_components(stack, parts)
    assert A.masked_norm_error(stack, fitted, parts).first()["error"] < 1e-8
    with pytest.raises(ValueError):
        A.masked_norm_error(stack, fitted, parts, np.ones((2, 2), bool))
    out, k = A.replace_factor_with_prior([B, C], B[:, 1] * 2, 0)
    assert k == 1 and np.allclose(out[0][:, 1], B[:, 1] * 2) and np.allclose(out[1], C)
    out, _ = A.replace_factor_with_prior([B, C], B[:, 1] * 2, 0, unfolded=B @ C.T)
    assert np.allclose(out[1], C / [1, 2])
    assert np.allclose(A.khatri_rao_matrix([B, C]), np.einsum("jr,kr->jkr", B, C).reshape(-1, 2))
