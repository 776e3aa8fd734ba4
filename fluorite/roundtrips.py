"""Queries that write a driver table with a sink and read it back, and models of planted factors; each with its DuckDB twin."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import views as V
from .catalogue import L_SQL, query, rounded, shown, tidy
from .frames import Stack, dealt, fold
from .sources import json as J
from .sources import text as X


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share; with a local master a temporary one will do."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{root or tempfile.mkdtemp(prefix='roundtrip')}/roundtrip-{uuid.uuid4().hex}"


def _write_matrix(pixels: DataFrame, path: str) -> None:
    """One matrix file: the header has the excitation axis, every line an emission wavelength and its row."""
    rows = pixels.groupBy("em").agg(F.array_sort(F.collect_list(F.struct("ex", "v"))).alias("c"))
    head = rows.limit(1).select(F.lit(0.0).alias("at"), F.concat_ws("\t", F.lit("Wavelength"), F.transform("c", lambda x: x["ex"].cast("string"))).alias("value"))
    lines = head.union(rows.select(F.col("em").alias("at"), F.concat_ws("\t", F.col("em").cast("string"), F.transform("c", lambda x: x["v"].cast("string"))).alias("value")))
    lines.orderBy("at").coalesce(1).select("value").write.text(path)


def _means(spark: SparkSession, sf: str, n: int) -> DataFrame:
    """k, ex, em, v: mean matrices of the samples with each remainder, over pi, so that no value lies halfway between two rounded ones."""
    return V.lineitems(spark, sf).pixels().groupBy((F.col("sample") % n).alias("k"), "ex", "em").agg((F.avg("intensity") / F.pi()).alias("v"))


@query(f"{L_SQL} SELECT ex, em, round(avg(v) / pi(), 3) + 0.0 AS intensity FROM l GROUP BY 1, 2")
def read_eem_back(spark, sf):
    path = _folder(spark)
    _write_matrix(_means(spark, sf, 1), path)
    return rounded(X.read_eem(spark, path).pixels().select("ex", "em", "intensity"), 3, "intensity")


@query(f"{L_SQL} SELECT CAST(count(*) AS BIGINT) AS files, ex, em, round(sum(v), 2) + 0.0 AS total FROM (SELECT sample % 3 AS k, ex, em, avg(v) / pi() AS v FROM l GROUP BY 1, 2, 3) GROUP BY ex, em")
def read_eem_dataset_back(spark, sf):
    """Three matrix files read as one stack; names that Spark gives files have no order, so the files are summed."""
    path, means = _folder(spark), _means(spark, sf, 3).persist()
    for k in range(3):
        _write_matrix(means.where(F.col("k") == k), f"{path}/f{k}")
    stack = X.read_eem_dataset(spark, f"{path}/*", "part")
    return rounded(stack.pixels().groupBy("ex", "em").agg(F.count(F.lit(1)).alias("files"), F.sum("intensity").alias("total")), 2, "total")


@query(
    f"""{L_SQL}, m AS (SELECT sample % 2 AS k, ex, em, avg(v) / pi() AS v FROM l GROUP BY 1, 2, 3), c AS (SELECT ex, em, v FROM m WHERE k = 1 AND CAST(ex AS INTEGER) % 20 = 0),
w AS (SELECT a.em, a.ex AS x0, b.ex AS x1, a.v AS v0, b.v AS v1 FROM c a JOIN c b ON a.em = b.em AND b.ex = a.ex + 20),
i AS (SELECT ex, em, v FROM c UNION ALL SELECT x0 + 10, em, (v0 + v1) / 2 FROM w)
SELECT ex, em, round(m.v + i.v, 2) + 0.0 AS total FROM m JOIN i USING (ex, em) WHERE k = 0"""
)
def alignment_of_files(spark, sf):
    """A file on half of the wavelengths is brought to the grid of the other."""
    path, means = _folder(spark), _means(spark, sf, 2).persist()
    _write_matrix(means.where("k = 0"), f"{path}/f0")
    _write_matrix(means.where("k = 1 and cast(ex as int) % 20 = 0"), f"{path}/f1")
    stack = X.read_eem_dataset(spark, f"{path}/*", wavelength_alignment=True)
    return rounded(stack.pixels().groupBy("ex", "em").agg(F.sum("intensity").alias("total")), 2, "total")


@query("SELECT CAST(400 - 5 * (p_size - 1) AS DOUBLE) AS wl, round(avg(p_retailprice), 4) + 0.0 AS absorbance FROM part GROUP BY 1")
def read_abs_back(spark, sf):
    """A two-column file with descending wavelengths."""
    path = _folder(spark)
    rows = V.table(spark, sf, "part").groupBy((400 - 5 * (F.col("p_size") - 1)).cast("double").alias("wl")).agg(F.avg("p_retailprice").cast("double").alias("a"))
    rows.orderBy(F.desc("wl")).coalesce(1).select(F.concat_ws("\t", F.col("wl").cast("string"), F.col("a").cast("string")).alias("value")).write.text(path)
    table, axis = X.read_abs_dataset(spark, path, "part")
    return rounded(table.select(F.posexplode("absorbance").alias("at", "absorbance")).select(F.get(F.array(*[F.lit(w) for w in axis]), F.col("at")).alias("wl"), "absorbance"), 4, "absorbance")


@query("SELECT CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS BIGINT) AS position, round(s_acctbal, 2) + 0.0 AS value, 'balance' AS header FROM supplier")
def read_reference_back(spark, sf):
    path = _folder(spark)
    rows = V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("at"), F.col("s_acctbal").cast("double").cast("string").alias("value"))
    spark.createDataFrame([(-1, "balance in dollars")], "at long, value string").union(rows).orderBy("at").coalesce(1).select("value").write.text(path)
    values, header = X.read_reference_from_text(spark, path)
    return rounded(values, 2, "value").withColumn("header", F.lit(header))


@query("SELECT vec_id AS sample, CASE WHEN s_suppkey % 2 = 0 THEN round(s_acctbal, 2) + 0.0 END AS balance FROM embeddings LEFT JOIN supplier ON s_suppkey = vec_id AND s_suppkey % 2 = 0")
def reference_table_by_label(spark, sf):
    """A reference table joined to samples by their labels; samples without a row have none."""
    path = _folder(spark)
    rows = V.table(spark, sf, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").cast("string").alias("label"), F.col("s_acctbal").cast("double").alias("balance"))
    rows.write.option("header", True).csv(path)
    ref = X.read_reference_table(spark, path, V.embeddings(spark, sf)).ref
    return ref.select("sample", tidy(F.col("balance"), 2).alias("balance"))


_ORDERED = f"{L_SQL}, n AS (SELECT sample, CAST(row_number() OVER (ORDER BY sample) - 1 AS BIGINT) AS place FROM (SELECT DISTINCT sample FROM l))"


@query(f"{_ORDERED} SELECT place AS sample, ex, em, round(v, 2) + 0.0 AS intensity FROM l JOIN n USING (sample)")
def json_back(spark, sf):
    path = _folder(spark)
    J.write_json(V.lineitems(spark, sf), path)
    return shown(J.read_json(spark, path), 2)


@query(f"{_ORDERED} SELECT place AS sample, round(s_acctbal, 2) + 0.0 AS balance FROM n JOIN supplier ON s_suppkey = n.sample")
def json_reference_back(spark, sf):
    path = _folder(spark)
    J.write_json(V.lineitems(spark, sf), path)
    return J.read_json(spark, path).ref.select("sample", tidy(F.col("balance"), 2).alias("balance"))


@query(f"{L_SQL} SELECT sample, ex, em, round(v, 2) + 0.0 AS intensity FROM l")
def parquet_back(spark, sf):
    path = _folder(spark)
    J.write_parquet(V.lineitems(spark, sf), path)
    return shown(J.read_parquet(spark, path), 2)


@query("SELECT strftime(ts, '%Y-%m-%d %H:%M:00') AS label, count(*) AS n FROM events GROUP BY 1")
def labels_of_file_names(spark, sf):
    """Timestamps in places of file names."""
    names = V.table(spark, sf, "events").select(F.concat(F.lit("B1S1"), F.date_format("ts", "yyyy-MM-dd-HH-mm"), F.lit("-M3ABS.dat")).alias("name"))
    return names.select(X.label_of(F.col("name"), (5, 20), True).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


# --- planted factors: a part's size and the root of its price are the scores of two components that share no wavelength;
# some parts have one component only, which makes bilinear models unique too

EX, EM = (250.0, 260.0, 270.0, 280.0, 290.0), (300.0, 310.0, 320.0, 330.0, 340.0, 350.0)
#: Loadings of the two components.
B, C = ((0.5, 1.0, 0.25, 0, 0), (0, 0, 0, 1.0, 0.5)), ((0.5, 1.0, 0.5, 0, 0, 0), (0, 0, 0, 0.25, 1.0, 0.75))


def _dealt_parts(spark: SparkSession, sf: str) -> DataFrame:
    return dealt(V.table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), len(EX) * len(EM), "p_partkey")


def planted(spark: SparkSession, sf: str) -> Stack:
    size = F.when(F.col("p_partkey") % 5 == 0, 0.0).otherwise(F.col("p_size").cast("double"))
    price = F.when(F.col("p_partkey") % 5 == 1, 0.0).otherwise(F.sqrt(F.col("p_retailprice").cast("double")))
    cells = F.array(*[size * (B[0][i] * C[0][j]) + price * (B[1][i] * C[1][j]) for i in range(5) for j in range(6)])
    frame = _dealt_parts(spark, sf).select(F.col("p_partkey").alias("sample"), F.col("p_partkey").cast("string").alias("index"), F.lit(None).cast("string").alias("cluster"), cells.alias("intensity"))
    return Stack(frame, EX, EM, V.parts(spark, sf))


_SCORES = "SELECT p_partkey AS sample, CAST(k AS INTEGER) AS component, round(CASE WHEN p_partkey % 5 = k THEN 0 WHEN k = 0 THEN p_size ELSE sqrt(CAST(p_retailprice AS DOUBLE)) END, 2) + 0.0 AS fmax FROM part, (VALUES (0), (1)) t(k)"


def _fmax(frame: DataFrame) -> DataFrame:
    return rounded(frame.select("sample", F.posexplode("fmax").alias("component", "fmax")), 2, "fmax")


def _trilinear(stack: Stack):
    from .plans.models import PARAFAC

    return PARAFAC(2, max_iter_als=30).fit(stack)


def _bilinear(stack: Stack, **more):
    from .plans.models import EEMNMF

    return EEMNMF(2, **({"solver": "hals", "max_iter_als": 30} | more)).fit(stack)


@query(_SCORES)
def parafac_recovers(spark, sf):
    return _fmax(_trilinear(planted(spark, sf)).fmax)


@query(_SCORES)
def nmf_recovers(spark, sf):
    return _fmax(_bilinear(planted(spark, sf)).fmax)


@query(_SCORES)
def rank_one_nmf_recovers(spark, sf):
    return _fmax(_bilinear(planted(spark, sf), fit_rank_one=True).fmax)


@query(f"{_SCORES} WHERE p_partkey % 2 = 1")
def predict_other_samples(spark, sf):
    """A model of the even samples gives the scores of the odd ones."""
    stack = planted(spark, sf)
    model = _bilinear(stack.with_frame(stack.frame.where("sample % 2 = 0")))
    return _fmax(model.predict(stack.with_frame(stack.frame.where("sample % 2 = 1"))))


def _loadings_sql(name: str, axis: tuple, values: tuple) -> str:
    rows = ", ".join(f"('{name}', {k}, {w}::DOUBLE, {v}::DOUBLE)" for k, of in enumerate(values) for w, v in zip(axis, of, strict=True))
    return f"SELECT mode, component, wavelength, value + 0.0 AS value FROM (VALUES {rows}) t(mode, component, wavelength, value)"


@query(f"SELECT mode, CAST(component + 1 AS INTEGER) AS component, wavelength, value FROM ({_loadings_sql('ex', EX, B)} UNION ALL {_loadings_sql('em', EM, C)})")
def loadings_through_openfluor(spark, sf):
    """Loadings of a trilinear model, scaled to a maximum of 1, through a model file."""
    path = _folder(spark)
    _trilinear(planted(spark, sf)).export(path, {"name": "planted", "creator": "catalogue"})
    read = X.read_parafac_models(spark, path, "part")
    both = read["ex"].withColumn("mode", F.lit("ex")).union(read["em"].withColumn("mode", F.lit("em")))
    largest = both.groupBy("mode", "component").agg(F.max("value").alias("most"))
    both = both.join(largest, ["mode", "component"]).select("mode", F.col("component").cast("int").alias("component"), "wavelength", (F.col("value") / F.col("most")).alias("value"))
    return rounded(both, 4, "value")


@query("SELECT CAST(0 AS INTEGER) AS component, 260.0::DOUBLE AS ex, 310.0::DOUBLE AS em UNION ALL SELECT 1, 280.0, 340.0")
def component_peaks(spark, sf):
    """Peaks, by which components are put in order."""
    found = _bilinear(planted(spark, sf)).component_peak_locations()
    return spark.createDataFrame([(k, ex, em) for k, (ex, em) in enumerate(found)], "component int, ex double, em double")


@query("SELECT 'core_consistency' AS name, 100.0::DOUBLE AS value UNION ALL SELECT 'variance_explained', 100.0")
def model_diagnostics(spark, sf):
    model = _trilinear(planted(spark, sf))
    explained = model.variance_explained()
    rows = [("core_consistency", model.core_consistency()), ("variance_explained", explained if explained > 1.5 else 100 * explained)]
    return rounded(spark.createDataFrame(rows, "name string, value double"), 3, "value")


@query("SELECT p_partkey AS sample, 0.0::DOUBLE AS rmse, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE CAST(p_size AS DOUBLE) END AS first FROM part")
def sample_summaries(spark, sf):
    summary = _trilinear(planted(spark, sf)).sample_summary()
    return summary.select("sample", (F.round("rmse", 3) + F.lit(0.0)).alias("rmse"), (F.round(F.get("fmax", F.lit(0)), 2) + F.lit(0.0)).alias("first"))


@query(f"SELECT p_partkey AS sample, e.ex, m.em, 0.0::DOUBLE AS residual FROM part, (VALUES {', '.join(f'({v}::DOUBLE)' for v in EX)}) e(ex), (VALUES {', '.join(f'({v}::DOUBLE)' for v in EM)}) m(em)")
def model_residuals(spark, sf):
    stack = planted(spark, sf)
    left = _bilinear(stack).residual()
    column = next(c for c in left.columns if c in ("residual", "intensity"))
    long = left.select("sample", F.posexplode(column).alias("pos", "residual"))
    return long.select("sample", *stack.place(F.col("pos")), (F.abs(F.round("residual", 2)) + F.lit(0.0)).alias("residual"))


@query("SELECT pair, CAST(component AS INTEGER) AS component, 1.0::DOUBLE AS similarity FROM (VALUES ('AB-CD'), ('AC-BD'), ('AD-BC')) p(pair), (VALUES (0), (1)) c(component)")
def split_half_similarity(spark, sf):
    """Fits to halves of the samples have the same components."""
    from .plans.compare import SplitValidation
    from .plans.models import EEMNMF

    fitted = SplitValidation(EEMNMF(2, solver="hals", max_iter_als=15), n_splits=4, random_state=1).fit(planted(spark, sf))
    rows = [(f"{a}-{b}", k, round(float(v), 4)) for (a, b), of in fitted.compare_components().items() for k, v in enumerate(of)]
    return spark.createDataFrame(rows, "pair string, component int, similarity double")


_KINDS = "CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 1 END"


def _two_kinds(spark: SparkSession, sf: str) -> Stack:
    """Even parts have the first planted component only, odd ones the second."""
    size, root = F.col("p_size").cast("double"), F.sqrt(F.col("p_retailprice").cast("double"))
    even = F.col("p_partkey") % 2 == 0
    cells = F.array(*[F.when(even, size * (B[0][i] * C[0][j])).otherwise(root * (B[1][i] * C[1][j])) for i in range(5) for j in range(6)])
    frame = _dealt_parts(spark, sf).select(F.col("p_partkey").alias("sample"), F.col("p_partkey").cast("string").alias("index"), F.lit(None).cast("string").alias("cluster"), cells.alias("intensity"))
    return Stack(frame, EX, EM, V.parts(spark, sf))


@query(f"SELECT p_partkey AS sample, CAST({_KINDS} AS INTEGER) AS kind, 0.0::DOUBLE AS rmse FROM part")
def cluster_models_predict(spark, sf):
    """Each sample goes to the cluster whose model leaves the least error."""
    from .plans.cluster import KMethod
    from .plans.models import EEMNMF

    stack = _two_kinds(spark, sf)
    method = KMethod(EEMNMF(1, solver="hals", init="svd", max_iter_als=10), 2)
    method.cluster_specific_models = {k: EEMNMF(1, solver="hals", init="svd", max_iter_als=10).fit(stack.with_frame(stack.frame.where(F.col("sample") % 2 == k))) for k in (0, 1)}
    return method.predict(stack).select("sample", F.col("label").cast("int").alias("kind"), (F.abs(F.round("rmse", 3)) + F.lit(0.0)).alias("rmse"))


@query(
    """WITH RECURSIVE v AS (SELECT vec_id AS sample, list_transform(embedding[1:8], lambda x: CAST(x AS DOUBLE)) AS x, list_transform(embedding[57:64], lambda x: CAST(x AS DOUBLE)) AS y FROM embeddings),
c(sample, x, y, i, above, rows) AS (
  SELECT sample, x, y, 1, [0.0::DOUBLE] || list_transform(range(2, 9), lambda j: 'Infinity'::DOUBLE), [[0.0::DOUBLE] || list_transform(range(2, 9), lambda j: 'Infinity'::DOUBLE)] FROM v
  UNION ALL
  SELECT sample, x, y, i + 1, row, list_append(rows, row) FROM (
    SELECT *, list_reduce(list_transform(range(2, 9), lambda j: [abs(x[i + 1] - y[j]), least(above[j], above[j - 1])]), lambda a, b: list_append(a, b[1] + least(a[len(a)], b[2])), ['Infinity'::DOUBLE]) AS row FROM c WHERE i < 8)),
f AS (SELECT sample, x, y, rows FROM c WHERE i = 8),
p(sample, x, y, rows, i, j, ax, ay) AS (
  SELECT sample, x, y, rows, 8, 8, [x[8]], [y[8]] FROM f
  UNION ALL
  SELECT sample, x, y, rows, ni, nj, list_prepend(x[ni], ax), list_prepend(y[nj], ay) FROM (
    SELECT *, CASE WHEN up <= lf AND up <= dg THEN i - 1 WHEN lf <= dg THEN i ELSE i - 1 END AS ni, CASE WHEN up <= lf AND up <= dg THEN j WHEN lf <= dg THEN j - 1 ELSE j - 1 END AS nj
    FROM (SELECT *, rows[i - 1][j] AS up, rows[i][j - 1] AS lf, rows[i - 1][j - 1] AS dg FROM p WHERE i > 1 AND j > 1)))
SELECT sample, round(list_sum(list_transform(ax, lambda a, k: a * k)), 4) + 0.0 AS x, round(list_sum(list_transform(ay, lambda a, k: a * k)), 4) + 0.0 AS y, CAST(len(ax) AS INTEGER) AS steps FROM p WHERE i = 1 OR j = 1"""
)
def dtw(spark, sf):
    """The first and the last row of every sample's matrix, warped; both aligned sequences, summed by place."""
    from .functions.sequences import warp_pairs

    ends = V.embeddings(spark, sf).frame.select("sample", F.slice("intensity", 1, 8).alias("x"), F.slice("intensity", 57, 8).alias("y"))
    warped = warp_pairs(ends, "x", "y")

    def weighed(name: str):
        return (F.round(F.aggregate(F.transform(name, lambda v, k: v * (k + 1)), F.lit(0.0), lambda s, v: s + v), 4) + F.lit(0.0))

    return warped.select("sample", weighed("aligned_x").alias("x"), weighed("aligned_y").alias("y"), F.size("aligned_x").alias("steps"))


_PLANE = "(2.0::DOUBLE + 0.01 * sample + 0.03 * (ex - 250) + 0.02 * (em - 300))"


def _planes(spark: SparkSession, sf: str) -> Stack:
    value = lambda i, j: F.lit(2.0) + 0.01 * F.col("p_partkey") + 0.03 * (EX[i] - 250) + 0.02 * (EM[j] - 300)
    cells = F.array(*[value(i, j).cast("double") for i in range(5) for j in range(6)])
    frame = _dealt_parts(spark, sf).select(F.col("p_partkey").alias("sample"), F.col("p_partkey").cast("string").alias("index"), F.lit(None).cast("string").alias("cluster"), cells.alias("intensity"))
    return Stack(frame, EX, EM)


_GRID = f"(VALUES {', '.join(f'({v}::DOUBLE)' for v in EX)}) e(ex), (VALUES {', '.join(f'({v}::DOUBLE)' for v in EM)}) m(em)"


@query(f"SELECT sample, ex, em, round({_PLANE}, 4) + 0.0 AS intensity FROM (SELECT p_partkey AS sample, ex, em FROM part, {_GRID})")
def planes_imputed(spark, sf):
    """Missing pixels inside a plane are the plane's, whatever the triangles."""
    from .operators import pixelwise as P

    return shown(P.nan_imputing(P.region_masking(_planes(spark, sf), 262, 281, 318, 332, "nan")), 4)


@query(f"SELECT sample, ex, em, round({_PLANE}, 4) + 0.0 AS intensity FROM (SELECT p_partkey AS sample, ex, em FROM part, (VALUES (255.0::DOUBLE), (262.5), (288.0)) e(ex), (VALUES (304.0::DOUBLE), (317.5), (345.0)) m(em))")
def planes_interpolated(spark, sf):
    """Splines of a plane are the plane."""
    from .operators import pixelwise as P

    return shown(P.interpolation(_planes(spark, sf), (255, 262.5, 288), (304, 317.5, 345), "cubic"), 4)


@query(f"{L_SQL} SELECT DISTINCT sample, wl, round(0.01::DOUBLE + (sample % 7) / 100.0::DOUBLE + (wl - 240) / 10000.0::DOUBLE, 6) + 0.0 AS absorbance FROM l, (VALUES (240.0::DOUBLE), (280.0), (320.0), (350.0), (400.0)) w(wl)")
def absorbance_plot(spark, sf):
    """The points behind a plot of absorbance spectra."""
    from .plans.plots import absorbance_series

    return rounded(absorbance_series(V.absorbances(V.lineitems(spark, sf)), V.ABSORBANCE_AXIS), 6, "absorbance")
