"""Benchmark decontamination by winnowing; DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KEY, ascii_lower, materialize, maybe_broadcast, read, row_key

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _over_neighbours(df: DataFrame, base: str, name: str, width: int, join, overlapping: bool) -> tuple[DataFrame, str]:
    """A column over every ``width`` neighbours of base, from columns over half as many, each made once.

    ``overlapping``: whether the halves may overlap, as those of a minimum may.
    """
    made = {1: base}

    def build(df: DataFrame, w: int) -> DataFrame:
        if w in made:
            return df
        a = 1 << ((w - 1).bit_length() - 1)
        b = a if overlapping else w - a
        df = build(build(df, a), b)
        n = F.greatest(F.size(base) - (w - 1), F.lit(0))
        made[w] = f"__{name}{w}"
        return df.withColumn(made[w], F.zip_with(F.slice(made[a], F.lit(1), n), F.slice(made[b], F.lit(1 + w - b), n), join))

    df = build(df, width)
    return df, made[width]


def _gram(length: int, n: int, k: int) -> int:
    """Words of the grams that runs of so many words are winnowed by."""
    return k if length == n else (length + 1) // 2


def _winnowed(df: DataFrame, lengths: list[int], n: int, k: int) -> DataFrame:
    """Adds fps: array of (len, fp), for each length the least gram hash of every run of so many words of w."""
    df = df.withColumn("__h", F.transform("w", lambda x: F.xxhash64(x)))
    parts = []
    for length in lengths:
        size = _gram(length, n, k)
        df, grams = _over_neighbours(df, "__h", f"g{length}_", size, lambda x, y: F.xxhash64(x, y), overlapping=False)
        df, minima = _over_neighbours(df, grams, f"m{length}_", length - size + 1, lambda x, y: F.least(x, y), overlapping=True)
        parts.append(F.expr(f"transform(array_distinct({minima}), x -> struct({length} as len, x as fp))"))
    return df.withColumn("fps", F.concat(*parts))


def _runs(w: str, length: str) -> Column:
    """array<(pos, len, run)>: every run of so many words, as a digest."""
    return F.expr(f"if(size({w}) >= {length}, transform(sequence(1, size({w}) - {length} + 1), i -> struct(i as pos, {length} as len, md5(concat_ws(' ', slice({w}, i, {length}))) as run)), null)")


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = 10,
    k: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    broadcast_bound: int = 200_000,
    with_key: bool = False,
) -> DataFrame:
    """Words of documents that lie in a run of n words of a benchmark item.

    Texts are winnowed: the least k-gram hash of every n - k + 1 neighbouring
    k-grams is a fingerprint, so any shared run of n words shares one. An item
    of fewer than n words is one run; runs of its length are winnowed by grams
    of half of it. Fingerprints of documents and of the benchmark are joined,
    and documents that share one have their hits extended: their runs of that
    length are joined to the items' runs, and the words under equal runs are
    hit. It is the same plan for a benchmark of any size; tables of at most
    ``broadcast_bound`` rows are broadcast.

    Returns id, n_words, n_hit, item_ids (sorted as strings) and contaminated, a
    row for each row of docs; nothing else of docs is read. Null text has no
    words. Rows repeated with the same id and text get the same result each.
    Items that are null or have no words match nothing; repeated items count
    once. Long texts are read whole. Empty docs: no rows. Empty benchmark:
    nothing is hit. With ``with_key`` the hash of the text follows.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(item_text_col)).alias("w")).where("item is not null and size(w) > 0")
    items = materialize(items.withColumn("len", F.least(F.size("w"), F.lit(n))))
    lengths = sorted(r["len"] for r in items.select("len").distinct().collect())  # n values at most
    rows = docs.select(F.col(id_col).alias("id"), row_key(F.col(text_col)).alias(KEY), F.col(text_col).alias("text"))
    if not lengths:
        plain = rows.select("id", KEY, F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
        return plain.select(F.col("id").alias(id_col), "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("item_ids"), F.lit(False).alias("contaminated"), *[KEY] * with_key)
    theirs = [_winnowed(items.where(F.col("len") == length), [length], n, k).select(F.explode("fps").alias("x")).select("x.*") for length in lengths]
    fps = maybe_broadcast(materialize(reduce(DataFrame.union, theirs).distinct()), broadcast_bound)
    windows = items.select("item", F.explode(_runs("w", "len")).alias("x")).groupBy("x.len", "x.run").agg(F.array_sort(F.collect_set("item")).alias("items"))
    windows = materialize(windows)

    # winnowed once: of a text its first fingerprint is kept, for its number of words, and those that the benchmark has
    marked = _winnowed(rows.select("id", KEY, words_of(F.col("text")).alias("w")), lengths, n, k)
    each = marked.select("id", KEY, F.size("w").cast("long").alias("n_words"), F.posexplode_outer("fps").alias("at", "x")).select("id", KEY, "n_words", "at", "x.len", "x.fp")
    kept = materialize(each.join(fps.withColumn("known", F.lit(True)), ["len", "fp"], "left").where("known or coalesce(at, 0) = 0").select("id", KEY, "n_words", "at", "len", "known"))
    base = kept.where("coalesce(at, 0) = 0").select("id", KEY, "n_words")
    marks = kept.where("known").groupBy("id", KEY).agg(F.collect_set("len").alias("lens"))
    marks = maybe_broadcast(materialize(marks), broadcast_bound)
    near = rows.alias("a").join(marks.alias("b"), F.expr(f"a.id <=> b.id and a.{KEY} = b.{KEY}")).select("a.id", f"a.{KEY}", words_of(F.col("text")).alias("w"), "lens")
    runs = near.select("id", KEY, "w", F.explode("lens").alias("l")).select("id", KEY, F.explode(_runs("w", "l")).alias("x")).select("id", KEY, "x.*")
    hits = runs.join(maybe_broadcast(windows, broadcast_bound), ["len", "run"])
    by_doc = hits.groupBy("id", KEY).agg(F.collect_set(F.struct("pos", "len")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["pos"], r["pos"] + r["len"] - 1))))).cast("long")
    by_doc = by_doc.select("id", KEY, covered.alias("n_hit"), "item_ids")
    out = base.alias("d").join(by_doc.alias("f"), F.expr(f"d.id <=> f.id and d.{KEY} = f.{KEY}"), "left")
    return out.select(
        F.col("d.id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
        *[F.col(f"d.{KEY}")] * with_key,
    )


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"), "contaminated")


SQL = {
    "op9_benchmark_decontamination": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
i AS (
  SELECT DISTINCT item, least(len(w), 10) AS l, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS run
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
g AS (
  SELECT r, s, l, array_to_string(w[s:s + l - 1], ' ') AS run
  FROM (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM d, (SELECT DISTINCT l FROM i) WHERE len(w) >= l)),
h AS (SELECT r, s, g.l, item FROM g JOIN i ON g.run = i.run AND g.l = i.l),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + l)) AS p FROM h) GROUP BY r),
k AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN k USING (r)
""",
}
QUERIES = {"op9_benchmark_decontamination": op9_benchmark_decontamination}
