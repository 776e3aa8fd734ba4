"""The corpus pipeline: five stages over documents, each written and read again by whoever runs them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluorite.llm.common import KEY, attach, materialize, read
from fluorite.llm.decontamination import decontaminate
from fluorite.llm.jaccard import jaccard_components
from fluorite.llm.lines import dedup_lines
from fluorite.llm.mixing import mix_sources
from fluorite.llm.toxicity import score_toxicity, train_lexicon


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5, so null and empty texts stay."""
    lexicon = train_lexicon(docs, read(spark, sf_dir, "labels"))
    return score_toxicity(docs, lexicon, with_row=True).where("score < 0.5").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines whose template recurs; n_chars, if there is such a column, follows the text.

    Rows repeated with the same text count as one document; an empty table gives an empty table.
    """
    kept = dedup_lines(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group with a Jaccard similarity of 0.8 over five-word shingles the document of the least id.

    Documents without words belong to no group and all stay. Of rows repeated
    with the same id and text one stays.
    """
    groups = jaccard_components(docs, k=5, num=80, den=100, with_key=True)
    first = groups.where("is_first").groupBy("doc_id", KEY).agg(F.count(F.lit(1)).alias("rows"), F.max("n_shingles").alias("n_shingles"))
    first = materialize(first)
    rows = attach(docs, first)
    if first.where("rows > 1 and n_shingles > 0").isEmpty():
        return rows.select("row.*")
    place = F.row_number().over(W.partitionBy("row.doc_id", F.xxhash64("row.text")).orderBy(F.lit(1)))
    return rows.withColumn("place", place).where("place = 1 or found.n_shingles = 0").select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a run of ten words of a benchmark item, or a whole shorter item."""
    found = decontaminate(docs, read(spark, sf_dir, "benchmark"), with_key=True)
    return attach(docs, found.where("not contaminated").select("doc_id", KEY, "n_words").distinct()).select("row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the mix takes words: the columns of documents, then mix_size, mix_target and mix_taken.

    Of rows repeated with the same id, text and source each gets its own part.
    """
    parts = mix_sources(docs, with_key=True).where("taken > 0")
    parts = parts.groupBy("doc_id", KEY).agg(F.array_sort(F.collect_list(F.struct("source", "taken", "size", "target"))).alias("parts"))
    rows = attach(docs, parts)
    mine = F.filter("found.parts", lambda p: p["source"].eqNullSafe(F.col("row.source")))
    rows = rows.select("row", mine.alias("mine"))
    once = parts.where("size(parts) > 1").isEmpty()
    place = F.lit(1) if once else F.row_number().over(W.partitionBy("row.doc_id", F.xxhash64("row.text"), "row.source").orderBy(F.lit(1)))
    rows = rows.withColumn("place", place).where("size(mine) >= place").select("row", F.element_at("mine", F.col("place")).alias("mine"))
    return rows.select("row.*", F.col("mine.size").alias("mix_size"), F.col("mine.target").alias("mix_target"), F.col("mine.taken").alias("mix_taken"))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("source_mix", mixing),
]
#: Learned weights and components of a graph have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
