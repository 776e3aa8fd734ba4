"""Every operator and stage on nulls, empties, long texts, ties, repeated rows, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fluorite.llm.decontamination import decontaminate
from fluorite.llm.jaccard import jaccard_components
from fluorite.llm.licenses import known_licenses, scan_licenses
from fluorite.llm.lines import dedup_lines
from fluorite.llm.mixing import mix_sources
from fluorite.llm.neighbours import link_vectors
from fluorite.llm.personal import find_personal
from fluorite.llm.quality import score_quality, train_quality
from fluorite.llm.tokens import count_tokens
from fluorite.llm.toxicity import score_toxicity, train_lexicon

from .conftest import ODD_ROWS

try:
    import public_tokenizers
except ImportError:
    public_tokenizers = None


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(12)] + [(None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, None), (3, ""), (None, "a b"), (4, "one"), (4, "one"), (5, "日本 語")], "item_id long, text string")


OPERATORS = {
    "tokens": lambda d, l, b: count_tokens(d, public_tokenizers.path("byte_bpe_50k.json")),
    "toxicity": lambda d, l, b: score_toxicity(d, train_lexicon(d, l)),
    "personal": lambda d, l, b: find_personal(d),
    "quality": lambda d, l, b: score_quality(d, train_quality(d, l)),
    "mixing": lambda d, l, b: mix_sources(d),
    "jaccard": lambda d, l, b: jaccard_components(d),
    "licenses": lambda d, l, b: scan_licenses(d, known_licenses(d.sparkSession)),
    "decontamination": lambda d, l, b: decontaminate(d, b),
    "decontamination_joined": lambda d, l, b: decontaminate(d, b, broadcast_bound=0),
    "lines": lambda d, l, b: dedup_lines(d),
}


NAMES = [pytest.param(n, marks=pytest.mark.skipif(n == "tokens" and public_tokenizers is None, reason="no vocabulary files")) for n in sorted(OPERATORS)]


@pytest.mark.parametrize("name", NAMES)
def test_a_row_for_each_row(name, odd, labels, benchmark):
    out = OPERATORS[name](odd, labels, benchmark)
    rows = out.collect()
    assert len(rows) == ODD_ROWS
    ids = sorted((r["doc_id"] for r in rows), key=lambda i: (i is None, i))
    assert ids == [1, 2, 3, 4, 5, 5, 5, 6, 7, 8, 9, None, None]


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(name, odd, labels, benchmark):
    none = odd.where(F.lit(False))
    assert OPERATORS[name](none, labels.where(F.lit(False)), benchmark.where(F.lit(False))).collect() == []
    assert OPERATORS[name](odd, labels.where(F.lit(False)), benchmark.where(F.lit(False))).count() == ODD_ROWS


def test_defined_results(odd, labels, benchmark):
    if public_tokenizers is not None:
        tokens = {(r["doc_id"], r["n_bytes"]): r["n_tokens"] for r in OPERATORS["tokens"](odd, labels, benchmark).collect()}
        assert tokens[(1, 0)] == 0 and tokens[(2, 0)] == 0
    groups = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in OPERATORS["jaccard"](odd, labels, benchmark).collect()]
    assert (1, 0, 1) in groups and (2, 0, 2) in groups and (4, 1, 4) in groups and (None, 10, 5) in groups and groups.count((5, 10, 5)) == 2
    for bound in (200_000, 0):
        hits = [(r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in decontaminate(odd, benchmark, broadcast_bound=bound).collect()]
        assert hits.count((5, 12, 11, ["1"])) == 2 and (None, 12, 11, ["1"]) in hits
        assert (4, 1, 1, ["4"]) in hits and (1, 0, 0, []) in hits and (9, 3, 2, ["5"]) in hits
    mixed = {(r["doc_id"], r["size"]): r for r in OPERATORS["mixing"](odd, labels, benchmark).collect()}
    assert mixed[(1, 0)]["taken"] == 0 and all(r["taken"] <= 2 * r["size"] for r in mixed.values())
    lines = {r["doc_id"]: r for r in OPERATORS["lines"](odd, labels, benchmark).collect() if r["doc_id"] in (1, 2, 3)}
    assert lines[1]["text"] is None and lines[1]["n_lines"] == 0 and lines[2]["n_lines"] == 1 and lines[3]["text"] == "  \n\t "


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, None]), (9, [1.0, 0.0, 0.0]), (1, [1.0, 0.0]), (None, [0.0, 1.0]), (10, [1e300, 0.0]), (11, [1e-300, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cls", F.lit("clash")).withColumn("v", F.lit(0))
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in link_vectors(vectors).collect()), key=str)
    assert got.count((1, 4, 1, True)) == 2 and (2, 4, 1, False) in got and (10, 4, 1, False) in got and (11, 4, 1, False) in got
    assert all((i, 0, i, True) in got for i in (3, 4, 5, 6, 7, 8, 9)) and (None, 0, None, False) in got
    assert link_vectors(vectors.where(F.lit(False))).collect() == []


@pytest.mark.parametrize("k", range(5))
def test_stages(spark, tmp_path, odd, labels, benchmark, k):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    name, stage = corpus_pipeline.STAGES[k]
    for docs in (odd, odd.where(F.lit(False)), odd.select("doc_id", "text", "lang", "source", "n_chars")):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns[: len(docs.columns)] == docs.columns
        n = out.count()
        assert n <= docs.count()
        if name == "line_dedup":
            assert n == docs.count()
        if name == "ngram_jaccard_join" and n:
            assert out.where("doc_id = 5").count() == 2  # one of the repeated rows, and the other text
        if name == "benchmark_decontamination" and n:
            assert {r["doc_id"] for r in out.select("doc_id").collect()} == {1, 2, 3, 5, 6, 7, 8, None}
