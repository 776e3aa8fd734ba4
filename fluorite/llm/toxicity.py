"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, materialize, maybe_broadcast, pieces, read, ship

# Characters that look like a letter, and the letter. One character stands for one.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p",
    "ԛ": "q", "ѕ": "s", "т": "t", "ц": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o",
    "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ℓ": "l",
}
# Digits and signs that are written for a letter.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l"}

_FOLD = str.maketrans(HOMOGLYPHS | SUBSTITUTES | {chr(0xFF41 + i): chr(97 + i) for i in range(26)})


def lowered(text: str) -> str:
    """Lower case, of the same length: characters whose lower case is longer stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)


def folded(text: str) -> str:
    """Lower case without homoglyphs and substitutes; place by place."""
    return lowered(text).translate(_FOLD)


@dataclass
class Lexicon:
    """Terms with weights, phrases in which a term does not count, and the scale of the score."""

    terms: dict[str, float]
    exceptions: set[str] = field(default_factory=set)
    coefs: tuple[float, float, float] = (-3.0, 0.0, 4.0)  # of 1, density, presence

    def automaton(self) -> ahocorasick.Automaton | None:
        a = ahocorasick.Automaton()
        for term, weight in self.terms.items():
            a.add_word(term, (len(term), weight, False))
        for phrase in self.exceptions:
            a.add_word(phrase, (len(phrase), 0.0, True))
        if not len(a):
            return None
        a.make_automaton()
        return a

    def hits(self, text: str | None, automaton: ahocorasick.Automaton | None) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the terms at whole words that no exception phrase covers."""
        if not text or automaton is None:
            return []
        found, excused, low = [], [], None
        for last, (size, weight, excuse) in automaton.iter(folded(text)):
            start, end = last + 1 - size, last + 1
            if low is None:
                low = lowered(text)
            if (start == 0 or not low[start - 1].isalnum()) and (end == len(low) or not low[end].isalnum()):
                (excused if excuse else found).append((start, end, weight))
        if not excused:
            return found
        excused.sort()
        reach = list(accumulate((b for _, b, _ in excused), max))  # how far the phrases up to each go
        starts = [a for a, _, _ in excused]
        return [h for h in found if not (i := bisect_right(starts, h[0])) or reach[i - 1] < h[1]]

    def features(self, text: str | None, automaton: ahocorasick.Automaton | None) -> tuple[float, float, int]:
        """Weight of hits over the root of the length in words; the largest weight; hits."""
        hits = self.hits(text, automaton)
        if not hits:
            return 0.0, 0.0, 0
        words = max(len(text.split()), 1)
        return sum(w for _, _, w in hits) / words**0.5, max(w for _, _, w in hits), len(hits)

    def score(self, density: np.ndarray, largest: np.ndarray) -> np.ndarray:
        c = self.coefs
        return 1 / (1 + np.exp(-np.clip(c[0] + c[1] * density + c[2] * largest, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 50, weight: np.ndarray | float = 1.0) -> np.ndarray:
    """Newton's method with a ridge; x has a column of ones first, weight says how often a row counts."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (weight * (y - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def bounded_sample(rows: DataFrame, bound: int, *key: str) -> DataFrame:
    """At most about ``bound`` rows, chosen by a hash of their key; all of them if there are no more. Rows of one key go together."""
    n = rows.count()
    if n <= bound:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.lit(n), *key), F.lit(1 << 40)) < F.lit((1 << 40) * bound // n))


def train_lexicon(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    most_rows: int = 20_000,
    least_docs: int = 3,
) -> Lexicon:
    """Learns terms, exception phrases and the scale from labelled rows that are not held out.

    ``most_rows`` bounds the labelled rows that are used, and with them all that
    is learned: about so many ids, and if ids repeat in docs about so many rows
    of different texts, chosen by hashes. A word is a term if toxic documents
    have it far oftener than others, documents with it between the same two
    words counting as one, as copies do: a log odds ratio (with 0.5 added to each
    count) of 2 or more, by a lower bound of two standard errors, and in at
    least ``least_docs`` toxic documents. Its weight is that ratio over the
    largest. A phrase of a term and its neighbour that is commoner among other
    documents is an exception. Of several labels for an id the larger counts.
    Without rows of both labels (an empty table, say) there are no terms, and
    every score is low, or high if all rows are toxic.
    """
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    marks = bounded_sample(marks.where(~held_out(F.col("id"))), most_rows, "id")
    marks = maybe_broadcast(materialize(marks), 2 * most_rows)
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").join(marks, "id")
    rows = bounded_sample(rows, 2 * most_rows, "id", "text").select("text", "y")

    def fold_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, labels_, beside = [], [], []
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                plain = ["", *(w.strip(".,;:!?\"'()*#%&$") for w in text.translate(_LETTERS).split()), ""]
                own = {w: f"{plain[i - 1]} {plain[i + 1]}" for i, w in enumerate(plain) if len(w) >= 2 and w.isalpha()}
                words += own
                beside += own.values()
                labels_ += [y] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(labels_, pa.int32()), pa.array(beside, pa.string())], ["w", "y", "beside"])

    totals = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    if not pos or not neg:
        return Lexicon({}, coefs=(-3.0 if neg or not pos else 3.0, 0.0, 0.0))
    placed = rows.mapInArrow(fold_words, "w string, y int, beside string").select("w", "y", F.xxhash64("beside").alias("beside"))
    counts = placed.groupBy("w", "y", "beside").agg(F.lit(1).alias("one")).groupBy("w").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).where(F.col("a") >= least_docs)
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    odds = F.log(a / (pos + 1 - a)) - F.log(b / (neg + 1 - b))
    sure = odds - 2 * F.sqrt(1 / a + 1 / b)
    terms = {r["w"]: float(r["odds"]) for r in counts.select("w", odds.alias("odds"), sure.alias("sure")).where("sure >= 2").orderBy("w").collect()}  # of the bounded sample's words
    largest = max(terms.values(), default=1.0)
    lexicon = Lexicon({w: v / largest for w, v in terms.items()})
    if not terms:
        return Lexicon({}, coefs=(float(np.log(pos / neg)), 0.0, 0.0))
    lexicon.exceptions = _exceptions(rows, lexicon, pos, neg, least_docs)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            got = [lexicon.features(t, automaton) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64()), batch.column(1)], ["density", "largest", "y"])

    seen = rows.mapInArrow(measure, "density double, largest double, y int").groupBy("density", "largest", "y").count().toPandas()  # about 2 * most_rows at most; rows repeated are one
    seen = seen.sort_values(["density", "largest", "y"])
    x = np.column_stack([np.ones(len(seen)), seen["density"], seen["largest"]])
    lexicon.coefs = tuple(float(v) for v in _logistic(x, seen["y"].to_numpy(float), weight=seen["count"].to_numpy(float)))
    return lexicon


_LETTERS = str.maketrans(HOMOGLYPHS | {chr(65 + i): chr(97 + i) for i in range(26)})


def _exceptions(rows: DataFrame, lexicon: Lexicon, pos: int, neg: int, least_docs: int) -> set[str]:
    """Phrases of a term and the word before or after it that excuse the term."""

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            out, ys = [], []
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                plain, own = None, set()
                for start, end, _ in lexicon.hits(text, automaton):
                    plain = plain if plain is not None else folded(text)
                    before = plain[plain.rfind(" ", 0, start - 1) + 1 : start - 1] if plain[start - 1 : start] == " " else ""
                    stop = plain.find(" ", end + 1)
                    after = plain[end + 1 : stop if stop >= 0 else len(plain)] if plain[end : end + 1] == " " else ""
                    if before.isalpha():
                        own.add(f"{before} {plain[start:end]}")
                    if after.isalpha():
                        own.add(f"{plain[start:end]} {after}")
                out += own
                ys += [y] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(ys, pa.int32())], ["w", "y"])

    counts = rows.mapInArrow(phrases, "w string, y int").groupBy("w").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    clean = counts.where((F.col("b") >= max(least_docs, 3)) & (F.col("b") / neg > 4 * (F.col("a") + 0.5) / pos))
    return {r["w"] for r in clean.select("w").collect()}  # of the bounded sample


def score_toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", with_row: bool = False) -> DataFrame:
    """Returns id, score (0 to 1) and n_hits for each row of docs, reading nothing else of it.

    Null and empty texts have no hits and the score that goes with that.
    Repeated rows get equal scores; a long text costs time in proportion to its
    length and hits. Empty input: no rows. With ``with_row`` the
    struct row follows, with all columns of docs.
    """
    ship(docs.sparkSession)
    if with_row:
        rows = docs.select(F.struct(*docs.columns).alias("id"))
        place = docs.columns.index(text_col)
    else:
        rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in pieces(batches):
            texts = batch.column(0).flatten()[place] if with_row else batch.column(1)
            got = [lexicon.features(t.as_py(), automaton) for t in texts]
            score = lexicon.score(np.array([g[0] for g in got]), np.array([g[1] for g in got])) if got else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array([g[2] for g in got], pa.int64())], ["id", "score", "n_hits"])

    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("score", T.DoubleType()), T.StructField("n_hits", T.LongType())])
    scored = rows.mapInArrow(measure, schema)
    if with_row:
        return scored.select(F.col("id").getField(id_col).alias(id_col), "score", "n_hits", F.col("id").alias("row"))
    return scored.withColumnRenamed("id", id_col)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    lexicon = train_lexicon(docs, read(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, lexicon)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_hits")


QUERIES = {"op2_toxicity": op2_toxicity}
SQL: dict[str, str] = {}
