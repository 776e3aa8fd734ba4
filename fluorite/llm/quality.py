"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, materialize, maybe_broadcast, read, ship
from .toxicity import _logistic, bounded_sample

# Kinds of bytes that are counted in a line.
KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "blank": b" \t\r\x0b\x0c",
    "stop": b".,;:?'\"()-",
    "call": b"!",
    "bar": b"|",
    "sign": b"#$%&*+/<=>@[\\]^_`{}~",
    "high": bytes(range(128, 256)),
}
_KIND = np.full(256, len(KINDS), np.uint8)
for _i, _bytes in enumerate(KINDS.values()):
    _KIND[list(_bytes)] = _i
#: A share of a line counts as it is and by which of these it is over.
STEPS = (0.01, 0.05, 0.15, 0.4)
#: Text bytes whose features are made at a time, and lines of a longer text.
SLAB = 1 << 20
PIECE = 1 << 15


def own_features(lines: list[bytes], first_of: list[bool], seen: set[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features of every line by itself, lengths). first_of: whether a text begins there; seen has the text's lines so far."""
    data = np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    kind = _KIND[data]
    length = (ends - starts).astype(float)
    shares = []
    for i in range(len(KINDS)):
        total = np.concatenate([[0], np.cumsum(kind == i, dtype=np.int64)])
        shares.append((total[ends] - total[starts]) / np.maximum(length, 1))
    repeats, alike = np.zeros(len(length)), np.zeros(len(length))
    for at, line in enumerate(lines):
        if first_of[at]:
            seen.clear()
        words = line.split()
        if words:
            repeats[at] = line in seen
            alike[at] = 1 - len(set(words)) / len(words)
            seen.add(line)
    blank = shares[3]
    per_word = length / (blank * length + 1)
    own = [np.ones(len(length)), np.log1p(length) / 5, length == 0, repeats, alike, *[alike > x for x in (0.3, 0.5, 0.7, 0.85)], np.minimum(per_word, 30) / 10, per_word > 12]
    for s in shares:
        own += [s, *[s > x for x in STEPS]]
    return np.column_stack(own).astype(np.float32), length


def _split(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    cut = [t.split(b"\n") for t in texts]
    return [line for lines in cut for line in lines], np.array([len(lines) for lines in cut], np.int64)


def _neighbours(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values of the line before and of the line after; 0 at the ends of texts."""
    last = np.cumsum(counts) - 1
    before, after = np.zeros_like(values), np.zeros_like(values)
    before[1:], after[:-1] = values[:-1], values[1:]
    before[np.concatenate([[0], last[:-1] + 1])] = 0
    after[last] = 0
    return before, after


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every line with those of its neighbours, lengths, lines of each text)."""
    lines, counts = _split(texts)
    first_of = np.zeros(len(lines), bool)
    first_of[np.cumsum(counts) - counts] = True
    own, length = own_features(lines, first_of.tolist(), set())
    return np.concatenate([own, *_neighbours(own, counts)], axis=1), length, counts


@dataclass
class LineField:
    """Weights of features for label bad against good, of neighbouring labels, and the scale of the score."""

    weights: np.ndarray
    pairs: np.ndarray
    coefs: np.ndarray

    def scores(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score of bad against good of every line, lengths, lines of each text), with features of ``PIECE`` lines at a time."""
        lines, counts = _split(texts)
        first_of = np.zeros(len(lines), bool)
        first_of[np.cumsum(counts) - counts] = True
        by_place = self.weights.reshape(3, -1).T.astype(float)  # for the line itself, as the one before, as the one after
        seen, score, length = set(), [], []
        for at in range(0, len(lines), PIECE):
            own, some = own_features(lines[at : at + PIECE], first_of[at : at + PIECE].tolist(), seen)
            score.append(own @ by_place)
            length.append(some)
        score = np.concatenate(score)
        return score[:, 0] + _neighbours(score[:, 1], counts)[0] + _neighbours(score[:, 2], counts)[1], np.concatenate(length), counts

    def marginals(self, node: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """Probability of bad for every line."""
        out = np.empty(len(node))
        starts = np.concatenate([[0], np.cumsum(lines)[:-1]])
        order, at = np.argsort(lines, kind="stable"), 0
        while at < len(order):  # texts of about equal length go together
            upto = at + 1
            while upto < len(order) and lines[order[upto]] * (upto + 1 - at) <= 1 << 16 and lines[order[upto]] <= 2 * lines[order[at]] + 8:
                upto += 1
            some = order[at:upto]
            place, mask = _padded(starts[some], lines[some])
            _, p, _ = forward_backward(np.where(mask, node[place], 0), mask, self.pairs)
            out[place[mask]] = p[mask]
            at = upto
        return out

    def quality(self, node: np.ndarray, length: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """Share of each text, by length, that is good."""
        p = self.marginals(node, lines)
        starts = np.concatenate([[0], np.cumsum(lines)[:-1]]).astype(int)
        weight = length + 1
        return np.add.reduceat((1 - p) * weight, starts) / np.add.reduceat(weight, starts)

    def score(self, good: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_scale(good) @ self.coefs, -30, 30)))


def _scale(good: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(good)), good, good**4])


def _padded(starts: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    j = np.arange(lines.max())
    mask = j[None, :] < lines[:, None]
    return np.where(mask, starts[:, None] + j[None, :], 0), mask


def forward_backward(node: np.ndarray, mask: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log Z of each row, P(bad) of each place, expected counts of neighbouring labels).

    node: score of bad against good, one row for each text; pairs: 2 by 2 scores of neighbouring labels.
    """
    n, t = node.shape
    step = np.exp(pairs)
    up = np.exp(np.clip(node, -30, 30))
    local = np.stack([np.ones_like(up), up], axis=2)
    alpha, log_z = np.empty((n, t, 2)), np.zeros(n)
    for i in range(t):
        a = local[:, 0] if i == 0 else (alpha[:, i - 1] @ step) * local[:, i]
        total = a.sum(1)
        live = mask[:, i]
        alpha[:, i] = np.where(live[:, None], a / total[:, None], alpha[:, i - 1] if i else a)
        log_z += np.where(live, np.log(total), 0)
    beta = np.ones((n, t, 2))
    expected = np.zeros((2, 2))
    for i in range(t - 2, -1, -1):
        live = mask[:, i + 1]
        b = local[:, i + 1] * beta[:, i + 1]
        nxt = b @ step.T
        beta[:, i] = np.where(live[:, None], nxt / nxt.sum(1, keepdims=True), 1)
        joint = alpha[:, i, :, None] * step * b[:, None, :]
        joint /= joint.sum((1, 2), keepdims=True)
        expected += joint[live].sum(0)
    p = alpha * beta
    p /= p.sum(2, keepdims=True)
    return log_z, p[:, :, 1], expected


def fit_field(texts: list[bytes], good: np.ndarray, rounds: int = 3, steps: int = 150, rate: float = 0.08, ridge: float = 1e-3) -> LineField:
    """Learns from texts that are good or bad as a whole.

    All lines of a good text are good. Those of a bad text are bad at first;
    after each round they are what the field says, but the worst stays bad.
    """
    features, length, lines = line_features(texts)
    starts = np.concatenate([[0], np.cumsum(lines)[:-1]]).astype(int)
    owner = np.repeat(np.arange(len(texts)), lines)
    in_bad = ~good[owner]
    label = in_bad.astype(float)
    field = LineField(np.zeros(features.shape[1]), np.zeros((2, 2)), np.zeros(3))
    order = np.argsort(lines, kind="stable")
    groups = [g for g in np.array_split(order, max(1, len(order) // 256)) if len(g)]
    padded = [_padded(starts[g], lines[g]) for g in groups]
    n = len(length)
    for _ in range(rounds):
        theta = np.concatenate([field.weights, field.pairs.ravel()])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        same = owner[1:] == owner[:-1]
        seen = np.zeros((2, 2))
        np.add.at(seen, (label[:-1][same].astype(int), label[1:][same].astype(int)), 1)
        for it in range(1, steps + 1):
            node = (features @ theta[:-4].astype(np.float32)).astype(float)
            p, expected = np.zeros(n), np.zeros((2, 2))
            for place, mask in padded:
                _, q, e = forward_backward(np.where(mask, node[place], 0), mask, theta[-4:].reshape(2, 2))
                p[place[mask]] = q[mask]
                expected += e
            gradient = np.concatenate([features.T @ (p - label).astype(np.float32), (expected - seen).ravel()]) / n + ridge * theta
            m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
            theta = theta - rate * (m / (1 - 0.9**it)) / (np.sqrt(v / (1 - 0.99**it)) + 1e-8)
        field.weights, field.pairs = theta[:-4].astype(np.float32), theta[-4:].reshape(2, 2)
        node = (features @ field.weights).astype(float)
        p = field.marginals(node, lines)
        worst = np.maximum.reduceat(p, starts)[owner]
        label = (in_bad & ((p >= 0.5) | (p == worst))).astype(float)
    share = field.quality((features @ field.weights).astype(float), length, lines)
    field.coefs = _logistic(_scale(share), good.astype(float), ridge=0.01)
    return field


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = 3_000, most_bytes: int = 12_000_000) -> LineField:
    """Fits on about ``most_rows`` labelled rows that are not held out, chosen by a hash of their id and text.

    ``most_bytes`` bounds the whole texts that are gathered: they are taken in
    order of the hash up to the first that doesn't fit, so long texts have the
    same chance as short ones. Of several labels for an id the lesser counts;
    rows repeated with the same id and text are one. Without rows of both
    labels (an empty table, say) every score is the prior: high if there are no
    bad rows.
    """
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("y"))
    marks = bounded_sample(marks.where(~held_out(F.col("id"))), most_rows, "id")
    marks = maybe_broadcast(materialize(marks), 2 * most_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(marks, "id")
    rows = rows.withColumn("h", F.xxhash64("id", "text"))
    sizes = rows.groupBy("h").agg(F.max(F.octet_length("text")).alias("size")).orderBy("h").limit(2 * most_rows).collect()  # two numbers a row
    total, upto = 0, None
    for r in sizes:
        total += r["size"]
        if total > most_bytes and upto is not None:
            break
        upto = r["h"]
    texts, good, last = [], [], None
    if upto is not None:
        for r in rows.where(F.col("h") <= upto).select("h", "text", "y").orderBy("h").toLocalIterator():
            if r["h"] != last:
                texts.append(r["text"].encode())
                good.append(r["y"] == 1)
            last = r["h"]
    good = np.array(good, bool)
    if not len(good) or good.all() or not good.any():
        width = line_features([b""])[0].shape[1]
        return LineField(np.zeros(width, np.float32), np.zeros((2, 2)), np.array([-3.0 if len(good) and not good.any() else 3.0, 0, 0]))
    return fit_field(texts, good)


def score_quality(docs: DataFrame, field: LineField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id, score (0 to 1, higher: better), good_share and n_lines for each row of docs.

    Null and empty texts are one empty line. Repeated rows get equal scores.
    Texts of very many lines are measured in pieces, and then hold some hundred
    bytes a line. Empty input: no rows. Other columns of docs are ignored.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def slabs(texts: list[bytes]) -> Iterator[list[bytes]]:
        held, size = [], 0
        for t in texts:
            held.append(t)
            size += len(t)
            if size >= SLAB:
                yield held
                held, size = [], 0
        if held:
            yield held

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share, count = [np.empty(0)], [np.empty(0, np.int64)]
            for some in slabs(batch.column(1).cast(pa.large_binary()).to_pylist()):
                node, length, lines = field.scores(some)
                share.append(field.quality(node, length, lines))
                count.append(lines)
            good = np.concatenate(share)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(field.score(good)), pa.array(good), pa.array(np.concatenate(count))], ["id", "score", "good_share", "n_lines"])

    fields = [("id", docs.schema[id_col].dataType), ("score", T.DoubleType()), ("good_share", T.DoubleType()), ("n_lines", T.LongType())]
    return rows.mapInArrow(measure, T.StructType([T.StructField(*f) for f in fields])).withColumnRenamed("id", id_col)


def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    field = train_quality(docs, read(spark, sf_dir, "labels"))
    scored = score_quality(docs, field)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "good_share", "n_lines")


QUERIES = {"op4_line_quality": op4_line_quality}
SQL: dict[str, str] = {}
