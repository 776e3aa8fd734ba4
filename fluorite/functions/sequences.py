"""Dynamic time warping and random splits of columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship


#: Cells of cost tables that are held at a time.
CELLS = 1 << 22


def warping_moves(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For rows of x (k, n) and y (k, m), how the cheapest path comes to each cell: 0 from above, 1 from the left, 2 across.

    Paths begin in the first cell; the other cells of the first row and column
    can't be passed. Costs are summed along anti-diagonals, of all rows at once.
    Of equal ways the lowest number counts.
    """
    gap = np.abs(x[:, :, None] - y[:, None, :])
    _, n, m = gap.shape
    total = np.full(gap.shape, np.inf)
    total[:, :1, :1] = 0.0
    moves = np.zeros(gap.shape, np.uint8)
    for d in range(2, n + m - 1):
        i = np.arange(max(1, d - m + 1), min(n - 1, d - 1) + 1)
        j = d - i
        ways = np.stack([total[:, i - 1, j], total[:, i, j - 1], total[:, i - 1, j - 1]])
        moves[:, i, j] = ways.argmin(axis=0)
        total[:, i, j] = gap[:, i, j] + ways.min(axis=0)
    return moves


def _traced(moves: np.ndarray) -> list[tuple[int, int]]:
    i, j = moves.shape[0] - 1, moves.shape[1] - 1
    path = [(i, j)]
    while i > 0 and j > 0:
        move = moves[i, j]
        i, j = i - (move != 1), j - (move != 0)
        path.append((i, j))
    return path[::-1]


def warping_path(x: Sequence[float], y: Sequence[float]) -> list[tuple[int, int]]:
    """Pairs of places along the cheapest path between two sequences, from the first that a border is met."""
    return _traced(warping_moves(np.asarray(x, float)[None], np.asarray(y, float)[None])[0])


def dynamic_time_warping(x: Sequence[float], y: Sequence[float]) -> tuple[list[float], list[float]]:
    path = warping_path(x, y)
    return [x[i] for i, _ in path], [y[j] for _, j in path]


def warp_pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    """Adds aligned_x and aligned_y to rows with two arrays of doubles."""
    names = df.columns
    ship(df.sparkSession)

    def run(batches):
        for pdf in batches:
            one, two = [None] * len(pdf), [None] * len(pdf)
            shapes = pdf[x].map(len).astype(str) + ":" + pdf[y].map(len).astype(str)
            for places in pdf.reset_index(drop=True).groupby(shapes.to_numpy()).indices.values():  # rows of equal lengths together
                a, b = (np.stack(pdf[c].iloc[places].to_numpy()).astype(float) for c in (x, y))
                step = max(1, CELLS // max(1, a.shape[1] * b.shape[1]))
                for at in range(0, len(places), step):
                    for k, moves in enumerate(warping_moves(a[at : at + step], b[at : at + step]), at):
                        path = _traced(moves)
                        one[places[k]], two[places[k]] = [a[k, i] for i, _ in path], [b[k, j] for _, j in path]
            pdf["aligned_x"], pdf["aligned_y"] = one, two
            yield pdf[[*names, "aligned_x", "aligned_y"]]

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + ["aligned_x array<double>", "aligned_y array<double>"])
    return df.mapInPandas(run, schema)


def random_split_columns(df: DataFrame, splits: Mapping[str, int], seed: int = 42, id_col: str = "sample") -> DataFrame:
    """Replaces each column of splits by that many random parts that sum to it, in its place.

    Parts come from the md5 of seed, id, column and place, so reruns agree.
    """

    def draw(column: str, i: int):
        text = F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"), F.lit(column), F.lit(str(i)))
        return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") + 1) / float(1 << 32)

    out = []
    for c in df.columns:
        n = splits.get(c)
        if n is None:
            out.append(F.col(c))
            continue
        n = max(int(n), 1)
        draws = [draw(c, i) for i in range(n)]
        total = sum(draws[1:], draws[0])
        out += [(F.col(c) * d / total).alias(f"{c}_{i + 1}" if n > 1 else c) for i, d in enumerate(draws)]
    return df.select(*out)
