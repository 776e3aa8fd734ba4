"""Numpy kernels over (samples, ex, em) blocks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np


def gaussian_matrix(n: int, sigma: float, truncate: float) -> np.ndarray:
    """One-dimensional Gaussian smoothing with reflection at the ends (the edge twice) as a matrix."""
    radius = int(truncate * sigma + 0.5)
    k = np.arange(-radius, radius + 1)
    w = np.exp(-(k**2) / (2 * sigma**2)) if sigma > 0 else (k == 0).astype(float)
    w /= w.sum()
    m = np.zeros((n, n))
    for i in range(n):
        np.add.at(m[i], folded_index(i + k, n, "reflect"), w)
    return m


def folded_index(i: np.ndarray, n: int, mode: str) -> np.ndarray:
    """Where a place outside 0..n-1 takes its value from; -1 for a constant."""
    i = np.asarray(i)
    if mode == "reflect":  # d c b a | a b c d | d c b a
        j = np.mod(i, 2 * n)
        return np.where(j < n, j, 2 * n - 1 - j)
    if mode == "mirror":  # d c b | a b c d | c b a
        if n == 1:
            return np.zeros_like(i)
        j = np.mod(i, 2 * n - 2)
        return np.where(j < n, j, 2 * n - 2 - j)
    if mode == "nearest":
        return np.clip(i, 0, n - 1)
    if mode == "wrap":
        return np.mod(i, n)
    if mode == "constant":
        return np.where((i < 0) | (i >= n), -1, i)
    raise ValueError(f"mode must be reflect, mirror, nearest, wrap or constant; got {mode!r}")


def along(x: np.ndarray, m_ex: np.ndarray | None = None, m_em: np.ndarray | None = None) -> np.ndarray:
    """Matrices applied to the excitation and emission axis; a zero weight ignores NaN."""
    if np.isnan(x).any():
        bad = np.isnan(x).astype(float)
        out = along(np.nan_to_num(x), m_ex, m_em)
        spread = along(bad, None if m_ex is None else (m_ex != 0).astype(float), None if m_em is None else (m_em != 0).astype(float))
        out[spread > 0] = np.nan
        return out
    if m_ex is not None:
        x = np.einsum("ij,sjk->sik", m_ex, x)
    if m_em is not None:
        x = x @ m_em.T
    return x


def median(x: np.ndarray, size: tuple[int, int], mode: str) -> np.ndarray:
    """The item of rank size // 2 of every window."""
    _, n, m = x.shape
    layers = []
    for a in range(size[0]):
        i = folded_index(np.arange(n) + a - size[0] // 2, n, mode)
        for b in range(size[1]):
            j = folded_index(np.arange(m) + b - size[1] // 2, m, mode)
            part = x[:, np.maximum(i, 0)][:, :, np.maximum(j, 0)]
            part = np.where((i < 0)[:, None] | (j < 0)[None, :], 0.0, part)
            layers.append(part)
    every = np.sort(np.stack(layers), axis=0)
    return every[len(layers) // 2]


def linear_weights(old: Sequence[float], new: Sequence[float], outside: str = "nan") -> np.ndarray:
    """Piecewise linear interpolation from one axis to another as a matrix; outside: nan or extrapolate."""
    old, new = np.asarray(old, float), np.asarray(new, float)
    m = np.zeros((len(new), len(old)))
    if len(old) == 1:
        m[:, 0] = np.where((new == old[0]) | (outside == "extrapolate"), 1, np.nan)
        return m
    i = np.clip(np.searchsorted(old, new, side="right") - 1, 0, len(old) - 2)
    w = (new - old[i]) / (old[i + 1] - old[i])
    rows = np.arange(len(new))
    m[rows, i], m[rows, i + 1] = 1 - w, w
    if outside == "nan":
        m[(new < old[0]) | (new > old[-1])] = np.nan
    return m


def spline_weights(old: Sequence[float], new: Sequence[float], degree: int = 3, outside: str = "nan") -> np.ndarray:
    """Interpolating not-a-knot spline of odd degree as a matrix."""
    old, new = np.asarray(old, float), np.asarray(new, float)
    n = len(old)
    if n <= degree:
        raise ValueError(f"a spline of degree {degree} needs {degree + 1} points or more; got {n}")
    drop = (degree + 1) // 2
    knots = np.concatenate([[old[0]] * (degree + 1), old[drop : n - drop], [old[-1]] * (degree + 1)])
    m = bsplines(knots, degree, new) @ np.linalg.inv(bsplines(knots, degree, old))
    if outside == "nan":
        m[(new < old[0]) | (new > old[-1])] = np.nan
    return m


def bsplines(knots: np.ndarray, degree: int, x: np.ndarray) -> np.ndarray:
    """Values of all B-splines at x; the first and last piece go on outside."""
    n = len(knots) - degree - 1
    span = np.clip(np.searchsorted(knots, x, side="right") - 1, degree, n - 1)
    out = np.zeros((len(x), n))
    for row, (v, s) in enumerate(zip(x, span, strict=True)):
        b = [1.0]
        for d in range(1, degree + 1):  # Cox and de Boor
            left = [v - knots[s - d + 1 + r] for r in range(d)]
            right = [knots[s + 1 + r] - v for r in range(d)]
            nxt = [0.0] * (d + 1)
            for r in range(d):
                part = b[r] / (right[r] + left[r])
                nxt[r] += right[r] * part
                nxt[r + 1] += left[r] * part
            b = nxt
        out[row, s - degree : s + 1] = b
    return out


def nearest_weights(old: Sequence[float], new: Sequence[float]) -> np.ndarray:
    old, new = np.asarray(old, float), np.asarray(new, float)
    m = np.zeros((len(new), len(old)))
    i = np.clip(np.searchsorted(old, new) - 1, 0, max(len(old) - 2, 0))
    j = np.minimum(i + 1, len(old) - 1)
    pick = np.where(new - old[i] <= old[j] - new, i, j)
    m[np.arange(len(new)), pick] = 1
    m[(new < old[0]) | (new > old[-1])] = np.nan
    return m


def axis_weights(old: Sequence[float], new: Sequence[float], method: str) -> np.ndarray:
    if method in ("linear", "slinear"):
        return linear_weights(old, new)
    if method == "nearest":
        return nearest_weights(old, new)
    if method in ("cubic", "quintic"):
        return spline_weights(old, new, 3 if method == "cubic" else 5)
    raise ValueError(f"method must be linear, nearest, slinear, cubic or quintic; got {method!r}")


def resample(x: np.ndarray, m_ex: np.ndarray, m_em: np.ndarray) -> np.ndarray:
    """Both axes at once; rows of NaN weights (outside the grid) give NaN."""
    out = along(x, np.nan_to_num(m_ex), np.nan_to_num(m_em))
    out[:, np.isnan(m_ex).any(1)] = np.nan
    out[:, :, np.isnan(m_em).any(1)] = np.nan
    return out


def fill_band(x: np.ndarray, masked: np.ndarray, ex: np.ndarray, em: np.ndarray, method: str, dimension: str) -> np.ndarray:
    """Fills masked pixels from the others of their column (1d-ex), row (1d-em) or of the sample (2d)."""
    out = x.copy()
    if dimension == "2d":
        out[:, masked] = np.nan
        return np.stack([impute(s, ex, em, method, "linear_ex") for s in out])
    if dimension == "1d-em":
        for i in range(len(ex)):
            row = masked[i]
            if row.any() and not row.all():
                out[:, i] = _refill(out[:, i], row, em, method)
        return out
    if dimension == "1d-ex":
        for j in range(len(em)):
            column = masked[:, j]
            if column.any() and not column.all():
                out[:, :, j] = _refill(out[:, :, j], column, ex, method)
        return out
    raise ValueError(f"interpolation_dimension must be 1d-ex, 1d-em or 2d; got {dimension!r}")


def _refill(lines: np.ndarray, masked: np.ndarray, axis: np.ndarray, method: str) -> np.ndarray:
    known = axis[~masked]
    if method == "cubic" and len(known) > 3:
        m = spline_weights(known, axis[masked], 3, "extrapolate")
    else:
        m = linear_weights(known, axis[masked], "extrapolate")
    out = lines.copy()
    for i, line in enumerate(lines):
        out[i, masked] = _apply(m, line[~masked])
    return out


def _apply(m: np.ndarray, v: np.ndarray) -> np.ndarray:
    bad = np.isnan(v)
    out = m @ np.where(bad, 0, v)
    out[((m != 0) & bad).any(1)] = np.nan
    return out


def impute(s: np.ndarray, ex: np.ndarray, em: np.ndarray, method: str = "linear", fill: float | str = "linear_ex") -> np.ndarray:
    """Fills NaN inside the hull of the known pixels, then outside it.

    Inside: the known pixels are triangulated (Delaunay); a missing one is
    linear in its triangle, or for cubic a blend of the gradients at its corners
    (both exact on planes; the second on smooth surfaces nearly so). Outside: a
    constant, or by position along a line of one excitation or emission.
    """
    known = ~np.isnan(s)
    if known.all() or not known.any():
        return s.copy() if known.any() or isinstance(fill, str) else np.full_like(s, fill)
    out = s.copy()
    if known.sum() >= 3:
        points, want, ids, weights = triangles(known, tuple(map(float, ex)), tuple(map(float, em)))
        out[~known] = blended(points, s[known], want, ids, weights, method)
    if isinstance(fill, str):
        if fill not in ("linear_ex", "linear_em"):
            raise ValueError(f"fill_value must be a number, linear_ex or linear_em; got {fill!r}")
        lines = out.T if fill == "linear_ex" else out
        for line in lines:  # views: filled in place
            bad = np.isnan(line)
            if bad.any() and (~bad).any():
                at = np.arange(len(line))
                line[bad] = linear_weights(at[~bad], at[bad], "extrapolate") @ line[~bad]
    else:
        out[np.isnan(out)] = fill
    return out


def _unit(axis: np.ndarray) -> np.ndarray:
    axis = np.asarray(axis, float)
    return (axis - axis[0]) / ((axis[-1] - axis[0]) or 1.0)


_triangles: dict[tuple, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}


def triangles(known: np.ndarray, ex: tuple[float, ...], em: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(known points, wanted points, corners, weights of corners) for a pattern of known pixels; samples mostly share one.

    On a grid with bands missing, the known neighbours to the four sides and
    quarters of a point and its nearest ones make the candidates; the triangle
    whose farthest corner is nearest is taken, ties by the order of the points.
    Corners are -1 where there is no triangle.
    """
    key = (known.tobytes(), ex, em)
    if key not in _triangles:
        if len(_triangles) >= 64:
            _triangles.clear()
        grid = np.meshgrid(_unit(np.array(ex)), _unit(np.array(em)), indexing="ij")
        points, want = (np.column_stack([g[m] for g in grid]) for m in (known, ~known))
        found = [_triangle(points, w) for w in want]
        _triangles[key] = (points, want, np.array([f[0] for f in found]).reshape(-1, 3), np.array([f[1] for f in found]).reshape(-1, 3))
    return _triangles[key]


def _triangle(points: np.ndarray, w: np.ndarray) -> tuple[tuple[int, int, int], tuple[float, float, float]]:
    d = points - w
    far = np.hypot(*d.T)
    order = np.argsort(far, kind="stable")
    up, down, right, left = d[:, 0] >= 0, d[:, 0] <= 0, d[:, 1] >= 0, d[:, 1] <= 0
    near = set(order[:12].tolist())
    for side in (up, down, right, left, up & right, up & left, down & right, down & left):
        near.update(order[side[order]][:6].tolist())
    ranked = sorted(near, key=lambda i: (far[i], i))
    for c in range(2, len(ranked)):  # the farthest corner, the nearest first
        for b in range(1, c):
            for a in range(b):
                t = points[[ranked[a], ranked[b], ranked[c]]]
                det = (t[1, 0] - t[0, 0]) * (t[2, 1] - t[0, 1]) - (t[2, 0] - t[0, 0]) * (t[1, 1] - t[0, 1])
                if abs(det) < 1e-14:
                    continue
                u = ((w[0] - t[0, 0]) * (t[2, 1] - t[0, 1]) - (t[2, 0] - t[0, 0]) * (w[1] - t[0, 1])) / det
                v = ((t[1, 0] - t[0, 0]) * (w[1] - t[0, 1]) - (w[0] - t[0, 0]) * (t[1, 1] - t[0, 1])) / det
                if u >= -1e-12 and v >= -1e-12 and u + v <= 1 + 1e-12:
                    return (ranked[a], ranked[b], ranked[c]), (1 - u - v, u, v)
    return (-1, -1, -1), (np.nan, np.nan, np.nan)


def blended(points: np.ndarray, values: np.ndarray, want: np.ndarray, ids: np.ndarray, weights: np.ndarray, method: str) -> np.ndarray:
    """Values at the wanted points: linear in the triangle, or corners' tangent planes blended smoothly."""
    if method == "linear":
        return (weights * values[ids]).sum(axis=1)
    smooth = weights**2 * (3 - 2 * weights)
    smooth /= smooth.sum(axis=1, keepdims=True)
    slopes = _gradients(points, values)
    tangents = values[ids] + ((want[:, None, :] - points[ids]) * slopes[ids]).sum(axis=2)
    return (smooth * tangents).sum(axis=1)


def _gradients(points: np.ndarray, values: np.ndarray, n: int = 8) -> np.ndarray:
    out = np.zeros_like(points)
    for i, p in enumerate(points):
        near = np.argsort(np.hypot(*(points - p).T), kind="stable")[1 : n + 1]
        a = points[near] - p
        out[i] = np.linalg.lstsq(a, values[near] - values[i], rcond=None)[0]
    return out


def raman_mask(ex: np.ndarray, em: np.ndarray, width: float) -> np.ndarray:
    peak = ex / (1 - 0.00036 * ex)
    return np.abs(em[None, :] - peak[:, None]) <= width / 2


def rayleigh_mask(ex: np.ndarray, em: np.ndarray, width: float, order: int) -> np.ndarray:
    return np.abs(em[None, :] - order * ex[:, None]) <= width / 2


def trapezoid(axis: Sequence[float]) -> np.ndarray:
    """Weights of the trapezoid rule."""
    a = np.asarray(axis, float)
    w = np.zeros(len(a))
    if len(a) > 1:
        d = np.diff(a)
        w[:-1] += d / 2
        w[1:] += d / 2
    return w


Kernel = Callable[[np.ndarray], np.ndarray]
