"""Small dense solves on cross-product matrices of z = (1, x..., y).

Rows never get here: Spark has summed them, a solve sees p x p numbers. The sums may be about any point:
slopes do not depend on it, and intercepts follow from it (``moved_back``). ``Moments`` gives those about the means, or
about those of another group, for which no large numbers are taken from each other.
"""

from __future__ import annotations

import numpy as np

ALIAS_TOLERANCE = 1e-9


def unpack(packed) -> np.ndarray:
    """Upper triangle, row by row, to the full symmetric matrix."""
    values = np.asarray(packed, dtype=float)
    size = int((np.sqrt(8 * len(values) + 1) - 1) / 2)
    out = np.zeros((size, size))
    out[np.triu_indices(size)] = values
    return out + np.triu(out, 1).T


def pack(full: np.ndarray) -> np.ndarray:
    return full[np.triu_indices(len(full))]


class Moments:
    """Weight, means and co-moments of z, unpacked from a row of a cross-product table."""

    def __init__(self, packed) -> None:
        full = unpack(packed)
        self.n, self.mean, self.co = full[0, 0], full[0, 1:], full[1:, 1:]

    def about(self, point: np.ndarray | None = None) -> np.ndarray:
        """Sums of z z' with x and y counted from ``point``, their means by default."""
        apart = np.zeros(len(self.mean)) if point is None else self.mean - point
        out = np.empty((len(apart) + 1, len(apart) + 1))
        out[0, 0], out[0, 1:], out[1:, 0] = self.n, self.n * apart, self.n * apart
        out[1:, 1:] = self.co + self.n * np.outer(apart, apart)
        return out


def common_mean(parts: list[Moments]) -> np.ndarray:
    n = np.array([p.n for p in parts])
    start = parts[int(np.argmax(n))].mean
    return start + sum(p.n * (p.mean - start) for p in parts) / (n.sum() or 1.0)


def moved_back(intercept: float, coef, point: np.ndarray) -> float:
    """The intercept for x and y themselves, of a fit to their distances from ``point``."""
    return float(intercept + point[-1] - np.nan_to_num(np.asarray(coef, float)) @ point[:-1])


def leave_one_out(m: Moments, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and co-moments of a group without one of its rows, for each row of ``z`` (weight one)."""
    apart = z - m.mean
    rest = m.n - 1
    return m.mean - apart / rest, m.co - (m.n / rest) * apart[:, :, None] * apart[:, None, :]


def centred(g: np.ndarray):
    """n, means of x, mean of y, centred cross products xx, xy, yy."""
    n = g[0, 0]
    mean = g[0, 1:] / n
    c = g[1:, 1:] - n * np.outer(mean, mean)
    return n, mean[:-1], mean[-1], c[:-1, :-1], c[:-1, -1], c[-1, -1]


def free_columns(xx: np.ndarray) -> list[int]:
    """Columns that are no linear combination of earlier ones."""
    kept: list[int] = []
    for j in range(len(xx)):
        rest = xx[j, j]
        if kept:
            rest = rest - xx[j, kept] @ np.linalg.solve(xx[np.ix_(kept, kept)], xx[kept, j])
        if xx[j, j] > 0 and rest > ALIAS_TOLERANCE * xx[j, j]:
            kept.append(j)
    return kept


def least_squares(g: np.ndarray) -> dict:
    """Intercept, slopes (nan where aliased), their covariance factor and residual sum."""
    n, mx, my, xx, xy, yy = centred(g)
    kept = free_columns(xx)
    coef = np.full(len(xx), np.nan)
    inverse = np.linalg.inv(xx[np.ix_(kept, kept)]) if kept else np.zeros((0, 0))
    coef[kept] = inverse @ xy[kept]
    used = np.nan_to_num(coef)
    return {
        "intercept": my - mx @ used,
        "coef": coef,
        "rss": max(yy - used @ xy, 0.0),
        "rank": len(kept) + 1,
        "n": n,
        "kept": kept,
        "inverse": inverse,
        "mean": mx,
    }


def penalty_path(g: np.ndarray, alpha: float, count: int = 100) -> np.ndarray:
    """Penalties from the smallest that empties the model down, equal log steps."""
    n, _, _, xx, xy, yy = centred(g)
    sx = np.sqrt(np.maximum(np.diag(xx) / n, 0))
    corr = np.divide(xy / n, sx, out=np.zeros_like(sx), where=sx > 0)
    top = np.abs(corr).max() / max(alpha, 1e-3)
    floor = 1e-4 if n > len(xx) else 1e-2
    return np.maximum(top, 1e-12) * np.geomspace(1, floor, count)


def _exact_on(active: np.ndarray, signs: np.ndarray, r: np.ndarray, c: np.ndarray, lam: float, alpha: float):
    """The fit with given active columns and signs, or None if it is no optimum."""
    w = np.zeros(len(c))
    if len(active):
        a = r[np.ix_(active, active)] + lam * (1 - alpha) * np.eye(len(active))
        try:
            w[active] = np.linalg.solve(a, c[active] - lam * alpha * signs)
        except np.linalg.LinAlgError:
            return None
        if not np.isfinite(w).all() or (np.sign(w[active]) != signs).any():
            return None
    rest = np.delete(np.arange(len(c)), active)
    slope = c - r @ w - lam * (1 - alpha) * w
    if (np.abs(slope[rest]) > lam * alpha * (1 + 1e-9) + 1e-12).any():
        return None
    return w


def _one_penalty(w: np.ndarray, r: np.ndarray, c: np.ndarray, lam: float, alpha: float, tol: float, most: int):
    """Coordinate descent from ``w``; whenever the active columns hold still, they are solved exactly.

    Those of the start come first, as they seldom change from one penalty to the next.
    """
    same = _exact_on(np.flatnonzero(w), np.sign(w[w != 0]), r, c, lam, alpha)
    if same is not None:
        return same, True
    w, before = w.copy(), None
    for _ in range(most):
        moved = 0.0
        for j in range(len(c)):
            part = c[j] - r[j] @ w + r[j, j] * w[j]
            new = np.sign(part) * max(abs(part) - lam * alpha, 0.0) / (r[j, j] + lam * (1 - alpha))
            moved = max(moved, abs(new - w[j]))
            w[j] = new
        active = np.flatnonzero(w)
        state = (tuple(active), tuple(np.sign(w[active])))
        if state == before:
            exact = _exact_on(active, np.sign(w[active]), r, c, lam, alpha)
            if exact is not None:
                return exact, True
        before = state
        if moved < tol:
            return w, True
    return w, False


def elastic_net(g: np.ndarray, alpha: float, lambdas: np.ndarray, tol: float = 1e-11, most: int = 100_000):
    """Penalised fits on the correlation matrix, from the largest penalty down, each from the one before.

    x and y are scaled to unit variance (divisor n) inside, penalties are on the
    scale of y. Returns intercepts (k,), coefficients (k, p) and whether each fit is an optimum.
    """
    n, mx, my, xx, xy, yy = centred(g)
    sx, sy = np.sqrt(np.maximum(np.diag(xx) / n, 0)), np.sqrt(max(yy / n, 0))
    lambdas = np.asarray(lambdas, dtype=float)
    b, done = np.zeros((len(lambdas), len(xx))), np.ones(len(lambdas), bool)
    live = np.flatnonzero(sx > 0)
    if sy > 0 and len(live):
        r = xx[np.ix_(live, live)] / n / np.outer(sx[live], sx[live])
        c = xy[live] / n / sx[live] / sy
        lam = lambdas / sy
        w = np.zeros((len(lam), len(live)))
        if alpha == 0:  # no corner in the penalty: one decomposition serves the whole path
            values, vectors = np.linalg.eigh(r)
            w = ((vectors.T @ c) / (np.maximum(values, 0) + lam[:, None] + 1e-300)) @ vectors.T
        else:
            last = np.zeros(len(live))
            for k in np.argsort(-lam, kind="stable"):
                last, done[k] = _one_penalty(last, r, c, float(lam[k]), alpha, tol, most)
                w[k] = last
        b[:, live] = w * sy / sx[live]
    return my - b @ mx, b, done


def partial_least_squares(g: np.ndarray, components: int):
    """One-response PLS; intercepts and coefficients for 0..components terms."""
    _, mx, my, xx, xy, _ = centred(g)
    out = [np.zeros(len(xx))]
    s, rs, ps = xy.copy(), [], []
    for _ in range(components):
        size = np.linalg.norm(s)
        if size <= 1e-12 * max(np.linalg.norm(xy), 1e-300):
            out.append(out[-1])
            continue
        direction = s / size
        r = direction.copy()
        for rk, pk in zip(rs, ps):
            r = r - (pk @ direction) * rk
        length = r @ xx @ r
        if length <= 0:
            out.append(out[-1])
            continue
        p, q = xx @ r / length, r @ xy / length
        s = s - p * q * length
        rs.append(r)
        ps.append(p)
        out.append(out[-1] + r * q)
    b = np.array(out)
    return my - b @ mx, b


def many_partial_least_squares(xx: np.ndarray, xy: np.ndarray, components: int) -> np.ndarray:
    """``partial_least_squares`` for a stack of centred cross products; slopes, (fits, components + 1, features)."""
    out = np.zeros((len(xx), components + 1, xx.shape[1]))
    s, rs, ps = xy.copy(), [], []
    full = np.linalg.norm(xy, axis=1)
    for a in range(components):
        size = np.linalg.norm(s, axis=1)
        live = size > 1e-12 * np.maximum(full, 1e-300)
        direction = s / np.where(live, size, 1.0)[:, None]
        r = direction.copy()
        for rk, pk in zip(rs, ps):
            r -= np.einsum("ni,ni->n", pk, direction)[:, None] * rk
        image = np.einsum("nij,nj->ni", xx, r)
        length = np.einsum("ni,ni->n", r, image)
        live &= length > 0
        safe = np.where(live, length, 1.0)
        p, q = image / safe[:, None], np.where(live, np.einsum("ni,ni->n", r, xy) / safe, 0.0)
        s = s - np.where(live, q * safe, 0.0)[:, None] * p
        rs.append(np.where(live[:, None], r, 0.0))
        ps.append(np.where(live[:, None], p, 0.0))
        out[:, a + 1] = out[:, a] + rs[-1] * q[:, None]
    return out


def squared_error(g: np.ndarray, intercepts, coefs) -> np.ndarray:
    """Sum of squared errors of each coefficient row on the rows behind ``g``."""
    v = np.c_[intercepts, coefs, -np.ones(len(coefs))]
    return np.einsum("ki,ij,kj->k", v, g, v)


def flat_posterior(g: np.ndarray, prior_precision: float, point: np.ndarray | None = None) -> dict:
    """Gaussian posterior of intercept and slopes under a vague normal prior.

    With ``g`` about ``point`` the prior is that of the intercept there; mean and spread are those of the intercept
    for x and y themselves.
    """
    p = len(g) - 2
    back, shift = np.eye(p + 1), np.zeros(p + 1)
    if point is not None:
        back[0, 1:], shift[0] = -point[:-1], point[-1]
    zz, zy = g[:-1, :-1], g[:-1, -1]
    scale = np.sqrt(np.maximum(np.diag(zz), 1e-300))
    scaled = zz / np.outer(scale, scale) + np.diag(prior_precision / scale**2)
    inverse = np.linalg.pinv(scaled, hermitian=True) / np.outer(scale, scale)
    own = inverse @ zy
    v = np.r_[own, -1.0]
    variance = max(v @ g @ v, 0.0) / max(g[0, 0] - len(zz), 1)
    spread = np.diag(back @ inverse @ back.T)
    return {"mean": back @ own + shift, "sd": np.sqrt(np.maximum(spread, 0) * variance), "variance": variance}
