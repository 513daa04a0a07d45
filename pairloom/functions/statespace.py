"""ARIMA models of many series at once: exact Gaussian likelihood by the Kalman filter.

All series of an Arrow batch go through one filter: every step is a few array operations over
(series x trial parameters), so nothing loops over series. The state is that of an ARMA(p, q)
with max(p, q + 1) entries and starts from its stationary distribution. Mean and variance drop
out: the filter runs on the series and on a constant at once, generalised least squares gives the
mean, the innovations' mean square the variance. What is left are p + q numbers, searched by a
damped Newton method on partial autocorrelations, so every trial is stationary and invertible.
"""

from __future__ import annotations

import itertools

import numpy as np

#: Step of the numerical derivatives and greatest number of Newton steps.
STEP, STEPS = 1e-4, 100

#: Starts that are followed to their top.
CLIMBS = 3


def coefficients(partial: np.ndarray) -> np.ndarray:
    """Autoregressive coefficients of partial autocorrelations (last axis, in (-1, 1))."""
    out = partial[..., :0]
    for k in range(partial.shape[-1]):
        r = partial[..., k:k + 1]
        out = np.concatenate([out - r * out[..., ::-1], r], axis=-1)
    return out


class Arma:
    """Zero or constant mean ARMA(p, q) of a batch of series of any lengths."""

    def __init__(self, series: list[np.ndarray], p: int, q: int, mean: bool):
        self.p, self.q, self.mean = p, q, mean
        self.sizes = np.array([len(s) for s in series])
        longest = int(self.sizes.max(initial=0))
        # A filter is linear: scaling keeps the likelihood's shape and the search well conditioned.
        self.shift = np.array([s.mean() if mean else 0.0 for s in series])
        spread = np.array([np.sqrt(np.mean((s - m) ** 2)) for s, m in zip(series, self.shift)])
        self.scale = np.where(spread > 0, spread, 1.0)
        self.values = np.zeros((longest, len(series)))
        for k, s in enumerate(series):
            self.values[:len(s), k] = (s - self.shift[k]) / self.scale[k]

    def model(self, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """phi and theta of unbounded parameters (..., p + q)."""
        bounded = np.tanh(free)
        return coefficients(bounded[..., :self.p]), -coefficients(bounded[..., self.p:])

    def filter(self, rows: np.ndarray, free: np.ndarray):
        """Minus twice the log likelihood (without constants) of series ``rows`` at ``free`` (trials x series x
        parameters), the mean, and the state after the last value."""
        phi, theta = self.model(free)
        shape, r = free.shape[:2], max(self.p, self.q + 1, 1)
        move = np.zeros((*shape, r, r))
        move[..., :self.p, 0] = phi
        move[..., np.arange(r - 1), np.arange(1, r)] = 1.0
        push = np.zeros((*shape, r))
        push[..., 0] = 1.0
        push[..., 1:self.q + 1] = theta
        noise = push[..., :, None] * push[..., None, :]
        both = np.einsum("...ij,...kl->...ikjl", move, move).reshape(*shape, r * r, r * r)
        cover = np.linalg.solve(np.eye(r * r) - both, noise.reshape(*shape, r * r, 1)).reshape(*shape, r, r)
        state = np.zeros((*shape, r, 2))  # of the series and of a constant
        logs, yy, y1, ones = (np.zeros(shape) for _ in range(4))
        sizes = self.sizes[rows]
        turned = np.swapaxes(move, -1, -2)
        settled = None
        for t in range(int(sizes.max(initial=0))):
            live = t < sizes
            wide = np.maximum(cover[..., 0, 0], 1e-300)
            v = self.values[t, rows] - state[..., 0, 0]
            u = (1.0 if self.mean else 0.0) - state[..., 0, 1]
            logs += np.where(live, np.log(wide), 0.0)
            yy += np.where(live, v * v / wide, 0.0)
            y1 += np.where(live, v * u / wide, 0.0)
            ones += np.where(live, u * u / wide, 0.0)
            if settled is None:
                gain = (move @ cover[..., :, :1])[..., 0] / wide[..., None]
            after = (move @ state) + gain[..., None] * np.stack([v, u], axis=-1)[..., None, :]
            state = np.where(live[None, :, None, None], after, state)
            if settled is None:
                new = move @ cover @ turned + noise - gain[..., :, None] * gain[..., None, :] * wide[..., None, None]
                if t % 16 == 15 and np.abs(new - cover).max() < 1e-14:
                    settled = t
                cover = new
        level = np.where(ones > 0, y1 / np.where(ones > 0, ones, 1.0), 0.0)
        square = np.maximum(yy - level * y1, 1e-300)
        value = sizes * np.log(square / np.maximum(sizes, 1)) + logs
        return value, level, state[..., 0] - level[..., None] * state[..., 1], move

    def fit(self) -> np.ndarray:
        """Unbounded parameters of greatest likelihood, one row per series."""
        n, k = len(self.sizes), self.p + self.q
        rows = np.arange(n)
        if not k or not n:
            return np.zeros((n, k))
        starts = np.array(list(itertools.product((-0.6, 0.0, 0.6), repeat=k)))
        tried = np.broadcast_to(starts[:, None, :], (len(starts), n, k))
        order = np.argsort(self.filter(rows, tried)[0], axis=0, kind="stable")
        # The likelihood may have several tops: climb from the best few starts.
        found = [self._climb(starts[order[m]].copy()) for m in range(min(CLIMBS, len(starts)))]
        best = np.argmin([value for _, value in found], axis=0)
        return np.stack([free for free, _ in found])[best, rows]

    def _climb(self, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Newton steps from these parameters, and the value they end at."""
        n, k = free.shape
        rows = np.arange(n)
        value = self.filter(rows, free[None])[0][0]
        damp, open_ = np.full(n, 1e-3), np.ones(n, bool)
        unit = np.eye(k) * STEP
        pairs = list(itertools.combinations(range(k), 2))
        moves = np.array([*unit, *-unit, *[unit[i] + unit[j] for i, j in pairs], *[-unit[i] - unit[j] for i, j in pairs]])
        for _ in range(STEPS):
            at = rows[open_]
            if not len(at):
                break
            around = self.filter(at, free[at] + moves[:, None, :])[0]
            up, down = around[:k], around[k:2 * k]
            slope = (up - down).T / (2 * STEP)
            bend = np.zeros((len(at), k, k))
            bend[:, np.arange(k), np.arange(k)] = ((up - 2 * value[at] + down) / STEP ** 2).T
            for m, (i, j) in enumerate(pairs):
                plus, minus = around[2 * k + m], around[2 * k + len(pairs) + m]
                bend[:, i, j] = bend[:, j, i] = (plus + minus + 2 * value[at] - up[i] - down[i] - up[j] - down[j]) / (2 * STEP ** 2)
            # Newton's step on the bend made positive, damped where it does not help.
            w, q = np.linalg.eigh(bend)
            w = np.maximum(np.abs(w), 1e-6)
            turned = np.einsum("nji,nj->ni", q, slope)
            sizes = np.array([0.0, 1.0, 10.0, 100.0])[:, None] * damp[at] + (np.arange(4) > 0)[:, None] * 1e-9
            steps = -np.einsum("nij,tnj->tni", q, turned / (w * (1 + sizes[:, :, None])))
            steps = np.clip(steps, -1.5, 1.5)
            halves = np.concatenate([steps, steps[:1] * 0.25, steps[:1] * 0.05, steps[:1] * 0.01])
            trial = np.clip(free[at] + halves, -6.0, 6.0)
            found = self.filter(at, trial)[0]
            pick = np.argmin(found, axis=0)
            gain = value[at] - found[pick, np.arange(len(at))]
            better = gain > 0
            free[at[better]] = trial[pick[better], np.flatnonzero(better)]
            value[at[better]] -= gain[better]
            moved = np.abs(halves[pick, np.arange(len(at))]).max(axis=1)
            damp[at] = np.where(better, np.maximum(damp[at] / 4, 1e-4), damp[at] * 20)
            open_[at[(damp[at] > 1e7) | (better & (gain < 1e-10) & (moved < 1e-7))]] = False
        return free, value

    def paths(self, free: np.ndarray, horizons: np.ndarray) -> list[np.ndarray]:
        """Forecasts of each series, as many steps as its horizon says."""
        rows = np.arange(len(self.sizes))
        _, level, state, move = self.filter(rows, free[None])
        level, state, move = level[0], state[0], move[0]
        out = np.zeros((int(horizons.max(initial=0)), len(rows)))
        for h in range(len(out)):
            out[h] = state[:, 0]
            state = (move @ state[..., None])[..., 0]
        return [self.shift[k] + self.scale[k] * (level[k] + out[:h, k]) for k, h in enumerate(horizons)]


def forecast_paths(series: list[np.ndarray], horizons: np.ndarray, order: tuple) -> list[np.ndarray]:
    """Forecasts of ARIMA(p, d, q): differenced d times, with a mean where d is 0, then summed up again.

    A series too short for the order, or constant after differencing, repeats its last value (or goes
    on by its constant change).
    """
    p, d, q = order
    out: list = [None] * len(series)
    changed = {}
    for k, s in enumerate(series):
        x = np.diff(s, d)
        if len(s) < max(3, p + d + q + 2) or not len(x) or np.ptp(x) <= 1e-12 * max(1.0, np.abs(x).max()):
            step = x[-1] if d and len(x) and len(s) >= max(3, p + d + q + 2) and d == 1 else 0.0
            out[k] = s[-1] + step * np.arange(1, horizons[k] + 1)
        else:
            changed[k] = x
    if changed:
        keys = list(changed)
        arma = Arma([changed[k] for k in keys], p, q, mean=d == 0)
        for k, path in zip(keys, arma.paths(arma.fit(), horizons[keys])):
            for level in range(d - 1, -1, -1):
                path = np.diff(series[k], level)[-1] + np.cumsum(path)
            out[k] = path
    return out
