"""Linear, network and kernel solvers over sharded rows, as generators of the same kind as the tree growers.

Each yields an operation and this shard's part and gets the result over all shards; see `trees`.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

import numpy as np

from hitsieve.operators.trees import Exchange, uniform

MEMORY = 12  # past steps that the linear solver keeps
KERNEL_CELLS = 1 << 22  # cells of a kernel matrix that are held at once


# ---- many linear models ----------------------------------------------------------------------------------------

def linear(x: np.ndarray, y: np.ndarray, use: np.ndarray, l1: np.ndarray, l2: np.ndarray, steps: int | Sequence[int] = 1000, tol: float = 1e-9) -> Exchange:
    """Logistic regressions, a column each: mean log loss + l1 |w| + l2/2 w², the intercept free; (d + 1, model) weights.

    One pass over the rows gives the losses and gradients of all columns as a matrix; every column has its own
    quasi-Newton step (limited memory, kept to the orthant of its signs where l1 > 0) and line search, and leaves the
    matrix when its gradient is below `tol`.
    """
    design = np.concatenate((x, np.ones((len(x), 1))), 1)
    models, width = len(use), design.shape[1]
    n = yield "sum", use.sum(1).astype(float)
    n = np.maximum(n, 1.0)
    free = np.ones((width, 1))
    free[-1] = 0.0
    weight = (use / n[:, None]).T

    def smooth(w, which):
        z = design @ w
        t = y[which].T
        loss = (weight[:, which] * (np.logaddexp(0.0, z) - t * z)).sum(0)
        grad = design.T @ (weight[:, which] * (1.0 / (1.0 + np.exp(-z)) - t))
        total = yield "sum", np.vstack((loss[None], grad))
        return total[0] + (l2[which] / 2 * (free * w ** 2)).sum(0) + l1[which] * np.abs(free * w).sum(0), total[1:] + l2[which] * free * w

    w = np.zeros((width, models))
    value, grad = yield from smooth(w, np.arange(models))
    live = np.arange(models)
    past_s, past_y = (np.zeros((MEMORY, width, models)) for _ in range(2))
    inner = np.zeros((MEMORY, models))
    most = np.broadcast_to(np.asarray(steps), models)
    for turn in range(int(most.max(initial=0))):
        sparse = l1[live] * free > 0
        pseudo = _pseudo(w[:, live], grad[:, live], l1[live] * free)
        still = (np.abs(pseudo).max(0) > tol * np.maximum(1.0, np.abs(w[:, live]).max(0))) & (turn < most[live])
        live, pseudo, sparse = live[still], pseudo[:, still], sparse[:, still]
        if not len(live):
            break
        way = -_two_loops(pseudo, past_s[:, :, live], past_y[:, :, live], inner[:, live])
        way = np.where(sparse & (way * pseudo >= 0), 0.0, way)
        uphill = (way * pseudo).sum(0) >= 0
        way = np.where(uphill, -pseudo, way)
        side = np.where(w[:, live] != 0, np.sign(w[:, live]), -np.sign(pseudo))
        step = np.where(inner[:, live].any(0), 1.0, 1.0 / np.maximum(np.linalg.norm(pseudo, axis=0), 1e-12))
        open_, moved = np.arange(len(live)), np.zeros(len(live), bool)
        new_w, new_value, new_grad = w[:, live].copy(), value[live].copy(), grad[:, live].copy()
        for _ in range(40):
            at = live[open_]
            trial = w[:, at] + step[open_] * way[:, open_]
            trial = np.where(sparse[:, open_] & (np.sign(trial) != side[:, open_]), 0.0, trial)
            f, g = yield from smooth(trial, at)
            good = f <= value[at] + 1e-4 * (pseudo[:, open_] * (trial - w[:, at])).sum(0)
            done = open_[good]
            new_w[:, done], new_value[done], new_grad[:, done], moved[done] = trial[:, good], f[good], g[:, good], True
            open_ = open_[~good]
            if not len(open_):
                break
            step[open_] /= 2
        s, change = new_w - w[:, live], new_grad - grad[:, live]
        curve = (s * change).sum(0)
        keep = moved & (curve > 1e-14 * (change ** 2).sum(0))
        at = live[keep]
        for store, new in ((past_s, s), (past_y, change)):
            store[:-1, :, at] = store[1:, :, at]
            store[-1, :, at] = new[:, keep].T
        inner[:-1, at] = inner[1:, at]
        inner[-1, at] = curve[keep]
        w[:, live], value[live], grad[:, live] = new_w, new_value, new_grad
        live = live[moved]  # a column that no step improves is done
    return w


def _pseudo(w: np.ndarray, grad: np.ndarray, l1: np.ndarray) -> np.ndarray:
    at_zero = np.where(grad + l1 < 0, grad + l1, np.where(grad - l1 > 0, grad - l1, 0.0))
    return np.where(w != 0, grad + l1 * np.sign(w), np.where(l1 > 0, at_zero, grad))


def _two_loops(q: np.ndarray, s: np.ndarray, y: np.ndarray, inner: np.ndarray) -> np.ndarray:
    q, there = q.copy(), inner > 0
    rho = np.where(there, 1.0 / np.where(there, inner, 1.0), 0.0)
    alpha = np.zeros_like(rho)
    for k in range(len(s) - 1, -1, -1):
        alpha[k] = rho[k] * (s[k] * q).sum(0)
        q -= alpha[k] * y[k]
    size = (y[-1] ** 2).sum(0)
    q *= np.where(there[-1], inner[-1] / np.where(size > 0, size, 1.0), 1.0)
    for k in range(len(s)):
        q += s[k] * (alpha[k] - rho[k] * (y[k] * q).sum(0))
    return q


# ---- network ---------------------------------------------------------------------------------------------------

def network(x: np.ndarray, y: np.ndarray, rows: np.ndarray, use: np.ndarray, hidden: Sequence[int] = (256, 128), alpha: float = 1e-4,
            rate: float = 1e-3, epochs: int = 500, seed: int = 42, batch: int = 200, tol: float = 1e-4, patience: int = 10) -> Exchange:
    """Rectified hidden layers, logistic output, Adam on mini-batches with L2; stops when the loss no longer falls.

    An epoch deals the rows to its batches by a seeded hash, so any sharding takes the same batches; one exchange adds
    up a batch's gradients. Returns the layers as (weights, bias).
    """
    x, y, rows = x[use].astype(np.float64), y[use].astype(np.float64), rows[use]
    sizes = [x.shape[1], *hidden, 1]
    rng = np.random.default_rng(seed)
    layers = []
    for a, b in zip(sizes, sizes[1:]):
        bound = np.sqrt((2.0 if b == 1 else 6.0) / (a + b))
        layers += [rng.uniform(-bound, bound, (a, b)), rng.uniform(-bound, bound, b)]
    first, second = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers]
    n = int((yield "sum", np.array([float(len(x))]))[0])
    batches, turn, best, worse = max(1, -(-n // batch)), 0, np.inf, 0
    for epoch in range(epochs):
        dealt = (uniform(rows, seed, epoch, 11) * batches).astype(np.int64)
        total = 0.0
        for k in range(batches):
            at = dealt == k
            loss, grads = _backward(layers, x[at], y[at])
            flat = yield "sum", np.concatenate([np.array([loss, float(at.sum())]), *[g.ravel() for g in grads]])
            size = flat[1]
            if size == 0:
                continue
            turn += 1
            begin = 2
            for i, p in enumerate(layers):
                g = flat[begin:begin + p.size].reshape(p.shape) / size
                begin += p.size
                if p.ndim == 2:
                    g = g + alpha / size * p
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g ** 2
                layers[i] = p - rate * np.sqrt(1 - 0.999 ** turn) / (1 - 0.9 ** turn) * first[i] / (np.sqrt(second[i]) + 1e-8)
            total += flat[0] + 0.5 * alpha * sum((p ** 2).sum() for p in layers if p.ndim == 2)
        loss = total / max(n, 1)
        worse = worse + 1 if loss > best - tol else 0
        best = min(best, loss)
        if worse > patience:
            break
    return layers


def network_margin(layers: Sequence[np.ndarray], x: np.ndarray) -> np.ndarray:
    for w, b in zip(layers[:-2:2], layers[1:-2:2]):
        x = np.maximum(x @ w + b, 0.0)
    return (x @ layers[-2] + layers[-1])[:, 0]


def _backward(layers: Sequence[np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    seen = [x]
    for w, b in zip(layers[:-2:2], layers[1:-2:2]):
        seen.append(np.maximum(seen[-1] @ w + b, 0.0))
    z = (seen[-1] @ layers[-2] + layers[-1])[:, 0]
    grads: list[np.ndarray] = [np.zeros(0)] * len(layers)
    error = (1.0 / (1.0 + np.exp(-z)) - y)[:, None]
    for k in range(len(seen) - 1, -1, -1):
        grads[2 * k], grads[2 * k + 1] = seen[k].T @ error, error.sum(0)
        if k:
            error = (error @ layers[2 * k].T) * (seen[k] > 0)
    return float((np.logaddexp(0.0, z) - y * z).sum()), grads


# ---- kernel machine --------------------------------------------------------------------------------------------

def kernel(x: np.ndarray, z: np.ndarray, gamma: float) -> np.ndarray:
    return np.exp(-gamma * np.maximum((x ** 2).sum(1)[:, None] + (z ** 2).sum(1) - 2.0 * x @ z.T, 0.0))


def kernel_sum(x: np.ndarray, z: np.ndarray, times: np.ndarray, gamma: float) -> np.ndarray:
    """`kernel(x, z, gamma) @ times`, a bounded block of the matrix at a time."""
    out, wide = np.zeros(len(x)), min(len(z), 1 << 12)
    step = max(1, KERNEL_CELLS // max(1, wide))
    for low in range(0, len(x), step):
        for at in range(0, len(z), max(1, wide)):
            out[low:low + step] += kernel(x[low:low + step], z[at:at + wide], gamma) @ times[at:at + wide]
    return out


def dual(k: np.ndarray, sign: np.ndarray, c: float, tol: float = 1e-3, steps: int = 10_000_000, a: np.ndarray | None = None,
         grad: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Multipliers and intercept of the soft-margin machine over a kernel matrix, two rows at a time.

    Each step takes the row that breaks optimality most and the partner that lowers the objective most. `a` and `grad`
    are the multipliers to start from and the gradient there, which other rows may have a share in.
    """
    a, grad = (np.zeros(len(sign)), -np.ones(len(sign))) if a is None else (a.copy(), grad.copy())
    diag = np.diag(k)
    pos = sign > 0
    for _ in range(steps):
        v = -sign * grad
        up, low = np.where(pos, a < c, a > 0), np.where(pos, a > 0, a < c)
        i = int(np.where(up, v, -np.inf).argmax())
        gap = v[i] - v
        if not up[i] or not low.any() or np.where(low, gap, -np.inf).max() < tol:
            break
        curve = np.maximum(diag[i] + diag - 2.0 * k[i], 1e-12)
        j = int(np.where(low & (gap > 0), gap ** 2 / curve, -np.inf).argmax())
        room_i, room_j = (c - a[i] if pos[i] else a[i]), (a[j] if pos[j] else c - a[j])
        d = min(gap[j] / curve[j], room_i, room_j)
        a[i] = c if pos[i] and d == room_i else 0.0 if not pos[i] and d == room_i else a[i] + sign[i] * d
        a[j] = 0.0 if pos[j] and d == room_j else c if not pos[j] and d == room_j else a[j] - sign[j] * d
        grad += sign * d * (k[:, i] - k[:, j])
    v, inside = -sign * grad, (a > 0) & (a < c)
    if inside.any():
        return a, float(v[inside].mean())
    up, low = np.where(pos, a < c, a > 0), np.where(pos, a > 0, a < c)
    ends = [v[m].max() if top else v[m].min() for m, top in ((up, True), (low, False)) if m.any()]
    return a, float(np.mean(ends)) if ends else 0.0


def machine(x: np.ndarray, y: np.ndarray, use: np.ndarray, c: float = 1.0, gamma: float | str = "scale", tol: float = 1e-3,
            added: int = 2000) -> Exchange:
    """Kernel machine by working sets: (support vectors, signed multipliers, intercept, gamma, sigmoid).

    The `added` rows that break optimality most, half of them of each kind, meet and are solved exactly against the fixed
    rest; what their multipliers change goes into every row's sum, until no pair of rows breaks optimality by `tol`. That is
    the optimum over all rows. No kernel matrix is larger than a block of rows by the working set, however many rows or
    support vectors there are. The sigmoid turns margins into probabilities.
    """
    x, sign = x[use], np.where(y[use] > 0, 1.0, -1.0)
    if gamma == "scale":
        s = yield "sum", np.array([float(x.size), x.sum(), (x ** 2).sum()])
        var = s[2] / max(s[0], 1.0) - (s[1] / max(s[0], 1.0)) ** 2
        gamma = 1.0 / (x.shape[1] * var) if var > 0 else 1.0
    mark = float(int.from_bytes(os.urandom(6)))  # finds this shard's rows among those that meet; no result depends on it
    marks = yield "cat", np.array([mark])
    own, half = float(np.flatnonzero(marks == mark)[0]), max(1, added // 2)
    a, total, pos, d = np.zeros(len(x)), np.zeros(len(x)), sign > 0, x.shape[1]
    b, best, worse = 0.0, np.inf, 0
    while True:
        v = sign - total
        up, low = np.where(pos, a < c, a > 0), np.where(pos, a > 0, a < c)
        at = np.concatenate([_first(np.where(up, -v, np.inf), half), _first(np.where(low, v, np.inf), half)])
        side = np.concatenate([np.zeros(min(half, int(up.sum()))), np.ones(min(half, int(low.sum())))])
        met = yield "cat", np.concatenate((x[at], np.stack((sign[at], a[at], v[at], side, np.full(len(at), own), at), 1)), 1)
        ups, lows = met[met[:, d + 3] == 0], met[met[:, d + 3] == 1]
        if not len(ups) or not len(lows):
            b = float(ups[:, d + 2].max() if len(ups) else lows[:, d + 2].min()) if len(met) else 0.0
            break
        gap = ups[:, d + 2].max() - lows[:, d + 2].min()
        b = float(ups[:, d + 2].max() + lows[:, d + 2].min()) / 2
        best, worse = (gap, 0) if gap < 0.9 * best else (best, worse + 1)
        if gap < tol:
            break
        chosen = np.concatenate((ups[_first(-ups[:, d + 2], half)], lows[_first(lows[:, d + 2], half)]))
        chosen = chosen[np.unique(chosen[:, d + 4:], axis=0, return_index=True)[1]]  # a row may be of both kinds
        z, s, old, grad = chosen[:, :d], chosen[:, d], chosen[:, d + 1], -chosen[:, d] * chosen[:, d + 2]
        new, _ = dual(kernel(z, z, gamma), s, c, max(tol / 2, 0.1 * gap / (1 + worse)), a=old, grad=grad)
        moved = new != old
        mine = chosen[:, d + 4] == own
        a[chosen[mine, d + 5].astype(int)] = new[mine]
        total += kernel_sum(x, z[moved], ((new - old) * s)[moved], gamma)
    inside = (a > 0) & (a < c)
    free = yield "sum", np.array([float(inside.sum()), v[inside].sum()])
    b = float(free[1] / free[0]) if free[0] else b
    held = a > 0
    vectors = yield "cat", np.concatenate((x[held], (a * sign)[held, None]), 1)
    sigmoid = yield from platt(total + b, pos)
    return vectors[:, :-1], vectors[:, -1], b, float(gamma), sigmoid


def _first(value: np.ndarray, count: int) -> np.ndarray:
    """Places of the `count` smallest finite values, the smallest first."""
    count = min(count, int(np.isfinite(value).sum()))
    at = np.argpartition(value, count - 1)[:count] if 0 < count < len(value) else np.flatnonzero(np.isfinite(value))
    return at[np.argsort(value[at], kind="stable")]


def platt(margin: np.ndarray, label: np.ndarray, steps: int = 100) -> Exchange:
    """Slope and offset of the sigmoid on margins, with smoothed targets, by Newton steps with halving."""
    pos = yield "sum", np.array([float(label.sum()), float((~label).sum())])
    target = np.where(label, (pos[0] + 1.0) / (pos[0] + 2.0), 1.0 / (pos[1] + 2.0))
    at = np.array([0.0, np.log((pos[0] + 1.0) / (pos[1] + 1.0))])

    def terms(t):
        z = t[0] * margin + t[1]
        p = 1.0 / (1.0 + np.exp(-z))
        e, w = p - target, p * (1 - p)
        return np.array([(np.logaddexp(0.0, z) - target * z).sum(), (e * margin).sum(), e.sum(), (w * margin ** 2).sum(), (w * margin).sum(), w.sum()])

    now = yield "sum", terms(at)
    for _ in range(steps):
        h = np.array([[now[3] + 1e-12, now[4]], [now[4], now[5] + 1e-12]])
        way = -np.linalg.solve(h, now[1:3])
        if np.abs(now[1:3]).max() < 1e-9 * max(1.0, pos.sum()):
            break
        step, better = 1.0, False
        while step > 1e-8 and not better:
            new = yield "sum", terms(at + step * way)
            better = new[0] < now[0]
            if better:
                at, now = at + step * way, new
            step /= 2
        if not better:
            break
    return at
