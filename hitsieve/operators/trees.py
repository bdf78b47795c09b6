"""Tree families grown level by level over sharded rows: forests, random cuts, second-order boosting.

Every grower is a generator. It yields an operation and this shard's array, and gets the array over all shards back:
`total = yield "sum", partial`. Trees of all folds and candidates of a call grow together, one exchange a level.
"""

from __future__ import annotations

from collections.abc import Generator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np

Exchange = Generator[tuple[str, np.ndarray], np.ndarray, object]
BINS = 64  # bins of a feature in histograms, at most
SKETCH = 1024  # values of a feature a shard sends to choose the borders
CELLS = 1 << 22  # rows times tried features of the trees that grow together
L2, MIN_GAIN, EPS = 1.0, 1e-6, 1e-12
GRAIN = float(1 << 32)  # over flags gradients are whole numbers of 1 / GRAIN: sums of up to 2^21 rows are exact in any order
HELD = 1 << 25  # cells whose places are held at once
UNIT = float(1 << 40)  # a forest adds up its trees' shares as whole numbers of 1 / UNIT


@dataclass
class Tree:
    """Nodes in arrays; a leaf has feature -1. Rows go left where their value is not above the cut."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(rows):
            here = at[rows]
            inner = self.feature[here] >= 0
            rows, here = rows[inner], here[inner]
            right = x[rows, self.feature[here]] > self.cut[here]
            at[rows] = np.where(right, self.right[here], self.left[here])
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.leaves(x)]


class _Growing:
    """A tree under construction."""

    def __init__(self):
        self.feature, self.cut, self.left, self.right, self.value = [-1], [0.0], [-1], [-1], [0.0]

    def split(self, node: int, feature: int, cut: float) -> int:
        first = len(self.feature)
        self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, cut, first, first + 1
        for out, blank in ((self.feature, -1), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.value, 0.0)):
            out += [blank, blank]
        return first

    def done(self) -> Tree:
        return Tree(np.array(self.feature), np.array(self.cut), np.array(self.left), np.array(self.right), np.array(self.value))


def mix(*parts: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash of integers, alike on every shard."""
    h = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (np.asarray(p).astype(np.uint64) ^ h) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(32))
    return h


def uniform(*parts: np.ndarray | int) -> np.ndarray:
    """Numbers in [0, 1) from the hash."""
    return (mix(*parts) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def drawn(rows: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often each row is drawn with replacement: a Poisson number with mean 1 from the row's hash."""
    u, out, term, below = uniform(rows, seed, tree, 1), np.zeros(len(rows)), np.exp(-1.0), np.exp(-1.0)
    for k in range(1, 12):
        out += u >= below
        term /= k
        below += term
    return out


class Bins:
    """Cut points of every feature and the rows' bins; bins of all features are numbered one after the other."""

    def __init__(self, cuts: list[np.ndarray], x: np.ndarray):
        self.cuts = cuts
        size = np.array([len(c) + 1 for c in cuts])
        self.start = np.concatenate(([0], np.cumsum(size)))
        self.total = int(self.start[-1])
        self.feature = np.repeat(np.arange(len(cuts)), size)
        self.cut = np.concatenate([np.append(c, np.inf) for c in cuts]) if cuts else np.zeros(0)
        self.last = np.zeros(self.total, bool)
        self.last[self.start[1:] - 1] = True
        self.of = np.stack([np.searchsorted(c, x[:, j], side="left") + self.start[j] for j, c in enumerate(cuts)], 1).astype(np.int32)

    @cached_property
    def local(self) -> np.ndarray:
        """Bins counted within their feature, of which there are at most `BINS`."""
        return (self.of - self.start[:-1]).astype(np.uint8)


class Flags:
    """Features with two bins, whose sums are products of a (node, row) matrix with the flags; the others have histograms."""

    def __init__(self, bins: Bins, x: np.ndarray):
        two = np.diff(bins.start) == 2
        columns, self.rest = np.flatnonzero(two), np.flatnonzero(~two)
        self.left = bins.start[columns]
        low, high = columns[0], columns[-1] + 1
        self.of = x[:, low:high] if high - low == len(columns) else None  # neighbouring bits are used as they are
        step = max(1, CELLS // len(columns))
        if self.of is None or not all(((v == 0) | (v == 1)).all() for v in (self.of[k:k + step] for k in range(0, len(x), step))):
            self.of = (bins.of[:, columns] != self.left).astype(np.uint8)

    @staticmethod
    def many(bins: Bins) -> bool:
        """Whether most features have two bins; the borders are the same on every shard."""
        return 2 * int((np.diff(bins.start) == 2).sum()) > len(bins.cuts)

    def histogram(self, bins: Bins, slot: np.ndarray, row: np.ndarray, stats: Sequence[np.ndarray], slots: int) -> np.ndarray:
        """What `_histogram` gives."""
        out = _histogram(bins, slot, row, stats, slots, self.rest)
        n, d = self.of.shape
        step = max(1, CELLS // max(1, d, slots * len(stats)))
        order = np.argsort(row, kind="stable")
        ends = np.searchsorted(row[order], np.arange(0, n + step, step))
        right = np.zeros((len(stats) * slots, d))
        for k, (a, b) in enumerate(zip(ends, ends[1:])):
            if a < b:
                some, size = order[a:b], min(step, n - k * step)
                weight = np.stack([np.bincount(slot[some] * size + row[some] - k * step, s[some], slots * size) for s in stats])
                right += weight.reshape(-1, size) @ self.of[k * step:k * step + size].astype(np.float64, copy=False)
        right = right.reshape(len(stats), slots, d)
        whole = np.stack([np.bincount(slot, s, slots) for s in stats])
        out[:, :, self.left + 1], out[:, :, self.left] = right, whole[:, :, None] - right
        return out


def borders(x: np.ndarray) -> Exchange:
    """Cut points between the distinct values of each feature, or between quantiles where there are too many."""
    parts = np.full((x.shape[1], SKETCH), np.nan)
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        if len(values) > SKETCH:
            values = np.quantile(x[:, j], np.linspace(0, 1, SKETCH), method="nearest")
        parts[j, :len(values)] = values
    every = yield "cat", parts
    every = every.reshape(-1, *parts.shape)
    out = []
    for j in range(x.shape[1]):
        values = every[:, j].ravel()
        values = values[~np.isnan(values)]
        distinct = np.unique(values)
        if len(distinct) > BINS:
            distinct = np.unique(np.quantile(values, np.linspace(0, 1, BINS), method="nearest"))
        out.append((distinct[1:] + distinct[:-1]) / 2)
    return out


def _histogram(bins: Bins, slot: np.ndarray, row: np.ndarray, stats: Sequence[np.ndarray], slots: int, columns: np.ndarray | None = None) -> np.ndarray:
    """(stat, slot, bin) sums over the rows, of all features or some."""
    of = bins.of if columns is None else bins.of[:, columns]
    width = of.shape[1]
    out = np.zeros((len(stats), slots * bins.total))
    step = max(1, HELD // max(1, width))
    for low in range(0, len(row), step):
        place = (slot[low:low + step, None] * bins.total + of[row[low:low + step]]).ravel()
        for o, s in zip(out, stats):
            o += np.bincount(place, np.repeat(s[low:low + step], width), slots * bins.total)
    return out.reshape(len(stats), slots, bins.total)


def _left_sums(bins: Bins, sums: np.ndarray) -> np.ndarray:
    """Running sums over the bins of each feature: what lies left of the cut after a bin."""
    run = np.cumsum(sums, -1)
    before = np.concatenate((np.zeros((*run.shape[:-1], 1)), run), -1)[..., bins.start[:-1]]
    return run - before[..., bins.feature]


# ---- second-order boosting -------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Boost:
    """Settings of one boosted model."""

    rounds: int = 200
    depth: int = 6
    rate: float = 0.3
    subsample: float = 1.0
    columns: float = 1.0
    min_hessian: float = 1.0
    l2: float = L2
    seed: int = 42


def boost(x: np.ndarray, y: np.ndarray, rows: np.ndarray, use: np.ndarray, settings: Sequence[Boost]) -> Exchange:
    """Boosted trees of several models at once on logistic gradients and hessians.

    `y` and `use` are (model, row): labels, and which rows a model trains on. A level costs one exchange of sums per
    (node, feature, bin): of the smaller child alone, its sibling is the parent less that child. A model draws rows and
    features of a round by seeded hashes, so any sharding gives the same trees.
    """
    models, n = use.shape
    bins = Bins((yield from borders(x)), x)
    flags = Flags(bins, x) if Flags.many(bins) else None
    margin = np.zeros((models, n))
    trees: list[list[Tree]] = [[] for _ in settings]
    for turn in range(max((s.rounds for s in settings), default=0)):
        live = np.array([m for m, s in enumerate(settings) if turn < s.rounds])
        p = 1.0 / (1.0 + np.exp(-margin[live]))
        g, h = p - y[live], p * (1.0 - p)
        if flags is not None:
            g, h = np.rint(g * GRAIN) / GRAIN, np.rint(h * GRAIN) / GRAIN
        taken = use[live] & np.stack([uniform(rows, settings[m].seed, turn, 2) < settings[m].subsample for m in live])
        allowed = np.stack([_columns(x.shape[1], settings[m], turn) for m in live])[:, bins.feature] & ~bins.last
        grown, values = yield from _boosted_level(bins, flags, g, h, taken, allowed, [settings[m] for m in live])
        margin[live] += values
        for m, tree in zip(live, grown):
            trees[m].append(tree)
    return trees, margin


def _columns(d: int, s: Boost, turn: int) -> np.ndarray:
    order = np.argsort(mix(np.arange(d), s.seed, turn, 3), kind="stable")
    out = np.zeros(d, bool)
    out[order[:max(1, int(s.columns * d))]] = True
    return out


def _boosted_level(bins: Bins, flags: Flags | None, g: np.ndarray, h: np.ndarray, taken: np.ndarray, allowed: np.ndarray,
                   settings: Sequence[Boost]) -> Exchange:
    models, n = g.shape
    histogram = flags.histogram if flags is not None else _histogram
    trees = [_Growing() for _ in range(models)]
    at = np.zeros((models, n), np.int64)  # node of every row, drawn or not: all rows get the tree's values
    owner, node = np.arange(models), np.zeros(models, np.int64)
    l2, least = (np.array([getattr(s, k) for s in settings]) for k in ("l2", "min_hessian"))
    rate, depth = (np.array([getattr(s, k) for s in settings]) for k in ("rate", "depth"))
    m, r = np.nonzero(taken)
    flat = m * n + r
    slot_of = np.zeros((models, n), np.int64) + np.arange(models)[:, None]
    sums = yield "sum", histogram(bins, slot_of[m, r], r, (g.ravel()[flat], h.ravel()[flat]), models)
    level = 0
    while True:
        total = sums[:, :, :int(bins.start[1])].sum(-1)
        left = _left_sums(bins, sums)
        right = total[:, :, None] - left
        k = l2[owner][:, None]
        gain = left[0] ** 2 / (left[1] + k) + right[0] ** 2 / (right[1] + k) - (total[0] ** 2 / (total[1] + k[:, 0]))[:, None]
        fit = allowed[owner] & (left[1] >= least[owner][:, None]) & (right[1] >= least[owner][:, None])
        gain = np.where(fit, gain, -np.inf)
        best = gain.argmax(1)
        split = (gain[np.arange(len(best)), best] > MIN_GAIN) & (level < depth[owner])
        weight = -rate[owner] * total[0] / (total[1] + k[:, 0])
        for s, (o, v, w) in enumerate(zip(owner, node, weight)):
            trees[o].value[v] = w
        if not split.any():
            break
        children = {}
        for s in np.flatnonzero(split):
            b = best[s]
            children[s] = trees[owner[s]].split(node[s], int(bins.feature[b]), float(bins.cut[b]))
        # rows move to the children of their slot
        first = np.full(len(split), -1)
        first[list(children)] = list(children.values())
        move = slot_of >= 0
        mm, rr = np.nonzero(move)
        s = slot_of[mm, rr]
        goes = first[s] >= 0
        mm, rr, s = mm[goes], rr[goes], s[goes]
        to_right = bins.of[rr, bins.feature[best[s]]] > best[s]
        at[mm, rr] = first[s] + to_right
        rank = np.cumsum(split) - 1
        slot_of[:] = -1
        slot_of[mm, rr] = 2 * rank[s] + to_right
        parents = np.flatnonzero(split)
        light_right = right[1][parents, best[parents]] < left[1][parents, best[parents]]
        use = taken[mm, rr] & (to_right == light_right[rank[s]])
        part = yield "sum", histogram(bins, rank[s][use], rr[use], (g[mm[use], rr[use]], h[mm[use], rr[use]]), len(parents))
        other = sums[:, parents] - part
        both = np.where(light_right[None, :, None, None], np.stack((other, part), 2), np.stack((part, other), 2))
        sums = both.reshape(2, 2 * len(parents), bins.total)
        owner = np.repeat(owner[parents], 2)
        node = np.stack([first[parents], first[parents] + 1], 1).ravel()
        level += 1
    grown = [t.done() for t in trees]
    return grown, np.stack([t.value[a] for t, a in zip(grown, at)])


# ---- forests ---------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Forest:
    """Settings of one forest; `random_cuts` draws one cut a feature between the node's own ends, without bootstrap.

    `first` is the number of its first tree: parts of a forest that differ in it alone add up to the whole one.
    """

    trees: int = 200
    depth: int | None = None
    min_split: int = 2
    min_leaf: int = 1
    features: str | float = "sqrt"
    random_cuts: bool = False
    seed: int = 42
    first: int = 0

    def tried(self, d: int) -> int:
        k = {"sqrt": d ** 0.5, "log2": np.log2(max(d, 2))}.get(self.features)
        return min(d, max(1, int(k if k is not None else float(self.features) * d)))


def forest(x: np.ndarray, y: np.ndarray, rows: np.ndarray, use: np.ndarray, settings: Sequence[Forest], keep: bool = True,
           together: int = 64, want: np.ndarray | None = None) -> Exchange:
    """The trees of several forests where they are kept, and for every row the sum of its trees' shares.

    Trees grow `together` as far as their rows fit, whatever forest they belong to. A node tries as many features as its forest asks for, in an
    order drawn by hash, and goes on in that order while none of them parts its rows. Shares are added up in units of
    1 / `UNIT`, which is exact, so parts of a forest give the same sum in any order. Rows outside `want` (model, row) have none.
    """
    models, n = use.shape
    bins = Bins((yield from borders(x)), x) if not all(s.random_cuts for s in settings) else None
    most = -(yield "min", np.array([-float(n)]))[0]
    width = max((s.tried(x.shape[1]) for s in settings), default=1)
    together = int(max(1, min(together, CELLS // max(1.0, most * width))))
    order = sorted(((s.random_cuts, m, t) for m, s in enumerate(settings) for t in range(s.first, s.first + s.trees)))
    score = np.zeros((models, n))
    asked = [np.arange(n) if want is None else np.flatnonzero(w) for w in (use if want is None else want)]
    shown = [x if len(a) == n else x[a] for a in asked]
    trees: list[list[Tree]] = [[] for _ in settings]
    for low in range(0, len(order), together):
        for cuts in (False, True):
            batch = [(m, t) for c, m, t in order[low:low + together] if c == cuts]
            if batch:
                grown = yield from _grow_forest(x, y, rows, use, settings, batch, None if cuts else bins)
                for (m, _), tree in zip(batch, grown):
                    if len(asked[m]):
                        score[m, asked[m]] += np.rint(tree.predict(shown[m]) * UNIT)
                    if keep:
                        trees[m].append(tree)
    return trees, score / UNIT


def _order(tree_seed: np.ndarray, node: np.ndarray, d: int, upto: int) -> np.ndarray:
    """The first `upto` features of each node's order by hash."""
    drawn_ = mix(tree_seed[:, None], node[:, None], np.arange(d)[None, :])
    if upto < d:
        some = np.argpartition(drawn_, upto - 1, 1)[:, :upto]
        return np.take_along_axis(some, np.argsort(np.take_along_axis(drawn_, some, 1), 1, kind="stable"), 1)
    return np.argsort(drawn_, 1, kind="stable")


def _grow_forest(x: np.ndarray, y: np.ndarray, rows: np.ndarray, use: np.ndarray, settings: Sequence[Forest], batch: list[tuple[int, int]],
                 bins: Bins | None) -> Exchange:
    d = x.shape[1]
    sets = [settings[m] for m, _ in batch]
    weight = np.stack([use[m] * (1.0 if bins is None else drawn(rows, settings[m].seed, t)) for m, t in batch])
    tried = np.array([s.tried(d) for s in sets])
    width = int(tried.max())
    deepest = np.array([s.depth if s.depth is not None else 1 << 30 for s in sets])
    least, least_split = (np.array([getattr(s, k) for s in sets]) for k in ("min_leaf", "min_split"))
    tree_seed = np.array([int(mix(s.seed, t, 5)) & (1 << 62) - 1 for s, (_, t) in zip(sets, batch)])
    tree, row = np.nonzero(weight > 0)
    w, pos = weight[tree, row], weight[tree, row] * y[[m for m, _ in batch]][tree, row]
    slot = tree.copy()
    # open nodes: tree, number in the tree, depth, how many features were tried
    owner, node, depth, seen = np.arange(len(batch)), np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
    length, values, splits = np.ones(len(batch), np.int64), [], []
    while len(owner):
        columns = np.minimum(seen[:, None] + np.arange(width), d - 1)
        features = np.take_along_axis(_order(tree_seed[owner], node, d, min(d, int(seen.max()) + width)), columns, 1)
        open_ = (np.arange(width) < tried[owner][:, None]) & (seen[:, None] + np.arange(width) < d)
        args = slot, row, w, pos, len(owner), features
        gain, cut, left, whole = yield from (_random_cuts(x, *args, tree_seed[owner], node) if bins is None else _best_cuts(bins, *args))
        size = whole[2]
        fit = open_ & (left[2] >= least[owner][:, None]) & (size[:, None] - left[2] >= least[owner][:, None])
        gain = np.where(fit & np.isfinite(cut), gain, -np.inf)
        best = gain.argmax(1)
        pick = np.arange(len(owner)), best
        share = whole[1] / np.maximum(whole[0], EPS)
        stop = (depth >= deepest[owner]) | (size < least_split[owner]) | (size < 2 * least[owner]) | (share < EPS) | (share > 1 - EPS)
        ok = ~stop & np.isfinite(gain[pick])
        again = ~stop & ~ok & (seen + tried[owner] < d)
        values.append((owner, node, share))
        # the children of a tree's split nodes are numbered on from its last node
        split = np.flatnonzero(ok)
        of = owner[split]
        by_tree = np.argsort(of, kind="stable")
        times = np.bincount(of, minlength=len(batch))
        rank = np.empty(len(split), np.int64)
        rank[by_tree] = np.arange(len(split)) - np.repeat(np.cumsum(times) - times, times)
        first = length[of] + 2 * rank
        length += 2 * times
        splits.append((of, node[split], features[pick][split], cut[pick][split], first))
        # the next open nodes: children of the split ones, and those that go on trying
        number = np.full(len(owner), -1)
        number[ok] = 2 * np.arange(len(split))
        number[again] = 2 * len(split) + np.arange(again.sum())
        keep = number[slot] >= 0
        row, w, pos, slot = row[keep], w[keep], pos[keep], slot[keep]
        right = x[row, features[pick][slot]] > cut[pick][slot]
        slot = number[slot] + (ok[slot] & right)
        order = np.argsort(slot, kind="stable")  # rows stay together by their open node
        row, w, pos, slot = row[order], w[order], pos[order], slot[order]
        owner_, again = np.repeat(of, 2), np.flatnonzero(again)
        node = np.concatenate((np.stack([first, first + 1], 1).ravel(), node[again]))
        depth = np.concatenate((np.repeat(depth[split] + 1, 2), depth[again]))
        seen = np.concatenate((np.zeros(2 * len(split), np.int64), seen[again] + tried[owner[again]]))
        owner = np.concatenate((owner_, owner[again]))
    return _assembled(length, values, splits)


def _assembled(length: np.ndarray, values: list[tuple], splits: list[tuple]) -> list[Tree]:
    """Trees from their nodes' values and splits, level by level; a node that was tried again has its last value."""
    start = np.concatenate(([0], np.cumsum(length)))
    feature, left, right = (np.full(start[-1], -1) for _ in range(3))
    cut, value = np.zeros(start[-1]), np.zeros(start[-1])
    for owner, node, share in values:
        value[start[owner] + node] = share
    for owner, node, f, c, first in splits:
        at = start[owner] + node
        feature[at], cut[at], left[at], right[at] = f, c, first, first + 1
    return [Tree(*(v[a:b].copy() for v in (feature, cut, left, right, value))) for a, b in zip(start, start[1:])]


def _gini(left: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Gain of splits in the Gini index times the node's weight; sums are (weight, weight of class 1, rows)."""
    def purity(w, p):
        return (p ** 2 + (w - p) ** 2) / np.maximum(w, EPS)
    return purity(left[0], left[1]) + purity(whole[0] - left[0], whole[1] - left[1]) - purity(whole[0], whole[1])


def _merged(key: np.ndarray, sums: np.ndarray, top: int = 1 << 62) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys below `top` and the sums of their rows; each row of `sums` goes with equally many neighbouring keys."""
    times = len(key) // len(sums)
    if top <= 4 * len(key):  # few places: counted without sorting
        there = np.bincount(key, minlength=top)
        found = np.flatnonzero(there)
        every = [np.bincount(key, np.repeat(s, times), top)[found] if not (s == 1).all() else there[found].astype(float) for s in sums.T]
        return found, np.stack(every, 1)
    # sums of whole numbers are the same in any order; a key with its row behind it is sorted faster than places by key
    bits = max(1, (len(sums) - 1).bit_length())
    if int(key.max()) >> 62 - bits:
        order = np.argsort(key)
        key, row = key[order], order // times
    else:
        both = np.sort(key << bits | np.repeat(np.arange(len(sums)), times))
        key, row = both >> bits, both & (1 << bits) - 1
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    many = np.diff(np.append(first, len(key))).astype(float)
    return key[first], np.stack([np.add.reduceat(s[row], first) if not (s == 1).all() else many for s in sums.T], 1)


def _best_cuts(bins: Bins, slot, row, w, pos, slots: int, features: np.ndarray) -> Exchange:
    """Per node and tried feature the cut of largest gain: (gain, cut, left sums, sums of the node).

    Only bins that hold rows are summed and exchanged; deep nodes have far fewer of them than their features have.
    """
    width = features.shape[1]
    place = features[slot]
    place += (row * bins.local.shape[1])[:, None]
    key = (slot * (width * BINS))[:, None] + np.arange(width) * BINS
    key += bins.local.ravel().take(place)
    key = key.ravel()
    stats = np.stack((w, pos, np.ones(len(w))), 1)
    gain, cut = np.full(slots * width, -np.inf), np.full(slots * width, np.nan)
    left, whole = np.zeros((3, slots * width)), np.zeros((3, slots * width))
    if len(key):
        key, stats = _merged(key, stats, slots * width * BINS)
    part = np.concatenate((key[:, None], stats), 1)
    every = yield "cat", part
    if len(every):
        if every is not part:
            key, stats = _merged(every[:, 0].astype(np.int64), every[:, 1:])
        group = key // BINS
        starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        ends = np.append(starts[1:], len(key)) - 1
        run = np.cumsum(stats, 0)
        of = np.cumsum(np.concatenate(([False], group[1:] != group[:-1])))
        here = (run - (run[starts] - stats[starts])[of]).T
        total = here[:, ends]
        value = _gini(here, total[:, of])
        value[ends] = -np.inf
        top = np.maximum.reduceat(value, starts)
        at = np.minimum.reduceat(np.where(value == top[of], np.arange(len(key)), len(key)), starts)
        at = np.minimum(at, len(key) - 1)
        which = group[starts]
        gain[which], left[:, which], whole[:, which] = top, here[:, at], total
        cut[which] = bins.cut[bins.start[features.ravel()[which]] + key[at] % BINS]
    shape = slots, width
    return gain.reshape(shape), cut.reshape(shape), left.reshape(3, *shape), whole.reshape(3, *shape)[:, :, 0]


def _random_cuts(x: np.ndarray, slot, row, w, pos, slots: int, features: np.ndarray, seeds: np.ndarray, nodes: np.ndarray) -> Exchange:
    """Per node and tried feature one cut drawn between the node's own least and largest value, and its gain."""
    width = features.shape[1]
    many = np.bincount(slot, minlength=slots)
    there = np.flatnonzero(many)
    many, at = many[there], (np.cumsum(many) - many)[there]
    flat, begin = x.ravel(), row * x.shape[1]
    # rows come in the order of their nodes, so each feature's values of a node are neighbours
    values = np.stack([flat[begin + np.repeat(f, many)] for f in features[there].T]) if len(row) else np.zeros((width, 0))

    def per_node(kept: np.ndarray, ufunc, blank: float) -> np.ndarray:
        out = np.full((slots, len(kept)), blank)
        if len(there):
            out[there] = ufunc.reduceat(kept, at, 1).T
        return out

    ends = yield "min", np.stack((per_node(values, np.minimum, np.inf), -per_node(values, np.maximum, -np.inf)))
    low, high = ends[0], -ends[1]
    cut = low + uniform(seeds[:, None], nodes[:, None], features, 7) * (high - low)
    cut = np.where(high > low, cut, np.nan)
    # without a bootstrap the weights are the rows
    n, p = np.zeros((slots, width)), np.zeros((slots, width))
    for j, (v, c) in enumerate(zip(values, cut[there].T)):
        goes_left = v <= np.repeat(c, many)
        for out, s in ((n, w), (p, pos)):
            if len(there):
                out[there, j] = np.add.reduceat(goes_left * s, at)
    all_n, all_p = (np.repeat(per_node(v[None], np.add, 0.0), width, 1) for v in (w, pos))
    parts = np.stack((n, p, n, all_n, all_p, all_n))
    sums = yield "sum", parts
    left, whole = sums[:3], sums[3:, :, 0]
    return _gini(left, whole[:, :, None]), cut, left, whole
