"""Regression trees grown level by level: all trees of a block at once, in numpy.

Helpers for one task of ``operators/trees.py``; a block is some trees over the rows of one series.
"""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass, field

import numpy as np

TINY = 1e-9
SAMPLES = 1 << 17  # rows of trees that grow side by side


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit hashes: the finaliser of SplitMix64."""
    x = np.atleast_1d(np.asarray(x, np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tree_keys(seed: int, trees: np.ndarray) -> np.ndarray:
    """A key per tree number, the same in whatever block the tree is grown."""
    return mixed(mixed(seed) ^ np.asarray(trees).astype(np.uint64))


def begins(change: np.ndarray) -> np.ndarray:
    """Where runs begin, from whether each place differs from the one before it."""
    return np.concatenate([[0], np.flatnonzero(change) + 1])


def bootstrap(keys: np.ndarray, rows: int) -> np.ndarray:
    """How often each tree draws each of ``rows`` rows, out of as many draws."""
    draws = mixed(keys[:, None] ^ (np.arange(rows, dtype=np.uint64) << np.uint64(20)))
    picked = ((draws >> np.uint64(11)).astype(np.float64) / 2**53 * rows).astype(np.int64)
    flat = picked + np.arange(len(keys))[:, None] * rows
    return np.bincount(flat.ravel(), minlength=len(keys) * rows).reshape(len(keys), rows)


def drawn_features(path: np.ndarray, features: int, count: int) -> np.ndarray:
    """Which ``count`` features each node looks at, by the node's key."""
    if count >= features:
        return np.ones((len(path), features), bool)
    luck = mixed(path[:, None] ^ (np.arange(1, features + 1, dtype=np.uint64) << np.uint64(40)))
    out = np.zeros((len(path), features), bool)
    np.put_along_axis(out, np.argpartition(luck, count, axis=1)[:, :count], True, axis=1)
    return out


@dataclass
class Samples:
    """The rows of every tree: row and tree numbers, weights, and their order by each feature."""

    x: np.ndarray  # rows x features
    row: np.ndarray
    tree: np.ndarray
    weight: np.ndarray
    order: list[np.ndarray] = field(default_factory=list)
    columns: np.ndarray = field(init=False)
    unit: bool = field(init=False)  # all weights are one

    def __post_init__(self) -> None:
        self.columns, self.unit = np.ascontiguousarray(self.x.T), bool((self.weight == 1).all())
        for column in self.columns:
            rank = np.unique(column, return_inverse=True)[1]
            rank = rank.astype(np.uint16 if len(rank) < 1 << 16 else np.int64)
            by_value = np.argsort(rank[self.row], kind="stable")
            tree = self.tree[by_value]
            small = np.uint16 if self.tree.max(initial=0) < 1 << 16 else np.int64
            self.order.append(by_value[np.argsort(tree.astype(small), kind="stable")])


def cuttable(own: np.ndarray, size: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, ...]:
    """Where rows that lie by node may be cut, with enough of the node's rows on either side.

    For each such place: the last row on its left, the node, the rows to the left, and the row
    before the node's first.
    """
    begin = begins(own[1:] != own[:-1]) if len(own) else np.zeros(0, np.int64)
    first = np.zeros(len(size), np.int64)
    first[own[begin]] = begin
    left = np.arange(len(own)) - first[own] + 1
    i = np.flatnonzero((left >= least[own]) & (size[own] - left >= least[own]))
    return i, own[i], left[i], first[own[i]] - 1


@dataclass
class Grown:
    fitted: np.ndarray  # per sample
    said: np.ndarray  # trees x queries
    importance: np.ndarray  # trees x features, weighted variance taken away
    at: dict[int, tuple[np.ndarray, np.ndarray]]  # the last two, had growth ended at that depth


def grow(
    samples: Samples,
    y: np.ndarray,
    keys: np.ndarray,
    leaf: np.ndarray,
    depth: np.ndarray,
    count: int,
    query: np.ndarray,
    marks: Collection[int] = (),
) -> Grown:
    """Grow a tree per key on the samples' targets ``y``, each to its own ``depth``.

    A node looks at ``count`` features and is split where that takes most of the weighted variance
    away, midway between two of its values, with at least ``leaf`` of its rows on either side. Ties
    go to the first feature and the smallest value. ``query`` rows are led down the same trees.
    """
    x, weight = samples.x, samples.weight
    node, owner, path = samples.tree.copy(), np.arange(len(keys)), keys.copy()
    where = np.repeat(owner[:, None], len(query), axis=1)
    out = Grown(np.zeros(len(node)), np.zeros(where.shape), np.zeros((len(keys), x.shape[1])), {})
    order, wy, level, over = list(samples.order), weight * y, 0, False
    while True:
        live, n = np.flatnonzero(node >= 0), len(owner)
        own = node[live]
        size = np.bincount(own, minlength=n)
        w, s, ss = (np.bincount(own, v[live], n) for v in (weight, wy, wy * y))
        mean = s / w
        out.fitted[live] = mean[own]
        tree, asked = np.nonzero(where >= 0)
        out.said[tree, asked] = mean[where[tree, asked]]
        if level in marks:
            out.at[level] = out.said.copy(), out.importance.copy()
        base = s * s / w
        open_ = (level < depth[owner]) & (size >= 2 * leaf[owner]) & (ss - base > TINY * (ss + TINY))
        if not open_.any():
            return out
        looked = drawn_features(path, x.shape[1], count) & open_[:, None]
        best, feature, cut = base + TINY * (ss + TINY), np.full(n, -1), np.zeros(n)
        small, least, shared = np.uint16 if n < 1 << 16 else np.int64, leaf[owner], None
        every = looked[own].all()
        for f in range(x.shape[1]):
            ids = order[f]
            if level:
                # Rows of a node lie together, by value; without a draw that order is handed down.
                ids = ids[node[ids] >= 0] if over else ids
            if not every:
                order[f] = ids
                ids = ids[looked[node[ids], f]]
            if level or not every:
                ids = ids[np.argsort(node[ids].astype(small), kind="stable")]
            if every:
                order[f] = ids
                shared = laid = shared or cuttable(node[ids], size, least)
            else:
                laid = cuttable(node[ids], size, least)
            i, at, left, start = laid
            v = samples.columns[f][samples.row[ids]]
            differ = v[i + 1] > v[i]
            i, at, left, start = i[differ], at[differ], left[differ], start[differ]
            if not len(i):
                continue
            cs = np.cumsum(wy[ids])
            ls = cs[i] - np.where(start < 0, 0, cs[start])
            lw = left
            if not samples.unit:
                cw = np.cumsum(weight[ids])
                lw = cw[i] - np.where(start < 0, 0, cw[start])
            gain = ls * ls / lw + (s[at] - ls) ** 2 / (w[at] - lw)
            begin = begins(at[1:] != at[:-1])
            most = np.maximum.reduceat(gain, begin)
            long = np.concatenate([begin[1:], [len(at)]]) - begin
            top = np.flatnonzero(gain >= np.repeat(most, long) * (1 - TINY))
            # The first of each node's places that reach its most.
            top = top[begins(at[top][1:] != at[top][:-1])]
            at, i = at[top], i[top]
            better = most > best[at] * (1 + TINY)
            at, i = at[better], i[better]
            middle = (v[i] + v[i + 1]) / 2
            best[at], feature[at] = most[better], f
            cut[at] = np.where(middle < v[i + 1], middle, v[i])
        split = np.flatnonzero(feature >= 0)
        np.add.at(out.importance, (owner[split], feature[split]), best[split] - base[split])
        child = np.full(n, -1)
        child[split] = 2 * np.arange(len(split))
        right = x[samples.row[live], feature[own]] > cut[own]
        node[live] = np.where(child[own] >= 0, child[own] + right, -1)
        over = len(split) < n
        own = where[tree, asked]
        right = query[asked, feature[own]] > cut[own]
        where[tree, asked] = np.where(child[own] >= 0, child[own] + right, -1)
        owner = np.repeat(owner[split], 2)
        path = mixed(np.repeat(path[split], 2) + np.tile([1, 2], len(split)).astype(np.uint64))
        level += 1


def shares(importance: np.ndarray) -> np.ndarray:
    """Importances per tree, each tree's summing to one, zeros for a tree without a split."""
    total = importance.sum(1, keepdims=True)
    return importance / np.where(total > 0, total, 1)


def forest_block(
    x: np.ndarray, y: np.ndarray, query: np.ndarray, trees: np.ndarray, leaf: int, count: int,
    depths: Collection[int], seed: int,
) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each depth: the sum of the trees' answers per query row, and of their importances."""
    centre, deepest = y.mean(), max(depths)
    sums = {d: (np.zeros(len(query)), np.zeros(x.shape[1])) for d in depths}
    step = max(1, SAMPLES // len(x))
    for begin in range(0, len(trees), step):
        keys = tree_keys(seed, trees[begin : begin + step])
        drawn = bootstrap(keys, len(x))
        tree, row = np.nonzero(drawn)
        samples = Samples(x, row, tree, drawn[tree, row].astype(float))
        many = np.ones(len(keys), np.int64)
        got = grow(samples, (y - centre)[row], keys, many * leaf, many * deepest, count, query, set(depths))
        for d, (answers, importances) in sums.items():
            said, importance = got.at.get(d, (got.said, got.importance))
            answers += said.sum(0) + centre * len(keys)
            importances += shares(importance).sum(0)
    return sums


def boosted_chains(
    x: np.ndarray, y: np.ndarray, query: np.ndarray, rates: np.ndarray, leaf: np.ndarray, depth: np.ndarray,
    rounds: int, marks: Collection[int],
) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Chains of trees on each other's residuals, one per rate, leaf and depth, all at once.

    For each number of rounds in ``marks``: the answers (chains x query rows), and the importances.
    """
    n, centre = len(rates), y.mean()
    tree, row = (a.ravel() for a in np.indices((n, len(x))))
    samples = Samples(x, row, tree, np.ones(len(row)))
    now, said = np.zeros(len(row)), np.zeros((n, len(query)))
    importance, out = np.zeros((n, x.shape[1])), {}
    keys = tree_keys(0, np.arange(n))
    for k in range(1, rounds + 1):
        got = grow(samples, (y - centre)[row] - now, keys, leaf, depth, x.shape[1], query)
        now += rates[tree] * got.fitted
        said += rates[:, None] * got.said
        importance += shares(got.importance)
        if k in marks:
            out[k] = said + centre, importance.copy()
    return out
