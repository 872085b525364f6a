"""Random forest of one station's rows: exact splits, trees of any depth, leaves of one drawn row.

Every tree draws ``rate`` of the rows with replacement and sees all features.
A node is split at the boundary of least squared error until its drawn values
are equal or its rows have the same features (the first feature where
boundaries are equally good); thresholds lie halfway between
the two neighbouring values of the node. Trees grow level by level, a batch
of them at a time, and the rows to forecast walk along, so no tree is kept.
Rows with the same features are one cell: no split can part them.
"""

from __future__ import annotations

import numpy as np

BATCH = 200_000             # drawn rows or forecast cells of the trees grown at a time


def _best_splits(node, rank, x_rank, weight, total, n_nodes):
    """(score, lower rank, upper rank) of every node's best boundary of one feature; score -inf without one."""
    key = node * (int(x_rank.max()) + 1) + rank
    order = np.argsort(key, kind="stable")
    key, at = key[order], node[order]
    start = np.searchsorted(at, np.arange(n_nodes))
    end = np.r_[start[1:], len(at)] - 1
    w, s = np.cumsum(weight[order]), np.cumsum(total[order])
    w_0, s_0 = w[start] - weight[order][start], s[start] - total[order][start]
    left_w, left_s = w - w_0[at], s - s_0[at]
    right_w, right_s = (w[end] - w_0)[at] - left_w, (s[end] - s_0)[at] - left_s
    cut = np.r_[(at[1:] == at[:-1]) & (key[1:] != key[:-1]), False]
    score = np.full(len(at), -np.inf)
    score[cut] = left_s[cut] ** 2 / left_w[cut] + right_s[cut] ** 2 / right_w[cut]
    best = np.maximum.reduceat(score, start)
    hit = np.flatnonzero(score == best[at])
    place = hit[np.searchsorted(at[hit], np.arange(n_nodes))]
    rank = rank[order]
    return best, rank[place], rank[np.minimum(place + 1, len(rank) - 1)]


def _grow(cells, ranks, values, cell, y, drawn):
    """Predictions (trees x cells) of one batch of trees; ``drawn`` holds each tree's rows."""
    trees, n_cells = len(drawn), len(cells)
    key = (np.arange(trees)[:, None] * n_cells + cell[drawn]).ravel()
    order = np.argsort(key, kind="stable")
    key, y_drawn = key[order], y[drawn.ravel()[order]]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    weight = np.diff(np.r_[first, len(key)]).astype(float)
    total, low, high = (f.reduceat(y_drawn, first) for f in (np.add, np.minimum, np.maximum))
    node, at = np.divmod(key[first], n_cells)
    ask = np.arange(trees * n_cells)                       # cells to forecast: (tree, cell)
    ask_node, out = ask // n_cells, np.empty(trees * n_cells)
    n_nodes = trees
    while len(ask):
        order = np.argsort(node, kind="stable")
        node, at, weight, total, low, high = (a[order] for a in (node, at, weight, total, low, high))
        start = np.searchsorted(node, np.arange(n_nodes))
        mean = np.add.reduceat(total, start) / np.add.reduceat(weight, start)
        split = np.minimum.reduceat(low, start) < np.maximum.reduceat(high, start)
        best, feature, threshold = np.full(n_nodes, -np.inf), np.zeros(n_nodes, int), np.zeros(n_nodes)
        for f in range(cells.shape[1]):
            if len(values[f]) < 2:
                continue
            score, lower, upper = _best_splits(node, ranks[at, f], ranks[:, f], weight, total, n_nodes)
            better = score - 1e-10 * np.abs(score) > best
            a, b = values[f][lower], values[f][upper]
            middle = a + (b - a) / 2
            best = np.where(better, score, best)
            feature = np.where(better, f, feature)
            threshold = np.where(better, np.where(middle < b, middle, a), threshold)
        split &= best > -np.inf
        done = ~split[ask_node]
        out[ask[done]] = mean[ask_node[done]]
        ask, ask_node = ask[~done], ask_node[~done]
        child = 2 * (np.cumsum(split) - 1)
        ask_node = child[ask_node] + (cells[ask % n_cells, feature[ask_node]] > threshold[ask_node])
        go = split[node]
        node, at, weight, total, low, high = (a[go] for a in (node, at, weight, total, low, high))
        node = child[node] + (cells[at, feature[node]] > threshold[node])
        n_nodes = 2 * int(split.sum())
    return out.reshape(trees, n_cells)


def forest_members(x_train, y, x_all, trees: int, rate: float, seed) -> np.ndarray:
    """Each tree's forecast of every row of ``x_all``: rows x trees."""
    rng = np.random.default_rng(seed)
    cells, cell = np.unique(np.vstack([x_train, x_all]), axis=0, return_inverse=True)
    cell = cell.ravel()
    values, ranks = [], np.empty(cells.shape, np.int64)
    for f in range(cells.shape[1]):
        v, ranks[:, f] = np.unique(cells[:, f], return_inverse=True)
        values.append(v)
    n, centre = len(y), y.mean()
    draws = max(1, round(n * rate))
    step = max(1, BATCH // max(draws, len(cells)))
    parts = []
    for t in range(0, trees, step):
        drawn = rng.integers(0, n, size=(min(step, trees - t), draws))
        parts.append(_grow(cells, ranks, values, cell[:n], y - centre, drawn)[:, cell[n:]])
    return np.vstack(parts).T + centre
