"""Forests on binned rows: the trees of a part are grown level by level inside one task, many parts at once.

Trees see nothing of a feature but its bin, so equal binned rows are one cell with the number of its rows per
class; a bag draws Poisson(n) of them, the sum of n draws of one row.  The rules are those of Spark ML's forests:
gini, ceil(sqrt(features)) features drawn a node, a leaf where none of them gains, and leaves that say the same
under one parent joined.
"""

from __future__ import annotations

import math
import sys
from typing import NamedTuple

import numpy as np
from pyspark import cloudpickle

# executors get these functions with the tasks, so they need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: (tree, cell) pairs grown together: few trees of many cells, many trees of few.
SLOTS = 300_000


class Cells(NamedTuple):
    """Distinct binned rows: ``bins`` (feature, cell), ``rows`` (class, fold, cell), the last fold holding rows without
    one, and a weight per class."""

    bins: np.ndarray
    rows: np.ndarray
    weights: tuple


def cells_of(bins, label, fold, filas, n_folds: int, weights) -> Cells:
    order = np.lexsort(bins)
    new = np.any([np.diff(b[order], prepend=-1) != 0 for b in bins], axis=0)
    cell = np.empty(len(order), dtype="int64")
    cell[order] = np.cumsum(new) - 1
    at = order[new]
    rows = np.zeros((2, n_folds + 1, len(at)), dtype="int64")
    np.add.at(rows, (label, fold, cell), filas)
    return Cells(np.ascontiguousarray(np.stack([b[at] for b in bins]).astype("uint8")), rows, weights)


def chosen_features(rngs, tree, n: int):
    """(node, feature): whether a node may split by a feature; each tree draws from its own generator."""
    draws = np.concatenate([r.random((k, n)) for r, k in zip(rngs, np.bincount(tree, minlength=len(rngs)).tolist())])
    return draws.argsort(axis=1).argsort(axis=1) < math.ceil(math.sqrt(n))


def best_splits(cells: Cells, cell, node, c, totals, may, leaf: int):
    """(feature, bin) per node of the split that gains most, feature -1 where none gains.  Counts are whole numbers,
    so that only the scores are rounded."""
    w0, w1 = cells.weights
    t0, t1 = totals
    m = len(t0)
    score = ((w0 * t0) ** 2 + (w1 * t1) ** 2) / (w0 * t0 + w1 * t1) * (1 + 1e-12)
    feature, cut = np.full(m, -1, dtype="int64"), np.zeros(m, dtype="int64")
    for f in range(len(cells.bins)):
        nodes = np.flatnonzero(may[:, f])
        if not len(nodes):
            continue
        number = np.full(m, -1, dtype="int64")
        number[nodes] = np.arange(len(nodes))
        at = number[node]
        rows = np.flatnonzero(at >= 0)
        width = int(cells.bins[f].max()) + 1
        key = at[rows] * width + cells.bins[f][cell[rows]]
        a0, a1 = (np.bincount(key, weights=x[rows], minlength=len(nodes) * width) for x in c)
        filled = np.flatnonzero(a0 + a1)
        k = filled // width
        first = np.searchsorted(k, np.arange(len(nodes)))
        a0, a1 = a0[filled], a1[filled]
        l0, l1 = np.cumsum(a0), np.cumsum(a1)
        l0, l1 = l0 - (l0[first] - a0[first])[k], l1 - (l1[first] - a1[first])[k]
        n0, n1 = t0[nodes][k], t1[nodes][k]
        r0, r1 = n0 - l0, n1 - l1
        ok = np.flatnonzero((l0 + l1 >= leaf) & (r0 + r1 >= leaf))
        if not len(ok):
            continue
        l0, l1, r0, r1, k = w0 * l0[ok], w1 * l1[ok], w0 * r0[ok], w1 * r1[ok], k[ok]
        s = (l0 * l0 + l1 * l1) / (l0 + l1) + (r0 * r0 + r1 * r1) / (r0 + r1)
        starts = np.flatnonzero(np.diff(k, prepend=-1))
        top = np.maximum.reduceat(s, starts)
        hit = np.flatnonzero(s == np.repeat(top, np.diff(starts, append=len(k))))
        hit = hit[np.flatnonzero(np.diff(k[hit], prepend=-1))]  # the first of equal ones
        better = top > score[nodes[k[hit]]]
        hit, top = hit[better], top[better]
        at = nodes[k[hit]]
        score[at], feature[at], cut[at] = top, f, filled[ok[hit]] % width
    return feature, cut


def grow(cells: Cells, bags, asked, leaf: int, max_depth: int, cuts, rngs):
    """The trees grown on ``bags`` (per tree the rows per class and cell).

    Returns the nodes, level after level (``tree``, ``left`` child or -1, the right one follows it; ``feature``,
    ``bin``; rows per class ``n0``, ``n1``; probability ``p`` of class 1, that of the joined leaf below one), and for each
    depth limit of ``cuts`` the node of each tree at which each of the ``asked`` cells ends.
    """
    n = len(bags)
    w0, w1 = cells.weights
    wanted = np.full(cells.bins.shape[1], -1, dtype="int64")
    wanted[asked] = np.arange(len(asked))
    kept = [np.flatnonzero((b[0] > 0) | (b[1] > 0) | (wanted >= 0)) for b in bags]
    cell = np.concatenate(kept)
    node = np.repeat(np.arange(n), [len(k) for k in kept])
    c = [np.concatenate([b[i][k] for b, k in zip(bags, kept)]).astype("float64") for i in (0, 1)]
    place = np.where(wanted[cell] >= 0, wanted[cell] + node * len(asked), -1)
    ends, ended = np.zeros(n * len(asked), dtype="int64"), {}
    tree, base, depth, levels = np.arange(n), 0, 0, []
    while len(tree):
        m = len(tree)
        t0, t1 = (np.bincount(node, weights=x, minlength=m) for x in c)
        seen = place >= 0
        if depth in cuts:
            ends[place[seen]] = base + node[seen]
            ended[depth] = ends.copy()
        may = chosen_features(rngs, tree, len(cells.bins))
        may &= ((t0 > 0) & (t1 > 0) & (t0 + t1 >= 2 * leaf) & (depth < max_depth))[:, None]
        feature, cut = np.full(m, -1, dtype="int64"), np.zeros(m, dtype="int64")
        if may.any():
            bagged = np.flatnonzero((c[0] + c[1]) > 0)
            with np.errstate(invalid="ignore", divide="ignore"):
                feature, cut = best_splits(cells, cell[bagged], node[bagged], [x[bagged] for x in c], (t0, t1), may, leaf)
        split = feature >= 0
        rank = np.cumsum(split) - 1
        with np.errstate(invalid="ignore", divide="ignore"):
            p = np.where(t0 + t1 > 0, w1 * t1 / (w0 * t0 + w1 * t1), 0.0)
        levels.append({"tree": tree, "left": np.where(split, base + m + 2 * rank, -1), "feature": feature, "bin": cut,
                       "n0": t0, "n1": t1, "p": p})
        on = split[node]
        last = ~on & seen
        ends[place[last]] = base + node[last]
        on = np.flatnonzero(on)
        cell, node, place, c = cell[on], node[on], place[on], [x[on] for x in c]
        right = cells.bins[feature[node], cell] > cut[node]
        node = 2 * rank[node] + right
        tree, base, depth = np.repeat(tree[split], 2), base + m, depth + 1
    nodes = {k: np.concatenate([x[k] for x in levels]) for k in levels[0]}
    join_leaves(nodes, [len(x["tree"]) for x in levels], cells.weights)
    return nodes, [ended.get(d, ends) for d in cuts]


def join_leaves(nodes: dict, sizes, weights) -> None:
    """Marks (``leaf``) where a tree ends once leaves of one prediction under one parent are joined, and gives what is
    below such a node its probability."""
    left, says = nodes["left"], weights[1] * nodes["n1"] > weights[0] * nodes["n0"]
    leaf, p = left < 0, nodes["p"]
    bounds = np.cumsum([0, *sizes])
    inner = [a + np.flatnonzero(left[a:b] >= 0) for a, b in zip(bounds[:-1], bounds[1:])]
    for i in reversed(inner):
        x, y = left[i], left[i] + 1
        leaf[i] = leaf[x] & leaf[y] & (says[x] == says[y])
    below = np.zeros(len(left), dtype=bool)
    for i in inner:
        i = i[leaf[i] | below[i]]
        for child in (left[i], left[i] + 1):
            below[child], p[child] = True, p[i]
    nodes["leaf"], nodes["below"] = leaf, below


def grow_part(cells: Cells, fold: int | None, leaf: int, max_depth: int, trees: int, seed: int, cuts, asked):
    """Yields (number of the first tree, nodes, ends) of :func:`grow` for a part of a forest, some trees at a time.

    ``fold`` is left out of the bags; tree ``i`` draws from its own generator, so what is grown together changes nothing.
    """
    rows = cells.rows.sum(axis=1) if fold is None else cells.rows[:, :-1].sum(axis=1) - cells.rows[:, fold]
    together = max(1, SLOTS // max(1, rows.shape[1]))
    for first in range(0, trees, together):
        rngs = [np.random.default_rng([seed, i]) for i in range(first, min(first + together, trees))]
        yield first, *grow(cells, [r.poisson(rows) for r in rngs], asked, leaf, max_depth, cuts, rngs)
