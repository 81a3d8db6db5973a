"""Spanning forests, dendrograms and the choice of density clusters, as arrays over one component.

Edges are given in ascending order; their positions decide every tie. A dendrogram of n leaves
numbers them 0..n-1 and its merges n..2n-2 in the order of the tree's edges, so a node's parent
always has the higher number: bottom-up is ascending, top-down descending.
"""

from __future__ import annotations

import numpy as np


def joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` (each node's representative, the smallest of its set) after the sets of a[i] and b[i] became one."""
    root = root.copy()
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        low = np.minimum(x, y)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while (root[root] != root).any():
            root = root[root]


def spanning_forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions of the edges of the minimum spanning forest, by Boruvka rounds: each set takes its first edge that leaves it."""
    root, taken, live = np.arange(n), np.zeros(len(a), bool), np.arange(len(a))
    while True:
        live = live[root[a[live]] != root[b[live]]]
        if not len(live):
            return np.flatnonzero(taken)
        first = np.full(n, len(a))
        np.minimum.at(first, root[a[live]], live)
        np.minimum.at(first, root[b[live]], live)
        picked = np.unique(first[first < len(a)])
        taken[picked] = True
        root = joined(root, a[picked], b[picked])


def dendrogram(mass: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(side of a, side of b) of each merge and the mass of each node, from a spanning tree's edges in ascending order."""
    n = len(mass)
    above, total = list(range(2 * n - 1)), [*map(float, mass), *[0.0] * (n - 1)]
    sides = np.zeros((2, n - 1), np.int64)

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    for i, (p, q) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = top(p), top(q)
        above[x] = above[y] = n + i
        total[n + i] = total[x] + total[y]
        sides[:, i] = x, y
    return sides[0], sides[1], np.array(total)


def density_clusters(mass: np.ndarray, reach: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(number, birth) of each point's cluster, -1 and 0 for points in none.

    ``reach``, ``a``, ``b``: the edges of a connected component in ascending order. The hierarchy is
    condensed by mass: a cluster lives from the merge above its highest node down a chain of nodes
    with a mass of ``least`` or more, and ends where both sides of a merge have that mass. Its
    stability is the sum, over the chain, of the mass that leaves times the rise in 1 / reach since
    its birth. A cluster is chosen over those below it if it has the mass and its stability is not
    smaller than what they can have together. A cluster born at the level of the one above it does
    not count there, neither its mass nor its stability, and stands beside it (a fixed rule of the
    data model). The root is number 0; the two clusters below one merge have numbers in a row, and
    merges are counted from the top, b's side before a's.
    """
    n = len(mass)
    tree = spanning_forest(n, a, b)
    left, right, total = dendrogram(mass, a[tree], b[tree])
    level, node, root = 1.0 / reach[tree], np.arange(n, 2 * n - 1), 2 * n - 2
    over = np.full(2 * n - 1, -1)
    over[left] = over[right] = node
    heavy = total >= least
    forks = heavy[left] & heavy[right]

    head = over.copy()  # each node's cluster, by the cluster's highest node
    starts = np.sort(np.concatenate([left[forks], right[forks], [root]]))
    head[starts] = starts
    while (head[head] != head).any():
        head = head[head]
    birth = np.zeros(2 * n - 1)
    born = starts[:-1]  # the root comes last
    birth[born] = level[over[born] - n]

    lives = heavy[node] | (node == root)
    leaving = np.where(heavy[left] == heavy[right], total[node], np.where(heavy[left], total[right], total[left]))
    chain = np.flatnonzero(lives)[::-1]
    of = head[node[chain]]
    stability = np.bincount(of, leaving[chain] * (level[chain] - birth[of]), minlength=2 * n - 1)

    fork = np.full(2 * n - 1, -1)  # the merge that ends a cluster in two
    fork[head[node[forks]]] = np.flatnonzero(forks)
    ends = {c: (int(left[f]), int(right[f])) for c, f in zip(starts.tolist(), fork[starts].tolist(), strict=True) if f >= 0}
    seen, best, inside = np.bincount(head[:n], mass, minlength=2 * n - 1), np.zeros(2 * n - 1), np.zeros(2 * n - 1, np.int64)
    wins = np.zeros(2 * n - 1, bool)
    for c in starts.tolist():
        parts = ends.get(c, ())
        inside[c] = sum(int(inside[x]) for x in parts) + bool(parts)
        later = [x for x in parts if birth[x] > birth[c]]
        seen[c] += sum(seen[x] for x in later)
        rest = sum(best[x] for x in later)
        wins[c] = seen[c] >= least and (not parts or stability[c] >= rest)
        best[c] = stability[c] if wins[c] else rest
    number, place = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.int64)
    chosen, since = np.full(2 * n - 1, -1), np.full(2 * n - 1, np.inf)  # since: the first birth among a cluster's winners, its own and those above
    chosen[root], since[root] = (root, 0.0) if wins[root] else (-1, np.inf)
    for c in starts[::-1].tolist():
        if c in ends:
            x, y = ends[c]
            number[x], number[y] = 1 + 2 * place[c], 2 + 2 * place[c]
            place[y], place[x] = place[c] + 1, place[c] + 1 + inside[y]
            for s in (x, y):
                chosen[s] = s if wins[s] and not since[c] < birth[s] else chosen[c]
                since[s] = min(since[c], birth[s]) if wins[s] else since[c]
    own = chosen[head[:n]]
    return np.where(own >= 0, number[own], -1), np.where(own >= 0, birth[own], 0.0)
