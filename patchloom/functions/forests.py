"""The difference of two trees as lists in document order: the steps of :mod:`patchloom.operators.trees` for one tree at a time."""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np

DELETE, INSERT, UPDATE, MOVE = range(4)
ACTIONS = ["delete", "insert", "update", "move"]
#: Positions that stand for no parent, and for one that is not among the nodes.
NONE, LOST = -1, -2


def kept_order(ranks: list[int]) -> list[bool]:
    """Which entries belong to the longest increasing subsequence (of several the one whose entries end earliest)."""
    ends, ends_at, back = [], [], []
    for i, x in enumerate(ranks):
        k = bisect_left(ends, x)
        back.append(ends_at[k - 1] if k else -1)
        ends[k : k + 1], ends_at[k : k + 1] = [x], [i]
    kept, i = [False] * len(ranks), ends_at[-1] if ends_at else -1
    while i >= 0:
        kept[i], i = True, back[i]
    return kept


class Forest:
    """Nodes by position: ``parent`` (a position, :data:`NONE` or :data:`LOST`), ``place``, ``kind`` (-1: null) and ``label`` (kind
    and value); of each subtree ``size``, ``height`` and ``digest``, equal for equal subtrees that share ``known``."""

    def __init__(self, node: np.ndarray, parent: np.ndarray, rootless: np.ndarray, place: np.ndarray, kind: np.ndarray, label: np.ndarray, known: dict):
        at = np.minimum(np.searchsorted(node, parent), max(len(node) - 1, 0))
        at = np.where(rootless, NONE, np.where(node[at] == parent, at, LOST)) if len(node) else at
        self.parent, self.place, self.kind, self.label = at.tolist(), place.tolist(), kind.tolist(), label.tolist()
        n = len(self.parent)
        self.kids, self.size, self.height, self.digest = [[] for _ in range(n)], [1] * n, [1] * n, [0] * n
        for i in range(n - 1, -1, -1):
            kids, up = self.kids[i], self.parent[i]
            kids.reverse()
            self.digest[i] = known.setdefault((self.label[i], *[self.digest[k] for k in kids]), len(known))
            if up >= 0:
                self.kids[up].append(i)
                self.size[up] += self.size[i]
                self.height[up] = max(self.height[up], self.height[i] + 1)

    def __len__(self) -> int:
        return len(self.parent)

    def above(self, i: int) -> Iterator[int]:
        """Positions of the ancestors, the nearest first."""
        while (i := self.parent[i]) >= 0:
            yield i


def _tops(own: Forest, free: list[bool], others: set[int], least: int) -> dict[int, list[int]]:
    """The outermost free subtrees of at least ``least`` levels that the other side has, by digest in document order."""
    out, i = defaultdict(list), 0
    while i < len(own):
        if free[i] and not (own.height[i] >= least and own.digest[i] in others):
            i += 1
            continue
        if free[i]:
            out[own.digest[i]].append(i)
        i += own.size[i]
    return out


def _equal_subtrees(a: Forest, b: Forest, pair: list[int], back: list[int], least: int) -> list[tuple[int, int]]:
    """Pairs the nodes of equal subtrees (see :func:`trees.isomorphic_matches`); their roots."""
    free_a, free_b, roots = [True] * len(a), [True] * len(b), []
    while True:
        has_a = {x for x, free in zip(a.digest, free_a) if free}
        has_b = {x for x, free in zip(b.digest, free_b) if free}
        x, y = _tops(a, free_a, has_b, least), _tops(b, free_b, has_a, least)
        met = [both for digest, own in x.items() for both in zip(own, y.get(digest, []))]
        if not met:
            return roots
        for p, q in met:
            n = a.size[p]
            pair[p : p + n], back[q : q + n] = range(q, q + n), range(p, p + n)
            free_a[p : p + n] = free_b[q : q + n] = [False] * n
        roots += met


def _candidates(a: Forest, b: Forest, roots: list[tuple[int, int]], share: float) -> Iterator[tuple[int, int]]:
    """Inner nodes of one kind, best score first, then by position (see :func:`trees.ancestor_candidates`).

    What the subtrees below a node have in common with each node of the other side is handed up, so no pair of ancestors is met once a root.
    In deep trees the pairs may be as many as the square of the nodes; each takes 16 bytes."""
    shared, worst, of_a, of_b = {}, array("d"), array("i"), array("i")
    for p, q in roots:
        if (up := a.parent[p]) >= 0:
            own = shared.setdefault(up, defaultdict(int))
            for j in b.above(q):
                own[j] += a.size[p]
    for i in range(len(a) - 1, -1, -1):
        if (own := shared.pop(i, None)) is None:
            continue
        for j, common in own.items():
            score = common * 2.0 / (a.size[i] + b.size[j] - 2)
            if a.kind[i] == b.kind[j] >= 0 and score >= share:
                worst.append(-score)
                of_a.append(i)
                of_b.append(j)
        if (up := a.parent[i]) >= 0:
            if up not in shared:
                shared[up] = own
            else:
                for j, common in own.items():
                    shared[up][j] += common
    for k in np.lexsort((of_b, of_a, worst)) if worst else ():
        yield of_a[k], of_b[k]


def _matched(a: Forest, b: Forest, least: int, share: float) -> tuple[list[int], list[int]]:
    """The partner of each node on the other side, or -1 (see :func:`trees.tree_matches`)."""
    pair, back = [-1] * len(a), [-1] * len(b)
    newest = []

    def meet(i: int, j: int) -> None:
        pair[i], back[j] = j, i
        newest.append((i, j))

    for i, j in _candidates(a, b, _equal_subtrees(a, b, pair, back, least), share):
        if pair[i] < 0 and back[j] < 0:
            meet(i, j)
    tops = {(b.place[j], b.kind[j]): j for j in range(len(b)) if b.parent[j] == NONE and back[j] < 0}
    for i in range(len(a)):
        if a.parent[i] == NONE and pair[i] < 0 and a.kind[i] >= 0 and (a.place[i], a.kind[i]) in tops:
            meet(i, tops[a.place[i], a.kind[i]])
    while newest:
        p, q = newest.pop()
        waiting = defaultdict(list)
        for j in reversed(b.kids[q]):
            if back[j] < 0:
                waiting[b.kind[j]].append(j)
        for i in a.kids[p]:
            if pair[i] < 0 and a.kind[i] >= 0 and waiting.get(a.kind[i]):
                meet(i, waiting[a.kind[i]].pop())
    return pair, back


def difference(a: Forest, b: Forest, least: int, share: float) -> Iterator[tuple[int, int, bool]]:
    """(action, position, root) of what :func:`trees.tree_difference` gives for one tree; deletes and updates name positions of
    ``a``, inserts and moves those of ``b``."""
    pair, back = _matched(a, b, least, share)
    for own, met, action in ((a, pair, DELETE), (b, back, INSERT)):
        for i, (other, up) in enumerate(zip(met, own.parent)):
            if other < 0:
                yield action, i, up < 0 or met[up] >= 0
    order = defaultdict(list)
    for i, j in enumerate(pair):
        if j >= 0:
            if a.label[i] != b.label[j]:
                yield UPDATE, i, True
            p, q = a.parent[i], b.parent[j]
            if q == NONE if p == NONE else p >= 0 and pair[p] == q >= 0:
                order[p].append((a.place[i], b.place[j], j))
            else:
                yield MOVE, j, True
    for rows in order.values():
        rows.sort()
        ranks = [x[1] for x in rows]
        if any(x > y for x, y in zip(ranks, ranks[1:])):
            for kept, (_, _, j) in zip(kept_order(ranks), rows):
                if not kept:
                    yield MOVE, j, True
