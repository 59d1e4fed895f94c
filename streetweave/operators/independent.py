"""The first of the largest sets of points no two of which are near: exact, and without recursion.

A point's weight is (1, 2**-index) in the order of pairs, so the heaviest set is a largest one and, among these,
the first in the order of indices. Reductions that keep the heaviest set come first: a point whose neighbours
are all near one another is taken, or its weight is taken off theirs and it waits for what becomes of them; a
point is dropped if all of a neighbour that is no lighter is near it. Chains, trees and streets of views
vanish by these alone. What is left is swept along its longer side. A state is what the choices so far block
of the points to come, with the heaviest choice that leads there, so there are as many states as ways to block
the frontier, a strip three limits wide at most, however long the piece is. Beyond ``MANY`` states the lighter
half waits on a stack, and what can't reach the best complete choice any more is dropped: memory is bounded,
while time grows with the number of points that fit side by side in the strip."""

from __future__ import annotations

from collections.abc import Sequence

#: States swept at once, and neighbours up to which a point is looked at as one whose neighbours are all near.
MANY, FEW = 400_000, 64

Weight = tuple[int, int]


class _Graph:
    """The points that are left, with their weights; those that never changed are made at need."""

    def __init__(self, near: Sequence[set[int]]):
        self.n, self.adj, self.changed = len(near), [set(s) for s in near], {}
        self.alive = [True] * self.n
        self.todo, self.queued = list(range(self.n - 1, -1, -1)), [True] * self.n
        self.settled: list[tuple[int, tuple[int, ...]]] = []

    def weight(self, v: int) -> Weight:
        return self.changed.get(v) or (1, 1 << (self.n - 1 - v))

    def push(self, points) -> None:
        for u in points:
            if self.alive[u] and not self.queued[u]:
                self.queued[u] = True
                self.todo.append(u)

    def remove(self, v: int) -> None:
        self.alive[v] = False
        self.changed.pop(v, None)
        around = self.adj[v]
        for u in around:
            self.adj[u].discard(v)
        self.push(around)
        for u in around:
            self.push(self.adj[u])
        self.adj[v] = set()

    def reduce(self) -> None:
        while self.todo:
            v = self.todo.pop()
            self.queued[v] = False
            if self.alive[v] and not self._simplicial(v):
                self._dominated(v)

    def _simplicial(self, v: int) -> bool:
        around = self.adj[v]
        if len(around) > FEW or any(len(self.adj[u] & around) < len(around) - 1 for u in around):
            return False
        own, others = self.weight(v), tuple(around)
        heavier = {u: w for u in others if (w := self.weight(u)) > own}
        self.settled.append((v, tuple(heavier)))
        self.remove(v)
        for u in others:
            if u in heavier:
                self.changed[u] = (heavier[u][0] - own[0], heavier[u][1] - own[1])
            else:
                self.remove(u)
        return True

    def _dominated(self, v: int) -> None:
        around, own = self.adj[v], self.weight(v)
        for u in around:
            if len(self.adj[u]) <= len(around) and self.adj[u] - around == {v} and self.weight(u) >= own:
                self.remove(v)
                return

    def settle(self, chosen: set[int]) -> set[int]:
        for v, heavier in reversed(self.settled):
            if not any(u in chosen for u in heavier):
                chosen.add(v)
        return chosen

    def pieces(self) -> list[list[int]]:
        seen, out = set(), []
        for v in range(self.n):
            if self.alive[v] and v not in seen:
                seen.add(v)
                piece, stack = [], [v]
                while stack:
                    a = stack.pop()
                    piece.append(a)
                    new = self.adj[a] - seen
                    seen |= new
                    stack += new
                out.append(piece)
        return out


def _groups_after(order: list[int], adj: list[set[int]]) -> list[int]:
    """For each place, in how many groups of points near one another those from there on fall: no set has more."""
    left, group, n = set(order), {}, 0
    for v in order:
        if v in left:
            members = {v}
            for u in sorted(adj[v] & left):
                if members <= adj[u]:
                    members.add(u)
            left -= members
            group |= dict.fromkeys(members, n)
            n += 1
    seen: set[int] = set()
    out = [0]
    for v in reversed(order):
        seen.add(group[v])
        out.append(len(seen))
    return out[::-1]


def _swept(order: list[int], graph: _Graph) -> set[int]:
    """The heaviest choice among the points, in this order."""
    place = {v: k for k, v in enumerate(order)}
    blocks = [sum(1 << place[u] for u in graph.adj[v] if place[u] > k) for k, v in enumerate(order)]
    weights = [graph.weight(v) for v in order]
    most = _groups_after(order, graph.adj)
    best, choice = (-1, 0), 0
    stack: list[tuple[int, dict[int, tuple[int, int, int]]]] = [(0, {0: (0, 0, 0)})]
    while stack:
        k, states = stack.pop()
        while k < len(order):
            if len(states) > MANY:
                ranked = sorted(states.items(), key=lambda s: s[1][:2], reverse=True)
                stack.append((k, dict(ranked[MANY // 2 :])))
                states = dict(ranked[: MANY // 2])
            bit, block, (more, low) = 1 << k, blocks[k], weights[k]
            new: dict[int, tuple[int, int, int]] = {}
            for blocked, state in states.items():
                if blocked & bit:
                    blocked ^= bit
                else:
                    taken = (state[0] + more, state[1] + low, state[2] | bit)
                    old = new.get(blocked | block)
                    if old is None or old < taken:
                        new[blocked | block] = taken
                old = new.get(blocked)
                if old is None or old < state:
                    new[blocked] = state
            k += 1
            states = new if best[0] < 0 else {b: s for b, s in new.items() if s[0] + most[k] >= best[0]}
        for state in states.values():
            if state[:2] > best:
                best, choice = state[:2], state[2]
    return {v for k, v in enumerate(order) if choice >> k & 1}


def first_largest(near: Sequence[set[int]], places: Sequence[tuple[float, float]] | None = None) -> list[int]:
    """The indices of the first largest set of points no two of which are near. ``near``: for each point, those
    near it; ``places``: where the points lie, in any flat frame, to sweep along."""
    graph = _Graph(near)
    graph.reduce()
    chosen: set[int] = set()
    for piece in graph.pieces():
        if places is not None:
            sides = [max(places[v][k] for v in piece) - min(places[v][k] for v in piece) for k in (0, 1)]
            along = int(sides[1] > sides[0])
            piece.sort(key=lambda v: (places[v][along], v))
        chosen |= _swept(piece, graph)
    return sorted(graph.settle(chosen))
