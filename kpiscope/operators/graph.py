"""Causal graphs of a few nodes: separation, adjustment sets, identification strategy.

Graphs come from the contract and have tens of nodes at most, so this is plain driver code.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from itertools import combinations


class GraphError(ValueError):
    """A cycle, or a node that is not in the graph."""


@dataclass(frozen=True)
class Dag:
    nodes: frozenset[str]
    edges: frozenset[tuple[str, str]]
    unobserved: frozenset[str] = frozenset()

    @classmethod
    def of(cls, edges: Iterable[tuple[str, str]], unobserved: Mapping[str, Iterable[str]] | None = None, nodes: Iterable[str] = ()) -> Dag:
        """Declared edges, and for each unobserved node those it affects."""
        every = set(edges) | {(u, v) for u, vs in (unobserved or {}).items() for v in vs}
        dag = cls(frozenset({n for e in every for n in e} | set(nodes)), frozenset(every), frozenset(unobserved or ()))
        dag.order()
        return dag

    def order(self) -> list[str]:
        """Nodes from causes to effects; a cycle raises."""
        left, out = {n: len(self.parents(n)) for n in self.nodes}, []
        while ready := sorted(n for n, k in left.items() if k == 0):
            for n in ready:
                del left[n]
                out.append(n)
                for c in self.children(n):
                    left[c] -= 1
        if left:
            raise GraphError(f"a cycle among {sorted(left)}")
        return out

    def parents(self, n: str) -> set[str]:
        return {a for a, b in self.edges if b == n}

    def children(self, n: str) -> set[str]:
        return {b for a, b in self.edges if a == n}

    def _reach(self, start: Iterable[str], step) -> set[str]:
        seen, todo = set(), list(start)
        while todo:
            for m in step(todo.pop()) - seen:
                seen.add(m)
                todo.append(m)
        return seen

    def ancestors(self, of: Iterable[str]) -> set[str]:
        return self._reach(of, self.parents)

    def descendants(self, of: Iterable[str]) -> set[str]:
        return self._reach(of, self.children)

    def without(self, outgoing_of: str | None = None, edge: tuple[str, str] | None = None) -> Dag:
        cut = {e for e in self.edges if e[0] == outgoing_of} | ({edge} if edge else set())
        return Dag(self.nodes, self.edges - cut, self.unobserved)

    def separated(self, x: str, y: str, given: Iterable[str] = ()) -> bool:
        """d-separation: no path in the moral graph of the ancestors avoids ``given``."""
        z = set(given)
        if missing := ({x, y} | z) - self.nodes:
            raise GraphError(f"unknown nodes {sorted(missing)}")
        keep = self.ancestors({x, y} | z) | {x, y} | z
        near: dict[str, set[str]] = {n: set() for n in keep}
        for n in keep:
            ps = sorted(self.parents(n) & keep)
            for p in ps:
                near[n].add(p)
                near[p].add(n)
            for a, b in combinations(ps, 2):
                near[a].add(b)
                near[b].add(a)
        return y not in self._reach([x], lambda n: near[n] - z) and x != y

    def directed_paths(self, x: str, y: str, most: int = 400) -> list[list[str]]:
        out: list[list[str]] = []
        todo = [[x]]
        while todo and len(out) < most:
            path = todo.pop()
            for c in sorted(self.children(path[-1]), reverse=True):
                if c == y:
                    out.append([*path, c])
                else:
                    todo.append([*path, c])
        return out[:most]

    def is_backdoor(self, x: str, y: str, z: Iterable[str]) -> bool:
        z = set(z)
        return not z & (self.descendants({x}) | {x, y}) and self.without(outgoing_of=x).separated(x, y, z)

    def backdoor_sets(self, x: str, y: str, observed: Iterable[str] | None = None, most: int = 4) -> list[tuple[str, ...]]:
        """Minimal adjustment sets of observed nodes, small ones first."""
        usable = sorted((set(observed) if observed is not None else self.nodes - self.unobserved) - self.descendants({x}) - {x, y})
        out: list[tuple[str, ...]] = []
        for size in range(most + 1):
            for z in combinations(usable, size):
                if not any(set(s) <= set(z) for s in out) and self.is_backdoor(x, y, z):
                    out.append(z)
        return out

    def frontdoor_sets(self, x: str, y: str, observed: Iterable[str] | None = None, most: int = 2) -> list[tuple[str, ...]]:
        """Observed mediators that carry all of the effect and are themselves unconfounded."""
        usable = sorted(((set(observed) if observed is not None else self.nodes - self.unobserved) & self.descendants({x}) & self.ancestors({y})) - {x, y})
        paths = self.directed_paths(x, y)
        out: list[tuple[str, ...]] = []
        for size in range(1, most + 1):
            for m in combinations(usable, size):
                if any(set(s) <= set(m) for s in out) or not paths:
                    continue
                if all(set(m) & set(p) for p in paths) and all(self.is_backdoor(x, v, ()) for v in m) and all(self.is_backdoor(v, y, {x} | (set(m) - {v})) for v in m):
                    out.append(m)
        return out

    def instruments(self, x: str, y: str, observed: Iterable[str] | None = None) -> list[str]:
        """Observed nodes tied to x and, with x's effect on y cut, apart from y."""
        usable = sorted((set(observed) if observed is not None else self.nodes - self.unobserved) - {x, y} - self.descendants({x}))
        cut = self.without(outgoing_of=x)
        return [v for v in usable if not self.separated(v, x) and cut.separated(v, y)]

    def strategy(self, x: str, y: str, observed: Iterable[str] | None = None) -> dict[str, object]:
        """BACKDOOR before FRONTDOOR before IV before NONE; the smallest set, then by name."""
        if sets := self.backdoor_sets(x, y, observed):
            return {"strategy": "BACKDOOR", "set": list(min(sets, key=lambda s: (len(s), s))), "needs": []}
        if sets := self.frontdoor_sets(x, y, observed):
            return {"strategy": "FRONTDOOR", "set": list(min(sets, key=lambda s: (len(s), s))), "needs": []}
        if found := self.instruments(x, y, observed):
            return {"strategy": "IV", "set": [found[0]], "needs": []}
        needs = [u for u in sorted(self.unobserved) if x in self.descendants({u}) and y in self.without(outgoing_of=x).descendants({u})]
        return {"strategy": "NONE", "set": [], "needs": needs}
