"""A small graph of word senses: nodes (id, lemmas) and is-a edges."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Mapping


class SenseGraph:
    """``senses``: id -> (lemmas, ids of the more general senses)."""

    def __init__(self, senses: Mapping[str, tuple[Iterable[str], Iterable[str]]]):
        self.lemmas = {k: tuple(v[0]) for k, v in senses.items()}
        self.up = {k: tuple(v[1]) for k, v in senses.items()}
        self.down: dict[str, list[str]] = {k: [] for k in senses}
        for k, ups in self.up.items():
            for u in ups:
                self.down[u].append(k)

    def synsets(self, lemma: str) -> list[str]:
        return sorted(k for k, v in self.lemmas.items() if lemma.lower() in v)

    def hypernyms(self, sense: str) -> tuple[str, ...]:
        return self.up[sense]

    def hyponyms(self, sense: str) -> tuple[str, ...]:
        return tuple(self.down[sense])

    def _above(self, sense: str) -> dict[str, int]:
        """All more general senses with their distances, itself included."""
        found, todo = {sense: 0}, deque([sense])
        while todo:
            at = todo.popleft()
            for u in self.up[at]:
                if u not in found:
                    found[u] = found[at] + 1
                    todo.append(u)
        return found

    def depth(self, sense: str) -> int:
        """Nodes from the root down to the sense, the root being 1."""
        return 1 + max(self._above(sense).values())

    def path_similarity(self, a: str, b: str) -> float:
        x, y = self._above(a), self._above(b)
        shared = x.keys() & y.keys()
        return 1 / (1 + min(x[s] + y[s] for s in shared)) if shared else 0.0

    def wu_palmer(self, a: str, b: str) -> float:
        shared = self._above(a).keys() & self._above(b).keys()
        return 2 * max(map(self.depth, shared)) / (self.depth(a) + self.depth(b)) if shared else 0.0


def demo() -> SenseGraph:
    return SenseGraph({"entity": (["entity"], []), "animal": (["animal"], ["entity"]), "canine": (["canine"], ["animal"]), "dog": (["dog"], ["canine"]), "feline": (["feline"], ["animal"]), "cat": (["cat"], ["feline"])})
