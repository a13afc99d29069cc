"""Probabilistic automata by merging statistically compatible states of a prefix tree."""

from __future__ import annotations

import math
from collections.abc import Iterable

#: Probability of a symbol that a state has never seen.
UNSEEN = 1e-4


class Automaton:
    """Learned from strings; log_likelihood scores a string per symbol (its end counts as one)."""

    def __init__(self, strings: Iterable[str], alpha: float = 0.05):
        self.next: list[dict[str, int]] = [{}]
        self.seen: list[dict[str, int]] = [{}]
        self.ends, self.visits = [0], [0]
        for s in sorted(strings):
            self._insert(s)
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_states()

    def _insert(self, s: str) -> None:
        at = 0
        self.visits[0] += 1
        for c in s:
            self.seen[at][c] = self.seen[at].get(c, 0) + 1
            if c not in self.next[at]:
                self.next[at][c] = len(self.next)
                self.next.append({})
                self.seen.append({})
                self.ends.append(0)
                self.visits.append(0)
            at = self.next[at][c]
            self.visits[at] += 1
        self.ends[at] += 1

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        """Hoeffding's bound on two shares."""
        return abs(f1 / n1 - f2 / n2) > self.bound * (n1**-0.5 + n2**-0.5)

    def _compatible(self, p: int, q: int) -> bool:
        todo = [(p, q)]
        while todo:
            a, b = todo.pop()
            na, nb = self.visits[a], self.visits[b]
            if not na or not nb:
                continue
            if self._differ(self.ends[a], na, self.ends[b], nb):
                return False
            for c in self.seen[a].keys() | self.seen[b].keys():
                if self._differ(self.seen[a].get(c, 0), na, self.seen[b].get(c, 0), nb):
                    return False
            todo += [(self.next[a][c], t) for c, t in self.next[b].items() if c in self.next[a]]
        return True

    def _fold(self, p: int, q: int) -> None:
        """Adds the tree below q to p."""
        todo = [(p, q)]
        while todo:
            a, b = todo.pop()
            self.visits[a] += self.visits[b]
            self.ends[a] += self.ends[b]
            for c, t in self.next[b].items():
                self.seen[a][c] = self.seen[a].get(c, 0) + self.seen[b][c]
                if c in self.next[a]:
                    todo.append((self.next[a][c], t))
                else:
                    self.next[a][c] = t

    def _merge_states(self) -> None:
        red = [0]
        while True:
            own = set(red)
            blue = [(p, c, t) for p in red for c, t in sorted(self.next[p].items()) if t not in own]
            if not blue:
                return
            p, c, t = max(blue, key=lambda x: self.visits[x[2]])  # the best known first
            for r in red:
                if self._compatible(r, t):
                    self.next[p][c] = r
                    self._fold(r, t)
                    break
            else:
                red.append(t)

    def log_likelihood(self, s: str) -> float:
        at, total = 0, 0.0
        for c in s:
            n = self.visits[at] if at >= 0 else 0
            share = self.seen[at].get(c, 0) / n if n else 0.0
            total += math.log(max(share, UNSEEN))
            at = self.next[at].get(c, -1) if at >= 0 else -1
        last = self.ends[at] / self.visits[at] if at >= 0 and self.visits[at] else 0.0
        return (total + math.log(max(last, UNSEEN))) / (len(s) + 1)
