"""Many names found in a text in one pass: a trie of the names with failure links.

An alternation of names tries each of them at each place; here a text costs its length and what is found in it, however many names
there are.  Names are given as a table (name, value) and become nodes of a trie; a node's failure link leads to
the longest other beginning of a name that what was read ends with.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Automaton:
    """Finds names in strings that were brought to the form of the names."""

    def __init__(self, names: dict[str, str]):
        self.values = {n: v for n, v in names.items() if n}
        self.edges: list[dict[str, int]] = [{}]
        self.ends: list[str | None] = [None]
        for name in self.values:
            at = 0
            for ch in name:
                if ch not in self.edges[at]:
                    self.edges[at][ch] = len(self.edges)
                    self.edges.append({})
                    self.ends.append(None)
                at = self.edges[at][ch]
            self.ends[at] = name
        self.fail = [0] * len(self.edges)
        #: the nearest node, itself or by failure links, where a name ends (0: none)
        self.found = [k if self.ends[k] is not None else 0 for k in range(len(self.edges))]
        waiting = deque(self.edges[0].values())
        while waiting:
            at = waiting.popleft()
            for ch, to in self.edges[at].items():
                back = self.fail[at]
                while back and ch not in self.edges[back]:
                    back = self.fail[back]
                self.fail[to] = self.edges[back].get(ch, 0)
                if not self.found[to]:
                    self.found[to] = self.found[self.fail[to]]
                waiting.append(to)

    def all(self, text: str) -> Iterator[tuple[int, int, str]]:
        """(start, end, name) of every occurrence, by end and then longest first."""
        at = 0
        for k, ch in enumerate(text):
            while at and ch not in self.edges[at]:
                at = self.fail[at]
            at = self.edges[at].get(ch, 0)
            hit = self.found[at]
            while hit:
                name = self.ends[hit]
                yield k + 1 - len(name), k + 1, name
                hit = self.found[self.fail[hit]]

    def longest(self, text: str, accept: Callable[[int, int], bool] = lambda s, e: True) -> list[tuple[int, int, str]]:
        """Occurrences that do not overlap: from the left, at each place the longest one that is accepted."""
        best: dict[int, tuple[int, str]] = {}
        for s, e, name in self.all(text):
            if (s not in best or e > best[s][0]) and accept(s, e):
                best[s] = (e, name)
        out, end = [], 0
        for s in sorted(best):
            if s >= end:
                out.append((s, *best[s]))
                end = best[s][0]
        return out


def names_in(text: Column | str, names: dict[str, str]) -> Column:
    """array<struct<start,end,name,value>>: whole words that are names, in any case; from the left, the longest first."""
    found = Automaton({n.lower(): v for n, v in names.items()})

    def of(s: str) -> list[dict]:
        low = s.lower() if len(s.lower()) == len(s) else "".join(c.lower() if len(c.lower()) == 1 else c for c in s)
        word = lambda k: 0 <= k < len(low) and (low[k].isalnum() or low[k] == "_")
        whole = lambda a, b: not (word(a - 1) and word(a)) and not (word(b - 1) and word(b))
        return [{"start": a, "end": b, "name": n, "value": found.values[n]} for a, b, n in found.longest(low, whole)]

    @F.pandas_udf("array<struct<start:int,end:int,name:string,value:string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: of(x) if x else [])

    return run(text)
