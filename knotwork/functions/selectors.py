"""Many element paths matched in one pass over a page.

A path is a line of steps, `/` for a child and `//` for any descendant: `//div[@class~="body"]/p`.  A step is a tag or `*`, with
tests of attributes: `[@id]` (it is there), `[@id="x"]` (it is this) and `[@class~="x"]` (it has this word).  All paths are
compiled to one automaton: a set of steps that may match next is a state, and states and the changes between them are made
when they are first met and then remembered, so that an element costs the same however many paths there are.  What is
found is cut from the page by its bounds; nothing is copied while an element is open.

Void elements have no content and are found with an empty one; a paragraph ends where the next begins; an end tag closes what is open
within its element, and one without an element is passed over; what is open at the end is closed there.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_STEP = re.compile(r"(//?)([\w*-]+)((?:\[@[\w-]+(?:~?=\"[^\"]*\")?\])*)")
_TEST = re.compile(r"\[@([\w-]+)(?:(~?=)\"([^\"]*)\")?\]")


@dataclass(frozen=True)
class Step:
    anywhere: bool
    tag: str
    tests: tuple[tuple[str, str, str], ...]

    def accepts(self, tag: str, attrs: dict[str, str]) -> bool:
        if self.tag not in ("*", tag):
            return False
        return all(a in attrs and (op == "" or (attrs[a] == v if op == "=" else v in attrs[a].split())) for a, op, v in self.tests)


def steps(path: str) -> tuple[Step, ...]:
    out, at = [], 0
    while at < len(path):
        m = _STEP.match(path, at)
        if not m:
            raise ValueError(f"no path: {path!r} at {at}")
        out.append(Step(m[1] == "//", m[2].lower(), tuple((a, op, v) for a, op, v in _TEST.findall(m[3]))))
        at = m.end()
    if not out:
        raise ValueError("an empty path")
    return tuple(out)


@dataclass
class Found:
    attrs: dict[str, str]
    start: int
    end: int = -1
    inner: str = ""


@dataclass
class Selectors:
    """Named alternatives of paths, compiled."""

    paths: dict[str, list[str]]
    _all: list[tuple[str, tuple[Step, ...]]] = field(init=False)
    _next: dict[tuple, tuple[frozenset, tuple[str, ...]]] = field(init=False, default_factory=dict)

    def __post_init__(self) -> None:
        self._all = [(name, steps(p)) for name, ps in self.paths.items() for p in ps]
        self._names = frozenset(a for _, ss in self._all for s in ss for a, _, _ in s.tests)
        self.start = frozenset((k, 0) for k in range(len(self._all)))

    def move(self, state: frozenset, tag: str, attrs: dict[str, str]) -> tuple[frozenset, tuple[str, ...]]:
        """The state within an element, and the names of the paths that it ends."""
        key = (state, tag, tuple((a, attrs[a]) for a in sorted(self._names & attrs.keys())) if attrs else ())
        known = self._next.get(key)
        if known is None:
            after, ends = set(), []
            for k, i in state:
                name, ss = self._all[k]
                if ss[i].anywhere:
                    after.add((k, i))
                if ss[i].accepts(tag, attrs):
                    if i + 1 == len(ss):
                        ends.append(name)
                    else:
                        after.add((k, i + 1))
            if len(self._next) > 1 << 14:  # ids and the like that are all different
                self._next.clear()
            known = self._next[key] = (frozenset(after), tuple(n for n in self.paths if n in ends))
        return known

    def match(self, html: str) -> dict[str, list[Found]]:
        """What each name finds, in the order in which elements begin."""
        p = _Pass(self, html)
        p.feed(html)
        p.close()
        p.finish()
        return p.found


class _Pass(HTMLParser):
    def __init__(self, selectors: Selectors, html: str):
        super().__init__(convert_charrefs=False)
        self.selectors, self.html = selectors, html
        self.lines = [0, *(m.end() for m in re.finditer("\n", html))]
        self.open: list[tuple[str, frozenset, list[Found]]] = []
        self.counts: dict[str, int] = {}
        self.found: dict[str, list[Found]] = {n: [] for n in selectors.paths}

    def _at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _start(self, tag: str, attrs: list[tuple[str, str | None]], empty: bool) -> None:
        at = self._at()
        if tag == "p" and self.counts.get("p"):
            self._close("p", at)
        known = {k: v or "" for k, v in attrs}
        state, ends = self.selectors.move(self.open[-1][1] if self.open else self.selectors.start, tag, known)
        after = at + len(self.get_starttag_text() or "")
        made = [Found(known, after) for _ in ends]
        for name, f in zip(ends, made, strict=True):
            self.found[name].append(f)
        if empty or tag in VOID:
            for f in made:
                f.end = f.start
        else:
            self.open.append((tag, state, made))
            self.counts[tag] = self.counts.get(tag, 0) + 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._start(tag, attrs, False)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._start(tag, attrs, True)

    def _close(self, tag: str, at: int) -> None:
        while self.open:
            name, _, made = self.open.pop()
            self.counts[name] -= 1
            for f in made:
                f.end, f.inner = at, self.html[f.start : at]
            if name == tag:
                return

    def handle_endtag(self, tag: str) -> None:
        if self.counts.get(tag):
            self._close(tag, self._at())

    def finish(self) -> None:
        while self.open:
            self._close(self.open[-1][0], len(self.html))


def outermost(found: list[Found]) -> list[Found]:
    """Without what lies within another one."""
    out: list[Found] = []
    for f in found:
        if not out or f.start >= out[-1].end:
            out.append(f)
    return out


def place(found: list[Found], at: int) -> int:
    """How many of them begin at or before a place of the page."""
    return bisect_right([f.start for f in found], at)


def select_all(html: Column | str, paths: dict[str, list[str]]) -> Column:
    """struct<name: array<struct<attrs: map, inner: string>>> of all names, found in one pass over each page."""
    compiled = Selectors(paths)
    kind = ", ".join(f"`{n}` array<struct<attrs:map<string,string>,inner:string>>" for n in paths)

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            found = [compiled.match(h or "") for h in s]
            yield pd.DataFrame({n: [[{"attrs": x.attrs, "inner": x.inner} for x in f[n]] for f in found] for n in paths})

    return run(html)
