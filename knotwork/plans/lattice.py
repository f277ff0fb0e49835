"""In which order scopes are spread and merged; plain integers on the driver.

Each scope is a bit.  All masks that wait are spread together; then every pair of live masks is merged under
their union, the first time it occurs, if they share a node, all pairs of a round together.  Whatever a merged scope's
parents have not spread yet goes into it whole, and they are spread no more.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

MOST_SCOPES = 32


@dataclass(frozen=True)
class Merge:
    """Two masks merged under their union; `carried` are those of them that go into it whole."""

    mask: int
    a: int
    b: int
    carried: tuple[int, ...] = ()


def run(n: int, spread: Callable[[list[int]], None], share: Callable[[list[Merge]], set[int]], merge: Callable[[list[Merge], list[int]], None]) -> list[int]:
    """The masks of n scopes that were spread, in order.

    spread() gets masks to spread together.  share() gets pairs and returns the unions of those that share something.  merge()
    gets the pairs to merge, and the masks that stay live beside them."""
    if n > MOST_SCOPES:
        raise ValueError(f"at most {MOST_SCOPES} scopes")
    live = [1 << k for k in range(n)]
    seen, done, out = set(live), set(), []
    while waiting := [m for m in live if m not in done]:
        spread(waiting)
        out += waiting
        done.update(waiting)
        while True:
            pairs: list[Merge] = []
            for a in live:
                for b in live:
                    if a != b and a | b not in seen:
                        seen.add(a | b)
                        pairs.append(Merge(a | b, a, b))
            sharing, made = share(pairs) if pairs else set(), []
            for p in pairs:
                if p.mask in sharing:
                    carried = tuple(m for m in (p.a, p.b) if m not in done)
                    made.append(Merge(p.mask, p.a, p.b, carried))
                    done.update(carried)
            # what was merged comes first; what was not spread stays live behind it
            rest = [m for m in live if m not in done]
            if made:
                merge(made, rest)
            live = [m.mask for m in made] + rest
            if not made:
                break
    return out


def order(n: int) -> list[int]:
    """The masks that n scopes spread if all of them overlap."""
    return run(n, lambda masks: None, lambda pairs: {p.mask for p in pairs}, lambda made, rest: None)
