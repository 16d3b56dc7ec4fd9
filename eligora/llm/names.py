"""Names for columns of an operator's own that no column of the caller's table has."""

from __future__ import annotations

from collections.abc import Iterable


def fresh(taken: Iterable[str], *stems: str) -> list[str]:
    """One name per stem, none of them in ``taken`` whatever the case."""
    known, out = {c.lower() for c in taken}, []
    for stem in stems:
        name = stem
        while name.lower() in known:
            name += "_"
        known.add(name.lower())
        out.append(name)
    return out
