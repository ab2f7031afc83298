"""Column names that cannot clash with a caller's columns."""

from __future__ import annotations

import itertools

_N = itertools.count()


def fresh(stem: str, *taken: object) -> str:
    """A column name that none of the frames or name lists in ``taken`` has (case ignored)."""
    have = {c.lower() for t in taken for c in (t.columns if hasattr(t, "columns") else t)}
    name = f"__{stem}"
    while name.lower() in have:
        name = f"__{stem}_{next(_N)}"
    return name


def merge_columns(left: list[str], right: list[str], suffix: str) -> dict[str, str]:
    """Right column -> its name beside the left ones: a clash gets ``suffix`` until it is free."""
    have = {c.lower() for c in left}
    out = {}
    for c in right:
        name = c
        while name.lower() in have:
            name += suffix
        have.add(name.lower())
        out[c] = name
    return out
