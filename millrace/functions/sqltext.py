"""Work on SQL fragments: lists of expressions with aliases."""

from __future__ import annotations

import re

_PAIRS = {"(": ")", "[": "]"}
_ALIAS = re.compile(r"\s+as\s+([A-Za-z_]\w*|\"[^\"]+\"|`[^`]+`)\s*$", re.IGNORECASE)


def split_list(text: str) -> list[str]:
    """Cut at commas that are in no parentheses and no quotes."""
    parts, depth, quote, start = [], 0, None, 0
    for k, ch in enumerate(text):
        if quote:
            quote = None if ch == quote else quote
        elif ch in "'\"`":
            quote = ch
        elif ch in _PAIRS:
            depth += 1
        elif ch in _PAIRS.values():
            depth -= 1
        elif ch == "," and not depth:
            parts.append(text[start:k].strip())
            start = k + 1
    if quote or depth:
        raise ValueError(f"unbalanced quotes or parentheses in {text!r}")
    parts.append(text[start:].strip())
    return [p for p in parts if p]


def aliased(text: str) -> list[tuple[str, str]]:
    """(expression, alias) of each item; every item must have an alias."""
    out = []
    for item in split_list(text):
        m = _ALIAS.search(item)
        if not m:
            raise ValueError(f"an alias is needed: {item!r}")
        out.append((item[: m.start()].strip(), m.group(1).strip('"`')))
    return out
