"""Names for helper columns that clash with none of a table's own."""

from __future__ import annotations

from collections.abc import Iterable


def unused(taken: Iterable[str], *names: str) -> list[str]:
    """``names``, each with underscores appended until no column in ``taken`` (in any case) has it."""
    held = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out
