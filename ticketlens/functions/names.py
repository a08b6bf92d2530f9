"""Names for helper columns that cannot meet a column of the caller."""

from __future__ import annotations

from collections.abc import Iterable


def free_names(taken: Iterable[str], *names: str) -> list[str]:
    """``names``, each with underscores in front until no column of ``taken`` is called so (in any case of letters)."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out
