"""Names of helper columns."""

from __future__ import annotations

from collections.abc import Iterable


def spare_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, each lengthened until no taken column, compared without case, has it."""
    known = {t.lower() for t in taken}
    out = []
    for name in wanted:
        while name.lower() in known:
            name += "_"
        known.add(name.lower())
        out.append(name)
    return out
