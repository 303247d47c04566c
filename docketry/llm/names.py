"""Column names beside those that a table already has."""

from __future__ import annotations

from collections.abc import Iterable


def unused(columns: Iterable[str], name: str) -> str:
    """``name``, or the first of ``name_1, name_2 ...`` that no column has, whatever its case."""
    taken = {c.lower() for c in columns}
    found, n = name, 0
    while found.lower() in taken:
        n += 1
        found = f"{name}_{n}"
    return found


def refuse(columns: Iterable[str], *names: str) -> None:
    """A named error where a result column is there already."""
    taken = {c.lower() for c in columns}
    there = [n for n in names if n.lower() in taken]
    if there:
        raise ValueError(f"the table has a column {', '.join(there)} already; rename it or the result")
