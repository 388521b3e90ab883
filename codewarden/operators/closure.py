"""What untrusted input reaches inside one file: two small Arrow-batched helpers with hash sets.

A file is one row. Membership in a growing set is the one thing that array functions only do by scanning, so
the two walks below run in Python, on files where a source occurs; what counts as a source, a use or an edge is
decided by columns before, and what follows from a reached name by columns after.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from codewarden.functions.batches import by_row

# Node that is reached from the start.
ROOT = "*"


def _or_empty(value: Column) -> Column:
    return F.coalesce(value, F.array().cast("array<string>"))


def forward(definitions: Iterable[Sequence]) -> list[str]:
    """Names reached by (source, names, uses) in their order: a definition only sees what was reached before it."""
    seen: dict[str, None] = {}
    for source, names, uses in definitions:
        if source or not seen.keys().isdisjoint(uses):
            seen.update(dict.fromkeys(names))
    return list(seen)


def reached(edges: Iterable[Sequence]) -> list[str]:
    """Everything that (starts, end) edges lead to from ROOT, in whatever order they stand; each is followed once."""
    targets: dict[str, list[str]] = {}
    for starts, end in edges:
        for start in starts:
            targets.setdefault(start, []).append(end)
    found, waiting = {ROOT: None}, [ROOT]
    while waiting:
        for name in targets.get(waiting.pop(), ()):
            if name not in found:
                found[name] = None
                waiting.append(name)
    return list(found)


def forward_names(definitions: Column) -> Column:
    """:func:`forward` over ``array<struct<src,names,uses>>``; a file without a source is not sent to Python."""

    def walk(rows):
        return None if rows is None else forward((r["src"], r["names"], r["uses"]) for r in rows)

    plain = F.transform(definitions, lambda d: F.struct(d["src"].alias("src"), d["names"].alias("names"), d["uses"].alias("uses")))
    found = by_row(walk, "array<string>", F.when(F.exists(definitions, lambda d: d["src"]), plain))
    return F.when(definitions.isNotNull(), _or_empty(found))


def reached_names(edges: Column) -> Column:
    """:func:`reached` over ``array<struct<srcs,dst>>``, ROOT among them; a file without a source is not sent to Python."""

    def walk(rows):
        return None if rows is None else reached((r["srcs"], r["dst"]) for r in rows)

    found = by_row(walk, "array<string>", F.when(F.exists(edges, lambda e: F.array_contains(e["srcs"], ROOT)), edges))
    return F.when(edges.isNotNull(), _or_empty(found))
