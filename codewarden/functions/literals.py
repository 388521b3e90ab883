"""Literals that every match of a Python pattern must hold, and which of many occur in a text.

A pattern's parse tree says what each match holds: runs of plain characters, parts that occur at least once, and
branches of which one is taken. That gives groups of literals of which one must occur: a cheap necessary condition.
"""

from __future__ import annotations

import re
from functools import lru_cache

Group = frozenset[str]
_LEAST = 2  # shorter literals occur nearly everywhere


def _groups(items, folded: bool) -> list[Group]:
    """One of each group's literals occurs in every match of the parsed items."""
    out: list[Group] = []
    run: list[str] = []

    def flush() -> None:
        if len(run) >= _LEAST:
            out.append(frozenset(["".join(run)]))
        run.clear()

    for op, arg in items:
        name = str(op)
        if name == "LITERAL" and (not folded or (arg < 128 and chr(arg) not in "kKsSiI")):
            run.append(chr(arg).lower() if folded else chr(arg))
            continue
        flush()
        if name == "SUBPATTERN" and not arg[1] and not arg[2]:  # a part with flags of its own says nothing
            out += _groups(arg[3], folded)
        elif name == "ATOMIC_GROUP":
            out += _groups(arg, folded)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
            out += _groups(arg[2], folded)
        elif name == "BRANCH":
            best = [_best(_groups(part, folded)) for part in arg[1]]
            if all(best):
                out.append(frozenset().union(*best))
    flush()
    return out


def _best(groups: list[Group]) -> Group | None:
    """The most telling group: the longest shortest literal, then the fewest literals."""
    return max(groups, key=lambda g: (min(map(len, g)), -len(g)), default=None)


@lru_cache(maxsize=4096)
def required(pattern: str) -> tuple[Group | None, bool]:
    """(literals of which one occurs in every match, whether they are compared in lower case); None: nothing is known.

    Letters with more than two forms (k, s, i) are left out where case is ignored.
    """
    try:
        tree = re._parser.parse(pattern)  # the tree that re.compile itself reads
        folded = bool(tree.state.flags & re.IGNORECASE)
        return _best(_groups(tree, folded)), folded
    except (AttributeError, re.error, TypeError, ValueError, RecursionError):
        return None, False


class Occurring:
    """Which of many literals a text holds: one run of an Aho-Corasick automaton, or a search for each."""

    def __init__(self, literals):
        self.literals = sorted(literals)
        try:
            import ahocorasick
        except ImportError:
            self.automaton = None
            return
        self.automaton = ahocorasick.Automaton()
        for literal in self.literals:
            self.automaton.add_word(literal, literal)
        if self.literals:
            self.automaton.make_automaton()

    def of(self, text: str) -> set[str]:
        if self.automaton is None or len(self.literals) < 8:
            return {literal for literal in self.literals if literal in text}
        return {literal for _, literal in self.automaton.iter(text)}
