"""A pattern rule: what to look for and what to say about it."""

from __future__ import annotations

from dataclasses import dataclass

from codewarden.functions.matching import java_regex, starting


@dataclass(frozen=True)
class Rule:
    """One detection.

    ``anchors`` lists groups of literals; a text in which some group has no occurrence cannot
    match, so the pattern is not run on it. ``starts`` are character classes of the first characters
    of every match (none: any); where case is ignored, both cases of letters, and the others that match them. A rule
    without a pattern is reported by a fact-based check and only carries its texts.
    """

    title: str
    severity: str
    fix_phase: int
    description: str
    pattern: str = ""
    ignore_case: bool = False
    anchors: tuple[tuple[str, ...], ...] = ()
    group: str = ""
    starts: str = ""

    @property
    def regex(self) -> str:
        return starting(self.starts, java_regex(self.pattern, self.ignore_case))
