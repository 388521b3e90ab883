"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings.

A candidate is a run of token characters. For each character class (hex digits, base64 characters) a window
slides over the candidate's stretches of that class; counts change by one character in and one out, and with
them the sum of ``c * log2(c)`` that the entropy needs. Windows above the class's bound are joined into spans.
An allow-list drops candidates that are no secrets. Of a span, what a fixed pattern has found already is left out
and the rest stays, unless the list drops it too or it lacks the letters and digits that a span must have.

Defined results: a null text is empty and has no span; repeated rows are rows of their own; a null id is
carried; an empty table gives no rows; other columns are ignored. Positions are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codewarden.llm.text import map_rows

# The patterns of the contract, with the least length of what is captured.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
)
#: Kind, its characters, window, and least bits per character (random text of the class has about 3.5 and 4.4 in such windows).
CLASSES = (
    ("entropy_hex", re.compile(r"[0-9a-fA-F]+"), 24, 3.0),
    ("entropy_base64", re.compile(r"[A-Za-z0-9+/_=-]+"), 24, 3.9),
)
KINDS = [k for k, *_ in BASE] + [k for k, *_ in CLASSES]
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{24,}")
#: Candidates that are no secrets: words and paths of letters, numbers, repeats of a short unit, UUIDs, dotted names.
ALLOW = tuple(
    re.compile(p)
    for p in (
        r"[A-Za-z+/_.=-]+",
        r"[0-9+/_.=-]+",
        r"(.{1,8})\1{2,}.{0,8}",
        r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}",
        r"(?:[A-Za-z]+[0-9]{0,4}[./_-])+[A-Za-z]+[0-9]{0,4}",
    )
)
_CLOG = [0.0] + [c * math.log2(c) for c in range(1, 65)]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    return [(kind, m.start(), m.end()) for kind, pattern, group, least in BASE for m in pattern.finditer(text) if len(m[group]) >= least]


def windows(text: str, start: int, end: int, width: int, bits: float) -> list[tuple[int, int]]:
    """Joined windows of ``text[start:end]`` whose entropy is at least ``bits`` per character."""
    if end - start < width:
        return []
    counts: dict[str, int] = {}
    total = 0.0
    out: list[tuple[int, int]] = []
    most = width * (math.log2(width) - bits)  # entropy >= bits: sum of c * log2(c) <= most
    for i in range(start, end):
        c = counts.get(text[i], 0)
        counts[text[i]] = c + 1
        total += _CLOG[c + 1] - _CLOG[c]
        if i - start >= width:
            c = counts[text[i - width]]
            counts[text[i - width]] = c - 1
            total += _CLOG[c - 1] - _CLOG[c]
        if i - start >= width - 1 and total <= most + 1e-9:
            lo = i - width + 1
            if out and lo <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((lo, i + 1))
    return out


def _mixed(text: str) -> bool:
    return any(c.isdigit() for c in text) and any(c.isalpha() for c in text)


def _union(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans joined where they overlap or touch, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _rest(lo: int, hi: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What ``taken`` (in order, apart from each other) leaves of a span; only spans that meet it are looked at."""
    out, i = [], max(0, bisect_right(taken, (lo, math.inf)) - 1)
    while i < len(taken) and taken[i][0] < hi:
        a, b = taken[i]
        if a > lo:
            out.append((lo, a))
        lo, i = max(lo, b), i + 1
    return out + [(lo, hi)] if lo < hi else out


def entropy_spans(text: str, known: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    out: list[tuple[str, int, int]] = []
    before = _union([(a, b) for _, a, b in known])
    for m in CANDIDATE.finditer(text):
        if any(p.fullmatch(m[0]) for p in ALLOW):
            continue
        fresh: list[tuple[int, int]] = []  # spans of this candidate by the classes so far
        for kind, characters, width, bits in CLASSES:
            mine: list[tuple[int, int]] = []
            for run in characters.finditer(text, m.start(), m.end()):
                for lo, hi in windows(text, run.start(), run.end(), width, bits):
                    inner = text[lo:hi]
                    if not _mixed(inner):
                        continue
                    rest = [left for part in _rest(lo, hi, before) for left in _rest(*part, fresh)]
                    if rest != [(lo, hi)]:  # what stands beside a known span may be its name
                        rest = [(a, b) for a, b in rest if not any(p.fullmatch(text[a:b].strip("+/_.=-")) for p in ALLOW) and _mixed(text[a:b])]
                    mine += rest
            out += [(kind, a, b) for a, b in mine]
            fresh = _union(fresh + mine)
    return out


def spans(text: str) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) by start, then kind as listed."""
    base = base_spans(text)
    return _ordered(base + entropy_spans(text, base))


def _ordered(found):
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _joined(found) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy."""

    def rows(it):
        for doc_id, text in it:
            base = base_spans(text or "")
            more = entropy_spans(text or "", base)
            counts = [sum(k == kind for k, _, _ in base) for kind, *_ in BASE]
            yield doc_id, *counts, hashlib.sha256(_joined(_ordered(base)).encode()).hexdigest(), _joined(_ordered(base + more)), len(more)

    own = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    return map_rows(own, rows, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long")


def redacted(docs: DataFrame, mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; overlapping spans are one."""

    @F.pandas_udf("string")
    def clean(texts):
        def one(text):
            if text is None:
                return None
            out, at = [], 0
            for _, lo, hi in spans(text):
                if hi <= at:
                    continue
                if lo >= at:
                    out += [text[at:lo], mark]
                at = hi
            return "".join(out) + text[at:] if out else text

        return texts.map(one)

    return docs.withColumn(text_col, clean(F.col(text_col)))
