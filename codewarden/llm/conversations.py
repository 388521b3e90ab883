"""Repair of conversations by their cheapest edits.

A repaired conversation is empty, or turns of user and assistant in alternation that end with the assistant, after
at most one system turn. Rows are kept, given another role or deleted, and empty turns are inserted; of the cheapest
edits the ones whose audit (their initials, in order) is least in ASCII are taken.

The dynamic program has four states (nothing yet, after system, after user, after assistant). Each state's best
edits are a linked node whose prefix is shared with all that came from it: a node holds the piece of audit that its
row adds, a rolling hash of the whole audit so far, and its ancestors at the powers of two. Equally cheap edits are
compared by lifting both nodes to where their audits first differ; an equal hash of unlike nodes is verified on the
pieces. A piece is the insertions before a row and the row's own letter, so audits of one row number are never
prefixes of each other, and within a state the least audit so far stays the least.

Rows are range-partitioned by conversation and turn. A conversation inside one partition is repaired where it lies.
One that a partition's edge cuts, or with more than ``BLOCK`` rows, goes by blocks: a block's costs and audits from
each state to each are found side by side, one row per block is combined in order (nodes again, with a block's
audit as their piece), and the blocks' texts are written from the states found. No task holds more rows than a
block, however long a conversation is; its audit is one value, as asked for, and its checksum reads its texts once,
in order, as a stream.

Defined results: a null role or text is one space, which is no role that may stay; an empty role has no initial and
may not stay either; a null conversation is one of its own; null turns come first; rows of one turn are in order of
role and text (by their first 64 characters, then by a digest); repeated rows are duplicates; conversations whose
rows are all dropped have zeros and an empty audit; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from itertools import groupby
from typing import NamedTuple

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codewarden.llm.text import map_rows
from codewarden.session import cut_lineage

BLOCK = 4096
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
_ROLES = {USER: "user", ASSISTANT: "assistant"}
_AFTER = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # the role that comes next
_STATE_OF = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_LEGAL = {"su", "ua", "au"}
_BLANK = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
_PRIME, _BASE = (1 << 61) - 1, 0x1F35_7AC9_0B53_D1E7


class Node:
    """The edits so far: the last piece, and by sharing all pieces before it."""

    __slots__ = ("hash", "jumps", "piece")

    def __init__(self, before: Node | None, piece: str):
        self.piece = piece
        self.jumps: list[Node] = []  # the ancestors 1, 2, 4, ... pieces back
        self.hash = 0
        if before is not None:
            self.hash = (before.hash * _BASE + _symbol(piece)) % _PRIME
            jumps, k = [before], 0
            while k < len(jumps[k].jumps):
                jumps.append(jumps[k].jumps[k])
                k += 1
            self.jumps = jumps  # as many for every node of one depth

    def pieces(self) -> list[str]:
        out, node = [], self
        while node.jumps:
            out.append(node.piece)
            node = node.jumps[0]
        return out[::-1]


def _symbol(piece: str) -> int:
    if len(piece) < 7:
        return int.from_bytes(piece.encode(), "big") + 1
    return int.from_bytes(hashlib.blake2b(piece.encode(), digest_size=8).digest(), "big")


def same(a: Node, b: Node) -> bool:
    """Whether two nodes of one depth stand for the same pieces, read back to where they are one node."""
    while a is not b:
        if a.piece != b.piece:
            return False
        a, b = a.jumps[0], b.jumps[0]
    return True


def precedes(a: Node, b: Node) -> bool:
    """Whether a's audit comes before b's; both have as many pieces."""
    if a is b:
        return False
    if a.hash == b.hash:
        return not same(a, b) and "".join(a.pieces()) < "".join(b.pieces())
    x, y = a, b
    for k in range(len(x.jumps) - 1, -1, -1):  # the longest common prefix ends before the first unlike hash
        if k < min(len(x.jumps), len(y.jumps)) and x.jumps[k].hash != y.jumps[k].hash:
            x, y = x.jumps[k], y.jumps[k]
    if not same(x.jumps[0], y.jumps[0]):
        return "".join(a.pieces()) < "".join(b.pieces())
    return x.piece < y.piece


def _inserted(state: int) -> list[tuple[int, int, str]]:
    """(state, cost, letters) after 0, 1 or 2 insertions; more lead to no other state."""
    out = [(state, 0, "")]
    for _ in range(2):
        state, cost, letters = out[-1]
        out.append((_AFTER[state], cost + INSERT, letters + "I"))
    return out


def _steps(fits: int | None, fault: str | None) -> list[list[tuple[int, int, str]]]:
    """Per state after a row: (state before, cost, piece), the best for each state before."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    extra = TRUNCATED if fault == "truncated" else 0
    for before in range(4):
        for state, cost, letters in _inserted(before):
            options = [(state, cost + DELETE, letters + "D")]
            if fault not in ("blank", "duplicate"):
                if fits == _AFTER[state] or (fits == SYSTEM and state == NOTHING):
                    options.append((fits, cost + extra, letters + "K"))
                options.append((_AFTER[state], cost + REROLE + extra, letters + "R"))
            for after, total, piece in options:
                best[after, before] = min((total, piece), best.get((after, before), (total, piece)))
    return [[(before, *best[after, before]) for before in range(4) if (after, before) in best] for after in range(4)]


_STEPS = {(fits, fault): _steps(fits, fault) for fits in (None, SYSTEM, USER, ASSISTANT) for fault in (None, "blank", "duplicate", "truncated")}
#: After the last row: (state before, cost, piece) that end in a whole conversation.
_END = [(state, cost, letters) for state in range(4) for after, cost, letters in _inserted(state) if after in (NOTHING, ASSISTANT)]

Best = list[tuple[int, Node] | None]  # cost and edits by state


def _least(now: Best, options: Iterable[tuple[int, int, str]]) -> tuple[int, Node] | None:
    """The cheapest way by (state before, cost, piece), the least audit of equally cheap ones."""
    cost, ways = None, []
    for before, price, piece in options:
        if now[before] is not None:
            total = now[before][0] + price
            if cost is None or total < cost:
                cost, ways = total, []
            if total == cost:
                ways.append((now[before][1], piece))
    if not ways:
        return None
    best = Node(*ways[0])
    for way in ways[1:]:
        other = Node(*way)
        if precedes(other, best):
            best = other
    return cost, best


def _through(rows: list[tuple[int | None, str | None]], start: int, root: Node) -> Best:
    now: Best = [None] * 4
    now[start] = (0, root)
    for row in rows:
        now = [_least(now, options) for options in _STEPS[row]]
    return now


def cheapest(rows: list[tuple[int | None, str | None]]) -> tuple[int, str]:
    """Cost and audit of rows (state that the role leads to, first fault)."""
    cost, node = _least(_through(rows, NOTHING, Node(None, "")), _END)
    return cost, "".join(node.pieces())


class Tally:
    """Counts over rows in order; two tallies of neighbours add up."""

    FIELDS = ("n", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "first_turn", "last_turn", "first_role", "last_role")

    def __init__(self, values: Iterable | None = None):
        for name, value in zip(self.FIELDS, values or [0] * 6 + [None] * 6):
            setattr(self, name, value)

    def values(self) -> tuple:
        return tuple(getattr(self, name) for name in self.FIELDS)

    def add(self, other: Tally) -> None:
        if not other.n:
            return
        if not self.n:
            self.__init__(other.values())
            return
        joins = self.last_role + other.first_role not in _LEGAL
        again = self.last_turn is not None and self.last_turn == other.first_turn
        self.illegal += other.illegal + joins
        self.turns += other.turns - again
        for name in ("n", "blank", "duplicate", "truncated"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        self.low = other.low if self.low is None else self.low
        self.high = self.high if other.high is None else other.high
        self.last_turn, self.last_role = other.last_turn, other.last_role

    def row(self, turn: int | None, role: str, fault: str | None) -> None:
        faults = [int(fault == name) for name in ("blank", "duplicate", "truncated")]
        self.add(Tally([1, *faults, 0, int(turn is not None), turn, turn, turn, turn, role[:1], role[:1]]))

    def counts(self) -> tuple[int, int, int, int, int]:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal


def fault_of(text: str, seen: bool) -> str | None:
    """The first fault of a row; ``seen``: its role and text were there before."""
    rest = text.rstrip(_BLANK)
    return "blank" if not rest else "duplicate" if seen else "truncated" if rest[-1] not in ".!?" else None


def _turns(rows: list[tuple[str, str]], audit: str, state: int) -> Iterable[tuple[str, str]]:
    """Roles and texts that the audit makes of rows, from a state on."""
    left = iter(rows)
    for letter in audit:
        if letter == "I":
            state = _AFTER[state]
            yield _ROLES[state], ""
            continue
        role, text = next(left)
        if letter == "K":
            state = _STATE_OF[role[0]]
            yield role, text
        elif letter == "R":
            state = _AFTER[state]
            yield _ROLES[state], text


def _written(rows, audit: str, state: int) -> str:
    return "\n".join(f"{role}:{text}" for role, text in _turns(rows, audit, state))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped: rows as a checksum of their place damages them; dropped rows stay as marks."""
    place = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    coded = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (F.crc32(place) % 20).alias("_code"))
    code = F.col("_code")
    return coded.select(
        "conv_id", "turn", F.when(code == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(code <= 1, "").when(code == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (code == 0).alias("dropped"), F.explode(F.when(code == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


class Repaired(NamedTuple):
    """``whole``: conv_id, counts, cost, audit and the repaired text; ``long``: the same without the text, which is in
    ``parts`` (conv_id, chunk, repaired) in order of the chunks; a chunk without turns has an empty text."""

    whole: DataFrame
    long: DataFrame
    parts: DataFrame


_COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def repair(rows: DataFrame, block: int = BLOCK) -> Repaired:
    """Repairs ``rows(conv_id, turn, role, text, dropped)``; dropped rows only name their conversation."""
    kind = dict(rows.dtypes)["conv_id"]
    keys = ["conv_id", "turn", F.substring("role", 1, 64), F.substring("text", 1, 64), F.md5(F.concat_ws("\0", "role", "text")), "_salt"]
    own = rows.select("conv_id", "turn", "role", "text", "dropped").withColumn("_salt", F.monotonically_increasing_id())
    ranged = own.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_salt")

    def finished(conv_id, held):
        tally, seen, marks, texts = Tally(), set(), [], []
        for _, turn, role, text, dropped in held:
            if not dropped:
                fault = fault_of(text, (role, text) in seen)
                seen.add((role, text))
                tally.row(turn, role, fault)
                marks.append((_STATE_OF.get(role[:1]), fault))
                texts.append((role, text))
        cost, audit = cheapest(marks)
        return conv_id, *tally.counts(), cost, audit, _written(texts, audit, NOTHING), *[None] * 6

    def first_pass(it):
        part, held, conv_id, first = TaskContext.get().partitionId(), [], None, True
        for conv_id, segment in groupby(it, key=lambda r: r[0]):
            if held:
                yield finished(held[0][0], held)
            held, begun = [], first
            first = False
            for i, row in enumerate(segment):
                held.append(row)
                if begun or i >= block:  # begins in another partition, or is long: left to the blocks
                    begun = True
                    for k, (_, turn, role, text, dropped) in enumerate(held, i + 1 - len(held)):
                        yield conv_id, *[None] * 8, part, k, turn, role, text, dropped
                    held = []
        for k, (_, turn, role, text, dropped) in enumerate(held):  # may go on in another partition
            yield conv_id, *[None] * 8, part, k, turn, role, text, dropped

    ddl = f"conv_id {kind}, {_COUNTS}, repaired string, part int, at long, turn long, role string, text string, dropped boolean"
    stored = cut_lineage(map_rows(ranged, first_pass, ddl))
    whole = stored.where("part IS NULL").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired")
    left = stored.where("part IS NOT NULL").select("conv_id", "part", "at", "turn", "role", "text", "dropped")
    return Repaired(whole, *_by_blocks(left, kind, block))


def _by_blocks(left: DataFrame, kind: str, block: int) -> tuple[DataFrame, DataFrame]:
    """Conversations whose rows lie in several places (part, at), in that order."""
    digest = F.md5(F.concat_ws("\0", "role", "text"))
    firsts = left.where("NOT dropped").groupBy("conv_id", digest.alias("_key")).agg(F.min(F.struct("part", "at")).alias("_first"))
    firsts = firsts.select(F.col("conv_id").alias("_conv"), "_first.*").withColumnsRenamed({"part": "_part", "at": "_at"})
    met = left["conv_id"].eqNullSafe(firsts["_conv"]) & (left["part"] == firsts["_part"]) & (left["at"] == firsts["_at"])
    marked = left.join(firsts, met, "left").select(*left.columns, F.col("_part").isNull().alias("seen"), F.floor(F.col("at") / block).alias("block"))
    marked = cut_lineage(marked)
    place = ["conv_id", "part", "block"]

    def block_rows(it):
        for (conv_id, part, number), rows in groupby(it, key=lambda r: r[:3]):
            tally, marks = Tally(), []
            for _, _, _, _, turn, role, text, dropped, seen in rows:
                if not dropped:
                    fault = fault_of(text, seen)
                    tally.row(turn, role, fault)
                    marks.append((_STATE_OF.get(role[:1]), fault))
            ways = [_through(marks, start, Node(None, "")) for start in range(4)]
            costs = [None if way is None else way[0] for now in ways for way in now]
            audits = [None if way is None else "".join(way[1].pieces()) for now in ways for way in now]
            yield conv_id, part, number, tally.values(), costs, audits

    fields = ", ".join(f"{name}: {'string' if 'role' in name else 'long'}" for name in Tally.FIELDS)
    placed = marked.select(*place, "at", "turn", "role", "text", "dropped", "seen").repartition(*place).sortWithinPartitions(*place, "at")
    blocks = cut_lineage(map_rows(placed, block_rows, f"conv_id {kind}, part int, block long, tally struct<{fields}>, costs array<long>, audits array<string>"))

    def combine(it):
        for conv_id, rows in groupby(it, key=lambda r: r[0]):
            now: Best = [None] * 4
            now[NOTHING] = (0, Node(None, ""))
            tally, numbers = Tally(), []
            for _, part, number, counts, costs, audits in rows:
                tally.add(Tally(counts.values()))
                numbers.append((part, number))
                # The state after a block is added to its piece: it follows from the audit and the rows.
                now = [_least(now, [(b, costs[4 * b + a], f"{audits[4 * b + a]}{a}") for b in range(4) if costs[4 * b + a] is not None]) for a in range(4)]
            cost, node = _least(now, _END)
            *pieces, last = node.pieces()
            ends = [""] * (len(pieces) - 1) + [last]
            for (part, number), piece, end, before in zip(numbers, pieces, ends, [f"{NOTHING}", *pieces]):
                yield conv_id, *[None] * 7, part, number, piece[:-1] + end, int(before[-1])
            yield conv_id, *tally.counts(), cost, "".join(piece[:-1] for piece in pieces) + last, None, None, None, None

    ordered = blocks.repartition("conv_id").sortWithinPartitions(*place)
    found = cut_lineage(map_rows(ordered, combine, f"conv_id {kind}, {_COUNTS}, part int, block long, piece string, state int"))
    long = found.where("part IS NULL").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    def write(it):
        for (conv_id, part, number), rows in groupby(it, key=lambda r: r[:3]):
            head = next(rows)
            yield conv_id, part, number, _written([r[4:6] for r in rows], head[6], head[7])

    none = lambda t: F.lit(None).cast(t)
    heads = found.where("part IS NOT NULL").select(*place, F.lit(-1).cast("long").alias("at"), none("string").alias("role"), none("string").alias("text"), "piece", "state")
    turns = marked.where("NOT dropped").select(*place, "at", "role", "text", none("string").alias("piece"), none("int").alias("state"))
    both = heads.unionByName(turns).repartition(*place).sortWithinPartitions(*place, "at")
    parts = map_rows(both, write, f"conv_id {kind}, part int, block long, repaired string")
    return long, parts.select("conv_id", (F.shiftleft(F.col("part").cast("long"), 31) + F.col("block")).alias("chunk"), "repaired")


def digest(found: Repaired) -> DataFrame:
    """conv_id, counts, cost, audit and repaired_sha256, one row per conversation.

    The checksum of a conversation in parts reads them in order, as a stream: it is one chain over its bytes.
    """
    kind = dict(found.parts.dtypes)["conv_id"]

    def chain(it):
        for conv_id, rows in groupby(it, key=lambda r: r[0]):
            total, begun = hashlib.sha256(), False
            for _, _, text in rows:
                if text:
                    total.update((b"\n" if begun else b"") + text.encode("utf-8", "surrogatepass"))
                    begun = True
            yield conv_id, total.hexdigest()

    ordered = found.parts.repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    sums = map_rows(ordered, chain, f"_conv {kind}, repaired_sha256 string")
    long = found.long.join(sums, found.long["conv_id"].eqNullSafe(sums["_conv"]), "left").drop("_conv")
    return found.whole.withColumn("repaired_sha256", F.sha2("repaired", 256)).drop("repaired").unionByName(long)
