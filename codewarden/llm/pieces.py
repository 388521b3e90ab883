"""SentencePiece encoding and decoding by a max-plus parallel scan.

For a model of merges the right segmentation of a text is its one path of pieces in which every two
neighbours are stable: merging the two pieces' text by the model gives back the two pieces. In the max-plus
semiring a stable step weighs 0 and any other minus infinity. A document is split into chunks of a fixed
number of characters. A chunk's transfer matrix has a row for each piece that may lie across its start and a
column for each that may lie across its end, and holds the weight of the best path between them; matrices
combine associatively, and their product tells which piece really lies across each boundary. Every chunk is
then traced back by itself between its two boundary pieces.

The matrices of a document are small and quickly made: they are combined in halves where the document is split,
and each chunk leaves with its two states. Chunks are then spread over all tasks, whatever document they are of,
and traced; a document of one chunk is traced where it is read. Inside a chunk no piece reaches over the start of
a word, so each distinct word is encoded once per worker, by the model itself.

Defined results: a null text is empty and has no ids; characters that the model lacks become byte pieces;
repeated rows are documents of their own; a null id is carried; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codewarden.llm.text import map_rows, worker_store

CHUNK = 8192
SPACE = "▁"
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_CACHE_WORDS = 900_000
CUT = (0, 0)  # boundary state: a piece ends exactly here, and nothing is asked of what follows


class Vocabulary:
    """Pieces, scores, and which neighbours are stable."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        special = lambda i: self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) or self.model.is_unused(i)
        self.ids = {self.model.id_to_piece(i): i for i in range(n) if not special(i)}
        self.score = {p: self.model.get_score(i) for p, i in self.ids.items()}
        self.bytes = [self.model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.ids))
        self.stable: dict[tuple[str, str], bool] = {}
        self.whole = {p: True for p in self.ids if self.merged(p) == [p]}  # pieces that the merges arrive at
        self.words: dict[str, bytes] = {}
        self.text = [b""] * n
        for p, i in self.ids.items():
            self.text[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(self.bytes):
            self.text[i] = bytes([b])

    def merged(self, text: str) -> list[str]:
        """The model's merges on a short text: always the neighbours whose union has the best score, leftmost first."""
        parts, score, none = list(text), self.score.get, -np.inf
        pairs = [score(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs:
            best = max(pairs)
            if best == none:
                break
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = score(parts[at] + parts[at + 1], none)
            if at:
                pairs[at - 1] = score(parts[at - 1] + parts[at], none)
        return parts

    def is_piece(self, text: str) -> bool:
        """A single character, or a piece that the merges arrive at."""
        return len(text) == 1 or text in self.whole

    def is_stable(self, a: str, b: str) -> bool:
        known = self.stable.get((a, b))
        if known is None:
            if len(self.stable) > 600_000:
                self.stable.clear()
            known = self.stable[a, b] = self.merged(a + b) == [a, b]
        return known

    def piece_ids(self, pieces: list[str]) -> bytes:
        out: list[int] = []
        for p in pieces:
            i = self.ids.get(p)
            out += [i] if i is not None else [self.bytes[b] for b in p.encode("utf-8", "surrogatepass")]
        return np.array(out, "<u4").tobytes()

    def word_ids(self, words: list[str]) -> bytes:
        """Ids of words, each of which begins with a space and stands between two cuts."""
        known = self.words
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            if len(known) > _CACHE_WORDS:
                known.clear()
            new = [w for w in dict.fromkeys(words) if w not in known]
            # The model sets the first space itself; a lone one is its own piece.
            found = self.model.encode([w.replace(SPACE, " ")[1:] for w in new], num_threads=1)
            lone = [self.ids[SPACE]]
            known.update((w, np.array(lone if w == SPACE else ids, "<u4").tobytes()) for w, ids in zip(new, found))
            return b"".join(map(known.__getitem__, words))

    def normalized(self, text: str) -> str:
        return self.model.normalize(text) if text else ""


def vocabulary(path: str) -> Vocabulary:
    store = worker_store("pieces")
    if path not in store:
        store[path] = Vocabulary(path)
    return store[path]


def _is_cut(text: str, at: int) -> bool:
    """No piece reaches over the start of a word, nor over the ends of the text."""
    return at <= 0 or at >= len(text) or (text[at] == SPACE and text[at - 1] != SPACE)


def boundary_states(v: Vocabulary, text: str, at: int) -> list[tuple[int, int]]:
    """Pieces (i, j) that start i >= 1 characters before ``at`` and end j >= 0 after it; or only CUT."""
    if _is_cut(text, at):
        return [CUT]
    low = next((at - i for i in range(1, v.longest) if _is_cut(text, at - i)), at - v.longest)
    high = next((at + j for j in range(1, v.longest) if _is_cut(text, at + j)), at + v.longest)
    return [
        (i, j)
        for i in range(1, min(v.longest, at - low) + 1)
        for j in range(0, min(v.longest - i, high - at) + 1)
        if at + j <= len(text) and v.is_piece(text[at - i : at + j])
    ]


def _steps(v: Vocabulary, text: str, start: int, stop: int, entries: dict[tuple[int, int], int]):
    """Reachable pieces (start, end) from the entries on: {piece: (entries as bits, pieces before it)}.

    Follows stable neighbours until a piece ends at ``stop`` or beyond; a cut at ``stop`` bounds all pieces.
    """
    reach: dict[tuple[int, int], int] = {}
    back: dict[tuple[int, int], list[tuple[int, int]]] = {}
    ready: dict[int, list[tuple[int, int]]] = {}
    for piece, bits in entries.items():
        reach[piece] = bits
        back[piece] = []
        ready.setdefault(piece[1], []).append(piece)
    for at in range(start, stop):
        for before in ready.pop(at, ()):
            a = text[before[0] : before[1]]
            for size in range(1, min(v.longest, len(text) - at) + 1):
                end = at + size
                if size > 1 and _is_cut(text, end - 1):
                    break
                piece = text[at:end]
                if v.is_piece(piece) and (not a or v.is_stable(a, piece)):
                    node = (at, end)
                    if node not in reach:
                        reach[node] = 0
                        back[node] = []
                        ready.setdefault(end, []).append(node)
                    reach[node] |= reach[before]
                    back[node].append(before)
    return reach, back


def _edges_of(text: str, start: int, stop: int) -> tuple[int, int]:
    """First and last cut in [start, stop]; (-1, -1) if there is none."""
    first = next((i for i in range(start, stop + 1) if _is_cut(text, i)), -1)
    last = next((i for i in range(stop, start - 1, -1) if _is_cut(text, i)), -1)
    return first, last


def _entry(text: str, at: int, state: tuple[int, int]) -> tuple[int, int]:
    return (at, at) if state == CUT and _is_cut(text, at) else (at - state[0], at + state[1])


def transfer(v: Vocabulary, text: str, start: int, stop: int) -> np.ndarray:
    """The chunk's matrix over the boundary states: 0 where a path of stable pieces joins them, else minus infinity."""
    ins, outs = boundary_states(v, text, start), boundary_states(v, text, stop)
    out = np.full((len(ins), len(outs)), -np.inf)
    first, last = _edges_of(text, start, stop)
    entries = {_entry(text, start, s): 1 << k for k, s in enumerate(ins)}
    if first < 0:  # one word from end to end
        reach, _ = _steps(v, text, start, stop, entries)
        for j, state in enumerate(outs):
            bits = reach.get((stop - state[0], stop + state[1]), 0)
            for i in range(len(ins)):
                if bits >> i & 1:
                    out[i, j] = 0.0
        return out
    into = np.full(len(ins), -np.inf)  # from the start to the first cut, and from the last cut to the end
    if first == start:
        into[:] = 0.0
    else:
        reach, _ = _steps(v, text, start, first, entries)
        for (_, end), bits in reach.items():
            if end == first:
                for i in range(len(ins)):
                    if bits >> i & 1:
                        into[i] = 0.0
    onto = np.full(len(outs), -np.inf)
    if last == stop:
        onto[:] = 0.0
    else:
        reach, _ = _steps(v, text, last, stop, {(last, last): 1})
        for j, state in enumerate(outs):
            if reach.get((stop - state[0], stop + state[1])):
                onto[j] = 0.0
    return into[:, None] + onto[None, :]


def combined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def boundaries(matrices: list[np.ndarray]) -> list[int]:
    """The state at the start of each chunk and at the end: the one path from the first state to the last.

    Prefix products from the left say what the start can reach, and from the right what reaches the end.
    """
    left = [np.zeros(1)]
    for m in matrices:
        left.append((left[-1][:, None] + m).max(axis=0))
    right = [np.zeros(1)]
    for m in reversed(matrices):
        right.append((m + right[-1][None, :]).max(axis=1))
    return [int(np.argmax(x + y)) for x, y in zip(left, reversed(right))]


def states(matrices: list[np.ndarray]) -> list[int]:
    """:func:`boundaries` by halves: products of halves say what lies between them, and so on inside each half."""
    known = [0] * (len(matrices) + 1)

    def product(low: int, high: int) -> tuple:
        if high - low == 1:
            return matrices[low], None, None
        middle = (low + high) // 2
        left, right = product(low, middle), product(middle, high)
        return combined(left[0], right[0]), left, right

    pending = [(0, len(matrices), product(0, len(matrices)))]
    while pending:
        low, high, (_, left, right) = pending.pop()
        if left is not None:
            middle = (low + high) // 2
            known[middle] = int(np.argmax(left[0][known[low]] + right[0][:, known[high]]))
            pending += [(low, middle, left), (middle, high, right)]
    return known


def trace(v: Vocabulary, text: str, start: int, stop: int, state_in: tuple[int, int], state_out: tuple[int, int]) -> bytes:
    """Ids of the pieces that start in [start, stop), between two known boundary pieces."""
    first, last = _edges_of(text, start, stop)

    def path(lo: int, hi: int, entry: tuple[int, int], end: tuple[int, int] | None) -> list[str]:
        """Pieces after ``entry`` up to ``end``, or up to the cut at ``hi``; those that start before ``hi``."""
        _, back = _steps(v, text, lo, hi, {entry: 1})
        goals = [end] if end else [n for n in back if n[1] == hi and n != entry]
        for node in goals:
            out = []
            while node != entry:
                out.append(text[node[0] : node[1]])
                node = back[node][0]
            return out[::-1]
        return []

    entry = _entry(text, start, state_in)
    ending = None if _is_cut(text, stop) else (stop - state_out[0], stop + state_out[1])
    if first < 0:
        return v.piece_ids(path(start, stop, entry, ending)) if entry != ending else b""
    head = [] if first == start or entry[1] >= first else path(start, first, entry, None)
    tail = [] if last == stop else path(last, stop, (last, last), ending)
    return v.piece_ids(head) + v.word_ids(_WORD.findall(text, first, last)) + v.piece_ids(tail)


def _starts(text: str, size: int) -> list[int]:
    return list(range(0, max(1, len(text)), size))


def _chunked(text: str, starts: list[int], states: list[int], v: Vocabulary, size: int, k: int) -> bytes:
    stop = min(len(text), starts[k] + size)
    return trace(v, text, starts[k], stop, boundary_states(v, text, starts[k])[states[k]], boundary_states(v, text, stop)[states[k + 1]])


def encode_text(text: str | None, path: str, size: int = CHUNK) -> bytes:
    """Ids of one text as little-endian unsigned 32-bit bytes; the plain form of :func:`encode`."""
    v = vocabulary(path)
    plain = v.normalized(text or "")
    if not plain:
        return b""
    starts = _starts(plain, size)
    matrices = [transfer(v, plain, s, min(len(plain), s + size)) for s in starts]
    states = boundaries(matrices)
    return b"".join(_chunked(plain, starts, states, v, size, k) for k in range(len(starts)))


def decode_ids(ids: bytes, path: str) -> str:
    """The text of ids: pieces' bytes put together, the space in front taken off."""
    table = vocabulary(path).text
    data = b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist()))
    return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


def encode(docs: DataFrame, path: str, size: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, chunk, chunks, n_chars, ids: one row per chunk of each row.

    Chunks of longer documents move once, as text with the characters around them that a piece across a boundary may
    need and with their two states.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    short = F.char_length("text") < size

    def whole(it):
        v = vocabulary(path)
        for doc_id, text in it:
            plain = v.normalized(text)
            yield doc_id, 0, 1, len(text), trace(v, plain, 0, len(plain), CUT, CUT) if plain else b""

    def split(it):
        v = vocabulary(path)
        for doc_id, text in it:
            plain = v.normalized(text)
            starts = _starts(plain, size)
            stops = [min(len(plain), start + size) for start in starts]
            found = states([transfer(v, plain, start, stop) for start, stop in zip(starts, stops)])
            for k, (start, stop) in enumerate(zip(starts, stops)):
                low, high = max(0, start - 2 * v.longest), min(len(plain), stop + 2 * v.longest)
                yield doc_id, k, len(starts), len(text), plain[low:high], start - low, stop - low, found[k], found[k + 1]

    def back(it):
        v = vocabulary(path)
        for doc_id, chunk, chunks, n, part, lo, hi, state_in, state_out in it:
            # Contexts end in the middle of words: states are counted on the context as on the whole text.
            yield doc_id, chunk, chunks, n, trace(v, part, lo, hi, boundary_states(v, part, lo)[state_in], boundary_states(v, part, hi)[state_out])

    ddl = "doc_id long, chunk int, chunks int, n_chars long, ids binary"
    parts = map_rows(own.where(~short), split, "doc_id long, chunk int, chunks int, n_chars long, part string, lo int, hi int, state_in int, state_out int", 500)
    spread = parts.withColumn("_row", F.monotonically_increasing_id()).repartition("_row").drop("_row")
    return map_rows(own.where(short), whole, ddl, 500).unionByName(map_rows(spread, back, ddl, 500))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Chunks (doc_id, chunk, chunks, ids) with ``text``: what the ids of the chunk stand for.

    A document's texts put together in order are the document; a byte character cut by a chunk's end is never
    split, as chunks end between characters.
    """

    def rows(it):
        table = vocabulary(path).text
        for doc_id, chunk, chunks, n, ids in it:
            data = b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist()))
            yield doc_id, chunk, chunks, n, ids, (data[1:] if chunk == 0 and data[:1] == b" " else data).decode("utf-8", "replace")

    columns = ["doc_id", "chunk", "chunks", "n_chars", "ids"]
    return map_rows(encoded.select(*columns), rows, "doc_id long, chunk int, chunks int, n_chars long, ids binary, text string", 500)


def digest(encoded: DataFrame, path: str) -> DataFrame:
    """Per chunk: doc_id, chunk, chunks, n_chars of the document, n_ids, ids_crc32, decoded_chars, decoded_sha256."""
    text = F.col("text")
    return decode(encoded, path).select(
        "doc_id", "chunk", "chunks", "n_chars", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"),
        F.char_length(text).cast("long").alias("decoded_chars"), F.sha2(text, 256).alias("decoded_sha256"),
    )
