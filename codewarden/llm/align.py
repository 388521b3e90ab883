"""Alignment of two tokenizers' tokens over the same bytes.

A (a byte-level vocabulary) and B (pieces with byte fallback) both end a token at some byte offsets of a text.
Those common ends come from a galloping intersection of the two ascending lists of ends: each end of the shorter
list drives an exponential and then a binary search in the longer one, from where the last one stopped. Common
ends cut the text into groups; the positions (ranks) of a common end in both lists, less those of the one before,
are the ranges of A and B tokens that a group holds. The last A token and the last B token of a group end
together: they are linked.

Texts are first cut where both vocabularies must end a token whatever stands around (after a character that is no
white space, before white space that no piece of B joins to it), and each distinct stretch is encoded and
intersected once per worker.

A linked pair's bytes end alike, so one token's bytes are a suffix of the other's. Pairs are therefore numbered by
the vocabularies alone: there are at most as many as the vocabularies have bytes in all, however large the corpus
is. Counts of pairs over the corpus are one array of that proven size.

Defined results: null and empty texts, and texts that either vocabulary does not give back byte by byte, have no
tokens: all counts are 0 and the groups are empty; repeated rows are documents of their own and count each; a null
id is carried; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from array import array
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codewarden.llm.packing import _SPACE, _byte_letters, _chunk_encoder
from codewarden.llm.text import map_rows, worker_store
from codewarden.session import cut_lineage

_META = "▁"
_CACHE_UNITS = 700_000
_LONGEST_KEPT = 200  # characters of a stretch that is remembered


def galloping(short: list[int], long: list[int]) -> list[tuple[int, int]]:
    """Index pairs (i, j) with short[i] == long[j]; both lists ascend strictly."""
    out, low, n = [], 0, len(long)
    for i, value in enumerate(short):
        step, high = 1, low
        while high < n and long[high] < value:  # exponential: the answer lies in (low, high]
            low = high + 1
            high += step
            step *= 2
        high = min(high, n)
        while low < high:  # binary
            middle = (low + high) // 2
            if long[middle] < value:
                low = middle + 1
            else:
                high = middle
        if low == n:
            break
        if long[low] == value:
            out.append((i, low))
            low += 1
    return out


def common_ends(ends_a: list[int], ends_b: list[int]) -> list[tuple[int, int]]:
    """Ranks (in A, in B) of the ends that both lists have, in order."""
    if len(ends_a) <= len(ends_b):
        return galloping(ends_a, ends_b)
    return [(i, j) for j, i in galloping(ends_b, ends_a)]


class Vocabularies:
    """Both tokenizers, their tokens' bytes, where texts may be cut, and the numbers of possible links."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        a, self.model = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        back = {letter: byte for byte, letter in _byte_letters().items()}
        names = a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (1 + max(names.values()))
        for name, i in names.items():
            # A name with other letters is no byte-level entry; no text gives it.
            self.bytes_a[i] = bytes(back[c] for c in name) if all(c in back for c in name) else b""
        m = self.model
        size = m.get_piece_size()
        special = [m.is_control(i) or m.is_unknown(i) or m.is_unused(i) for i in range(size)]
        pieces = [m.id_to_piece(i) for i in range(size)]
        self.bytes_b = [
            b"" if special[i] else bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace(_META, " ").encode() for i, p in enumerate(pieces)
        ]
        joined = {p[k : k + 2] for i, p in enumerate(pieces) if not (special[i] or m.is_byte(i)) for k in range(len(p) - 1)}
        self.names_a, self.names_b = ([str(i).encode() for i in range(len(x))] for x in (self.bytes_a, self.bytes_b))
        self.sizes_a, self.sizes_b = ([len(x) for x in tokens] for tokens in (self.bytes_a, self.bytes_b))
        self.encode_a = _chunk_encoder(path_a)
        self.stretches = _stretches(joined)
        self.pairs = _pair_numbers(self.bytes_a, self.bytes_b)
        self.units: dict[str, tuple[bytes, bytes, int, int] | None] = {}

    def ids_b(self, units: list[str]) -> list[list[int]]:
        """B's ids of each stretch; the space that B sets in front is the stretch's own, or is taken off."""
        blank = self.model.piece_to_id(_META)
        found = self.model.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        return [ids[1:] if u[0] != " " else ids if len(u) > 1 else [blank] for u, ids in zip(units, found)]

    def align(self, data: bytes, a: list[int], b: list[int]) -> tuple[bytes, bytes, int, int] | None:
        """Groups as text, link numbers, and how many A and B tokens; None where the bytes differ."""
        if b"".join(map(self.bytes_a.__getitem__, a)) != data or b"".join(map(self.bytes_b.__getitem__, b)) != data:
            return None
        n_a, n_b, names_a, names_b, pairs = len(a), len(b), self.names_a, self.names_b, self.pairs
        if n_a == 1 or n_b == 1:  # only the end of the stretch is left to share
            text = b",".join(map(names_a.__getitem__, a)) + b"|" + b",".join(map(names_b.__getitem__, b))
            return text, struct.pack("i", pairs[a[-1], b[-1]]), n_a, n_b
        texts, links, from_a, from_b = [], [], 0, 0
        for i, j in common_ends(list(accumulate(map(self.sizes_a.__getitem__, a))), list(accumulate(map(self.sizes_b.__getitem__, b)))):
            last_a, last_b = a[i], b[j]
            x = names_a[last_a] if i == from_a else b",".join(map(names_a.__getitem__, a[from_a : i + 1]))
            y = names_b[last_b] if j == from_b else b",".join(map(names_b.__getitem__, b[from_b : j + 1]))
            texts.append(x + b"|" + y)
            links.append(pairs[last_a, last_b])
            from_a, from_b = i + 1, j + 1
        return b";".join(texts), array("i", links).tobytes(), n_a, n_b

    def aligned(self, text: str) -> list[tuple[bytes, bytes, int, int]] | None:
        """The stretches of a text, each aligned; None for a text that a vocabulary does not give back."""
        stretches, known = self.stretches(" " + text), self.units
        try:
            found = list(map(known.__getitem__, stretches))
        except KeyError:
            if len(known) > _CACHE_UNITS:
                known.clear()
            new = list({u for u in stretches if u not in known})
            made = dict(zip(new, map(self.align, (u.encode("utf-8", "surrogatepass") for u in new), self.encode_a(new), self.ids_b(new))))
            found = [known[u] if u in known else made[u] for u in stretches]
            known.update((u, m) for u, m in made.items() if len(u) <= _LONGEST_KEPT)
        return None if None in found else found


def _stretches(joined: set[str]):
    """A function that cuts a text before white space that follows something else, where no piece of B joins the two.

    A's pattern always begins a chunk there. White space other than a blank is a cut only if no piece holds it
    after a blank either, so that the blank B sets in front of a stretch stays apart.
    """
    white = set(_chars(_SPACE))
    named = {p[0] + (" " if p[1] == _META else p[1]) for p in joined}
    inside = {p[1] for p in named if p[1] in white and p[0] not in white and p[0] != _META}
    inside |= {p[1] for p in named if p[1] in white and p[1] != " " and p[0] == _META}
    every, held = "".join(map(re.escape, sorted(white))), "".join(map(re.escape, sorted(inside)))
    more = f"(?:[{held}][{every}]*[^{every}]*)*" if held else ""
    return re.compile(f"[{every}]*[^{every}]+{more}|[{every}]+").findall


def _chars(spec: str) -> list[str]:
    """The characters of a class written with one range."""
    return [c for c in map(chr, range(0x3001)) if re.fullmatch(f"[{spec}]", c)]


def _pair_numbers(bytes_a: list[bytes], bytes_b: list[bytes]) -> dict[tuple[int, int], int]:
    """A number for each pair of tokens of which one's bytes end the other's."""
    by_a, by_b = _by_bytes(bytes_a), _by_bytes(bytes_b)
    found = {(i, j) for i, x in enumerate(bytes_a) for k in range(len(x)) for j in by_b.get(x[k:], ())}
    found |= {(i, j) for j, x in enumerate(bytes_b) for k in range(len(x)) for i in by_a.get(x[k:], ())}
    return {pair: n for n, pair in enumerate(sorted(found))}


def _by_bytes(tokens: list[bytes]) -> dict[bytes, list[int]]:
    out: dict[bytes, list[int]] = {}
    for i, x in enumerate(tokens):
        if x:
            out.setdefault(x, []).append(i)
    return out


def vocabularies(path_a: str, path_b: str) -> Vocabularies:
    store = worker_store("align")
    if (path_a, path_b) not in store:
        store[path_a, path_b] = Vocabularies(path_a, path_b)
    return store[path_a, path_b]


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = False) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, groups_sha256, pairs, times (link numbers and how often), and groups if kept.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``: the ids of A and B in each group, in order.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def rows(it):
        v = vocabularies(path_a, path_b)
        none = np.zeros(0, np.int32)
        for doc_id, text in it:
            found = v.aligned(text) if text else None
            if not found:
                yield doc_id, 0, 0, 0, "", none, none, "" if keep_groups else None
                continue
            groups, links, sizes_a, sizes_b = zip(*found)
            whole = b";".join(groups)
            n_a, n_b = sum(sizes_a), sum(sizes_b)
            numbers = np.frombuffer(b"".join(links), np.int32)
            pairs, times = np.unique(numbers, return_counts=True)
            yield doc_id, n_a, n_b, len(numbers), hashlib.sha256(whole).hexdigest(), pairs, times.astype(np.int32), whole.decode() if keep_groups else None

    ddl = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<int>, times array<int>, groups string"
    out = map_rows(own, rows, ddl, 500)
    return out if keep_groups else out.drop("groups")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n: how many links of the corpus have it; at most one row per possible pair of the vocabularies."""

    def rows(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            pairs, times = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("pairs", "times"))
            if len(pairs):
                found = np.bincount(pairs, times, len(total)).astype(np.int64)
                found[: len(total)] += total
                total = found
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"pair": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    return aligned.select("pairs", "times").mapInArrow(rows, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def linked(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``n_best`` counts links whose pair no other A token of the same B token exceeds over the corpus, and
    ``count_sum`` adds the links' counts. Tokens are made once; the numbers of a document's links are written and
    read twice, for the counts and for the sums.
    """
    stored = cut_lineage(align(docs, path_a, path_b, id_col, text_col))
    counts = pair_counts(stored).toPandas()  # bounded by the vocabularies' bytes, not by the corpus
    at, n = counts["pair"].to_numpy(), counts["n"].to_numpy()
    key = f"link counts {uuid.uuid4().hex}"

    def rows(batches):
        tables = worker_store(key)
        if not tables:
            v = vocabularies(path_a, path_b)
            of_b = np.array([b for _, b in v.pairs])
            count = np.zeros(len(of_b), np.int64)
            count[at] = n
            top = np.zeros(len(v.bytes_b), np.int64)
            np.maximum.at(top, of_b, count)
            tables.update(count=count, best=(count == top[of_b]).astype(np.int64))
        for batch in batches:
            lists = batch.column("pairs")
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            pairs, times = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("pairs", "times"))
            per_list = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[ends])
            times = times.astype(np.int64)
            keep = {c: batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")}
            sums = {"n_links": per_list(times), "n_best": per_list(times * tables["best"][pairs]), "count_sum": per_list(times * tables["count"][pairs])}
            yield pa.RecordBatch.from_pydict(keep | {c: pa.array(x, pa.int64()) for c, x in sums.items()} | {"groups_sha256": batch.column("groups_sha256")})

    ddl = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return stored.mapInArrow(rows, ddl)
