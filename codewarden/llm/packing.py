"""Packing of token ids into windows: non-negative least squares over shallow length combinations.

A document is its token ids and an end id. Whole windows are cut off first; the remainders are lengths
below the window. Combinations ``(a, b, ..., b)`` that fill a window exactly are enumerated, their repeat
counts solved against the histogram of the lengths by non-negative least squares, and rounded. What they
leave over is laid end to end, longest first, and cut where a window ends, so only the last window is padded.

Nothing about single documents reaches the driver: it sees the histogram (one count per length below the
window). A remainder's place follows from its length and its rank among remainders of that length; ranks
are counted within input partitions and shifted by per-partition offsets, so a length that a third of all
documents have is no group.

Defined results: a null or empty text is a document of the end id alone; repeated rows are documents of
their own; a null id is carried as null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codewarden.llm.text import map_rows, worker_store
from codewarden.session import cut_lineage

# White space as the tokenizer's pattern has it.
_SPACE = "\t-\r \x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_CHUNK = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
# Fixed value: the pattern of byte-level pre-tokenizers.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CACHE_WORDS = 1_000_000


def _byte_letters() -> dict[int, str]:
    """The printable letter that a byte-level vocabulary has for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def _chunk_encoder(path: str):
    """A function from chunks to their ids.

    A byte-level tokenizer's own model is called on the pieces of its pattern, which spares the
    bookkeeping of whole encodings; any other tokenizer is called as it is.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import regex
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    kind = str(whole.pre_tokenizer)
    if whole.normalizer is not None or not kind.startswith("ByteLevel(add_prefix_space=False") or "use_regex=True" not in kind:
        return lambda chunks: [e.ids for e in whole.encode_batch(chunks, add_special_tokens=False)]
    letters, find, model = _byte_letters(), regex.compile(_BYTE_LEVEL).findall, whole.model

    tokenize, blank = model.tokenize, letters[0x20]

    def encode(chunks):
        for chunk in chunks:
            if chunk.isascii():  # letters behind a blank at most are one piece, and only the blank has another letter
                rest = chunk[1:] if chunk[:1] == " " else chunk
                if rest.isalpha():
                    yield [t.id for t in tokenize(chunk if rest is chunk else blank + rest)]
                    continue
            yield [t.id for piece in find(chunk) for t in tokenize(piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(letters))]

    return encode


def token_bytes(texts, path: str):
    """Ids of each text as little-endian unsigned 32-bit bytes.

    The tokenizer never joins across the chunks of ``_CHUNK``, so each distinct chunk is encoded once
    per worker (the store is emptied when full) and a text is its chunks' ids put together.
    """
    store = worker_store(f"tokens {path}")
    if "words" not in store:
        store["encode"] = _chunk_encoder(path)
        store["words"] = {}
    encode, words = store["encode"], store["words"]
    for text in texts:
        chunks = _CHUNK.findall(text or "")
        try:
            yield b"".join(map(words.__getitem__, chunks))
            continue
        except KeyError:
            pass
        if len(words) > _CACHE_WORDS:
            words.clear()
        missing = list({c for c in chunks if c not in words})
        for chunk, ids in zip(missing, encode(missing)):
            words[chunk] = np.array(ids, "<u4").tobytes()
        yield b"".join(map(words.__getitem__, chunks))


def _encode(docs: DataFrame, path: str, window: int, end_id: int) -> DataFrame:
    """Per document: its length, a checksum per piece, and its ranks inside the input partition."""
    end = np.array([end_id], "<u4").tobytes()

    def rows(it):
        part, full, ranks = TaskContext.get().partitionId(), 0, [0] * window
        kept: list[tuple] = []

        def texts():
            for row in it:
                kept.append(row)
                yield row[1]

        for ids in token_bytes(texts(), path):
            doc_id, _, key = kept.pop()
            ids += end
            n = len(ids) // 4
            left = n % window
            crcs = [zlib.crc32(ids[4 * s : 4 * min(n, s + window)]) for s in range(0, n, window)]
            yield doc_id, key, n, left, crcs, part, full, ranks[left]
            full += n // window
            ranks[left] += 1

    return map_rows(docs, rows, "doc_id long, text_key long, doc_tokens long, left int, crcs array<long>, part int, full_rank long, left_rank long")


def combinations(window: int, depth: int = 8) -> list[tuple[int, int, int]]:
    """(a, b, m): one piece of a and m of b fill the window; at most ``depth`` pieces."""
    return [(window - m * b, b, m) for m in range(1, depth) for b in range(1, (window - 1) // m + 1) if m > 1 or window - b >= b]


def solve(histogram: np.ndarray, window: int, rounds: int = 400) -> list[tuple[int, int, int, int]]:
    """(a, b, m, count): repeat counts that never take more pieces than there are.

    Least squares of (pieces taken - histogram) under counts >= 0, by accelerated projected gradient,
    then rounding in order of size with what is still there.
    """
    use = [c for c in combinations(window) if histogram[c[0]] and histogram[c[1]]]
    if not use:
        return []
    a, b, m = (np.array(x) for x in zip(*use))
    taken = lambda x: np.bincount(a, x, window) + np.bincount(b, m * x, window)
    back = lambda r: r[a] + m * r[b]
    v = np.ones(len(a))
    for _ in range(30):
        v = back(taken(v))
        norm = np.linalg.norm(v)
        v /= norm
    scale = max(1.0, float(histogram.max()))
    target = histogram / scale
    x = y = np.zeros(len(a))
    t = 1.0
    for _ in range(rounds):
        after = np.maximum(0, y - back(taken(y) - target) / (1.05 * norm))
        t_after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = after + (t - 1) / t_after * (after - x), after, t_after
    left, out = histogram.astype(np.int64).copy(), []
    for i in np.argsort(-x, kind="stable"):
        la, lb, k = int(a[i]), int(b[i]), int(m[i])
        most = int(left[la]) // (k + 1) if la == lb else min(int(left[la]), int(left[lb]) // k)
        count = min(most, int(round(x[i] * scale)))
        if count:
            left[la] -= count
            left[lb] -= k * count
            out.append((la, lb, k, count))
    return out


def _places(histogram: np.ndarray, window: int, first: int):
    """Sorted (length, from rank) with sequence and offset of that rank, and the lengths' places on the line."""
    taken, intervals, sequence = np.zeros(window, np.int64), [], first
    for a, b, m, count in solve(histogram, window):
        offset = 0
        for length in [a] + [b] * m:
            intervals.append((length, int(taken[length]), sequence, offset))
            taken[length] += count
            offset += length
        sequence += count
    rest = histogram - taken
    lengths = np.arange(window)
    line = np.zeros(window, np.int64)
    line[:-1] = np.cumsum((rest * lengths)[::-1])[::-1][1:]  # longest first
    intervals.sort()
    return np.array(intervals, np.int64).reshape(-1, 4), taken, line, sequence


def _text_key(text) -> F.Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def pack(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, text_key."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), _text_key(F.col(text_col)).alias("text_key"))
    encoded = cut_lineage(_encode(own, path, window, end_id))
    per_part = encoded.groupBy("part", "left").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("doc_tokens") / window)).alias("full"))
    counts = cut_lineage(per_part)
    histogram = np.zeros(window, np.int64)
    whole = 0
    for row in counts.groupBy("left").agg(F.sum("n").alias("n"), F.sum("full").alias("full")).collect():  # at most one row per length
        whole += row["full"]
        histogram[row["left"]] = row["n"] if row["left"] else 0
    intervals, taken, line, line_first = _places(histogram, window, whole)
    before = lambda keys, value: F.coalesce(F.sum(value).over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lefts = cut_lineage(counts.withColumn("left_before", before(["left"], "n")).select("part", "left", "left_before"))
    # One row per input partition; summed in blocks, so no task gets all of them.
    block = F.floor(F.col("part") / 1000).cast("int")
    parts = counts.groupBy("part").agg(F.sum("full").alias("full")).withColumn("block", block)
    blocks = parts.groupBy("block").agg(F.sum("full").alias("block_full"))
    earlier = blocks.alias("x").join(blocks.alias("y"), F.col("y.block") < F.col("x.block"), "left").groupBy(F.col("x.block").alias("block")).agg(F.coalesce(F.sum("y.block_full"), F.lit(0)).alias("block_before"))
    fulls = parts.withColumn("full_before", before(["block"], "full")).join(earlier, "block")
    fulls = cut_lineage(fulls.select("part", (F.col("full_before") + F.col("block_before")).alias("full_before")))
    ranked = encoded.join(lefts, ["part", "left"]).join(fulls, "part").select(
        "doc_id", "text_key", "doc_tokens", "crcs", "left", (F.col("full_rank") + F.col("full_before")).alias("full_at"), (F.col("left_rank") + F.col("left_before")).alias("left_at")
    )
    keys = intervals[:, 0] * (1 << 44) + intervals[:, 1]

    def rows(it):
        for doc_id, key, n, crcs, left, full_at, left_at in it:
            whole_pieces = n // window
            for i in range(whole_pieces):
                yield doc_id, key, i * window, window, crcs[i], n, full_at + i, 0
            if not left:
                continue
            start = whole_pieces * window
            if left_at < taken[left]:
                i = int(np.searchsorted(keys, left * (1 << 44) + left_at, "right")) - 1
                _, rank, sequence, offset = intervals[i].tolist()
                yield doc_id, key, start, left, crcs[-1], n, sequence + left_at - rank, offset
                continue
            at = int(line[left] + (left_at - taken[left]) * left)
            head = min(left, window - at % window)
            yield doc_id, key, start, head, crcs[-1] if head == left else None, n, line_first + at // window, at % window
            if head < left:
                yield doc_id, key, start + head, left - head, None, n, line_first + at // window + 1, 0

    ddl = "doc_id long, text_key long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    pieces = cut_lineage(map_rows(ranked, rows, ddl))
    # Checksums of remainders that were cut: their documents are encoded once more.
    cut = piece_ids(pieces.where("ids_crc32 IS NULL"), docs, path, end_id, id_col, text_col)
    cut = cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids").select(*pieces.columns)
    return pieces.where("ids_crc32 IS NOT NULL").unionByName(cut)


def piece_ids(pieces: DataFrame, docs: DataFrame, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces with ``ids``: their token ids as little-endian unsigned 32-bit bytes."""
    end = np.array([end_id], "<u4").tobytes()
    texts = docs.select(F.col(id_col).cast("long").alias("t_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), _text_key(F.col(text_col)).alias("t_key"))
    wanted = pieces.select(F.col("doc_id").alias("t_id"), F.col("text_key").alias("t_key")).distinct()
    match = lambda a, b: a["t_id"].eqNullSafe(b["t_id"]) & (a["t_key"] == b["t_key"])
    texts = texts.join(wanted, match(texts, wanted), "left_semi").dropDuplicates(["t_id", "t_key"])
    slots = pieces.withColumns({"t_id": F.col("doc_id"), "t_key": F.col("text_key")})
    found = slots.join(texts, match(slots, texts)).select(*[slots[c] for c in pieces.columns], texts["text"])
    at = {c: i for i, c in enumerate(pieces.columns)}

    def rows(it):
        kept = []

        def each():
            for row in it:
                kept.append(row)
                yield row[-1]

        for ids in token_bytes(each(), path):
            row = kept.pop()
            ids += end
            yield *row[:-1], ids[4 * row[at["start"]] : 4 * (row[at["start"]] + row[at["length"]])]

    return map_rows(found, rows, ", ".join(f"{c} {t}" for c, t in pieces.dtypes) + ", ids binary")
