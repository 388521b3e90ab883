"""WARC archives: one gzip member per record, and a sequential reader that checks length and digest.

An archive is a run of binary blocks, kept as a table (archive, block, data), which any store that Spark
writes can hold; :func:`write_files` and :func:`read_files` exchange such blocks with ``.warc.gz`` files. The reader feeds
blocks to one decompressor per member and holds a block, a header and (if wanted) one payload.

Defined results: a null payload is empty; a row with a null id is a record without an id, never referred to;
rows that share the smallest id of a payload are all responses; a null address is empty; a broken record is a
row with ``problem`` and ends its archive; an empty table gives no records; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codewarden.llm.text import map_rows
from codewarden.session import cut_lineage

BLOCK_BYTES, ARCHIVE_BYTES = 1 << 20, 64 << 20
# Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record as a gzip member; a revisit carries the HTTP head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + _END + block + _END) + packer.flush()


def archives(pages: DataFrame, min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Blocks (archive, block, data) with a record per row; later copies of a payload are revisits."""
    own = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\r\n]", "").alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("html")
    ).withColumn("sha", F.sha1("html"))
    large = F.octet_length("html") >= min_revisit_bytes
    # Which rows are revisits is found on ids and digests; payloads then meet that by their own id, so that no payload
    # that very many pages have is dealt into one task. The hint keeps one plan at all sizes.
    small = own.where(large).select("page_id", "sha")
    firsts = cut_lineage(small.groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL"))
    again = small.join(firsts, "sha").where("page_id IS NULL OR page_id > first").select(F.col("page_id").alias("id"), F.col("sha").alias("of"), "first").distinct()
    joined = own.join(again.hint("merge"), own["page_id"].eqNullSafe(F.col("id")) & (own["sha"] == F.col("of")), "left")
    revisit = F.col("of").isNotNull()

    def rows(it):
        part, archive, block, held, size = TaskContext.get().partitionId(), 0, 0, [], 0
        held_bytes = 0
        for page_id, url, html, first, again in it:
            data = record(page_id, url, html.encode("utf-8", "surrogatepass"), first, again, date)
            held.append(data)
            held_bytes += len(data)
            size += len(data)
            if held_bytes >= BLOCK_BYTES or size >= ARCHIVE_BYTES:
                yield part * (1 << 24) + archive, block, b"".join(held)
                held, held_bytes, block = [], 0, block + 1
                if size >= ARCHIVE_BYTES:
                    archive, block, size = archive + 1, 0, 0
        if held:
            yield part * (1 << 24) + archive, block, b"".join(held)

    return map_rows(joined.select("page_id", "url", "html", "first", revisit.alias("again")), rows, "archive long, block int, data binary", 4)


class Broken(ValueError):
    pass


class Reader:
    """Records of one archive from its blocks, in one pass."""

    def __init__(self, blocks: Iterable[bytes], keep_payload: bool = False):
        self._blocks, self._input, self._member, self._plain = iter(blocks), b"", None, b""
        self._keep = keep_payload

    def _more(self) -> bytes:
        """The next plain bytes of the current member; b"" at its end."""
        while True:
            if self._member.eof:
                return b""
            if not self._input:
                self._input = next(self._blocks, b"")
                if not self._input:
                    raise Broken("archive ends inside a record")
            try:
                plain = self._member.decompress(self._member.unconsumed_tail or self._input, 1 << 16)
            except zlib.error as exc:
                raise Broken(f"bad compressed data: {exc}") from None
            self._input = self._member.unused_data if self._member.eof else self._member.unconsumed_tail
            if plain:
                return plain

    def _until(self, mark: bytes) -> bytes:
        while mark not in self._plain:
            more = self._more()
            if not more:
                raise Broken("record ends inside a header")
            self._plain += more
        head, _, self._plain = self._plain.partition(mark)
        return head

    def _content(self, length: int) -> Iterator[bytes]:
        while length:
            if not self._plain:
                self._plain = self._more()
                if not self._plain:
                    raise Broken("record is shorter than its Content-Length")
            part, self._plain = self._plain[:length], self._plain[length:]
            length -= len(part)
            yield part

    def __iter__(self) -> Iterator[dict]:
        while True:
            if not self._input:
                self._input = next(self._blocks, b"")
                if not self._input:
                    return
            self._member, self._plain = zlib.decompressobj(31), b""
            yield self._record()

    def _record(self) -> dict:
        lines = self._until(_END).decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise Broken("no WARC version line")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        try:
            length = int(fields["content-length"])
        except (KeyError, ValueError):
            raise Broken("no Content-Length") from None
        block, payload, kept, head, n = hashlib.sha1(), hashlib.sha1(), [], b"", 0
        open_head = "application/http" in fields.get("content-type", "")
        for part in self._content(length):
            block.update(part)
            if open_head:
                head += part
                if _END not in head:
                    continue
                head, _, part = head.partition(_END)
                open_head = False
            payload.update(part)
            n += len(part)
            if self._keep:
                kept.append(part)
        rest = self._plain + b"".join(iter(self._more, b""))
        if rest != _END:
            raise Broken("record is longer than its Content-Length")
        named = lambda k: (fields.get(k) or "").rpartition(":")[2].rstrip(">")
        text = lambda h: base64.b32encode(h.digest()).decode()
        kind = fields.get("warc-type", "")
        claimed = named("warc-payload-digest")
        if named("warc-block-digest") not in ("", text(block)):
            raise Broken("block digest differs")
        if kind == "response" and claimed not in ("", text(payload)):
            raise Broken("payload digest differs")
        http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
        full = int(http.get("content-length") or 0) if kind == "revisit" else n  # a revisit's head speaks of the payload it stands for
        refers = named("warc-refers-to")
        return {
            "page_id": int(named("warc-record-id")) if named("warc-record-id") else None, "url": fields.get("warc-target-uri", ""), "payload_bytes": full,
            "payload_digest": claimed or text(payload), "record_type": kind, "refers_to": int(refers) if refers else None, "payload": b"".join(kept) if self._keep else None,
        }


FIELDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, problem string"


def read(blocks: DataFrame, keep_payload: bool = False) -> DataFrame:
    """Records of archives, read block by block in order; see ``FIELDS``."""
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def rows(it):
        from itertools import groupby

        for _, group in groupby(it, key=lambda r: r[0]):
            parts = (r[2] for r in group)
            try:
                for found in Reader(parts, keep_payload):
                    yield tuple(found.get(n) for n in names)
            except Broken as exc:
                yield *[None] * (len(names) - 1), str(exc)
            for _ in parts:  # what follows a broken record
                pass

    ordered = blocks.repartition("archive").sortWithinPartitions("archive", "block")
    return map_rows(ordered.select("archive", "block", "data"), rows, FIELDS, 1000)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``.warc.gz`` files as blocks, one block per file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.xxhash64("path").alias("archive"), F.lit(0).alias("block"), F.col("content").alias("data"))


def write_files(blocks: DataFrame, folder: str) -> None:
    """One ``.warc.gz`` file per archive in a folder that all executors have mounted."""

    def write(it):
        out, name = None, None
        for row in it:
            if row["archive"] != name:
                if out:
                    out.close()
                name = row["archive"]
                out = open(f"{folder}/{name:012d}.warc.gz", "wb")
            out.write(row["data"])
        if out:
            out.close()

    blocks.repartition("archive").sortWithinPartitions("archive", "block").foreachPartition(write)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write every row into archives, and read the archives back."""
    return read(cut_lineage(archives(pages, **options)))
