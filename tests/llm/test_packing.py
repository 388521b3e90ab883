import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from codewarden.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def _ids(text):
    model = Tokenizer.from_file(PATH)
    model.encode_special_tokens = True
    return np.array(model.encode(text or "", add_special_tokens=False).ids + [1], "<u4")


def _check(rows, pieces, window):
    bags = {}
    for i, text in rows:
        bags.setdefault(i, []).append(_ids(text))
    by_sequence, by_doc = {}, {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
        by_doc.setdefault(p.doc_id, []).append(p)
        assert any(len(d) == p.doc_tokens and zlib.crc32(d[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for d in bags[p.doc_id])
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= window
    for i, found in by_doc.items():  # every id in exactly one piece
        assert sum(p.length for p in found) == sum(len(d) for d in bags[i])
        starts = sorted((p.doc_tokens, p.start, p.length) for p in found)
        assert sum(s == 0 for _, s, _ in starts) == len(bags[i])
    assert set(by_doc) == set(bags)
    used = sum(p.length for p in pieces)
    return 1 - used / (len(by_sequence) * window)


def test_odd_rows_and_round_trip(docs_of, odd):
    docs = docs_of(odd)
    pieces = packing.pack(docs, PATH, window=256).collect()
    assert _check(odd, pieces, 256) < 0.05


def test_equal_lengths_are_no_padding(docs_of, prose):
    rows = [(i, prose(30, 1)) for i in range(120)]
    pieces = packing.pack(docs_of(rows), PATH, window=512).collect()
    total = sum(p.length for p in pieces)
    assert len({p.sequence_id for p in pieces}) == -(-total // 512)
    _check(rows, pieces, 512)


def test_empty_table(docs_of):
    assert packing.pack(docs_of([]), PATH).count() == 0


def test_counts_never_exceed_the_histogram():
    rng = np.random.default_rng(1)
    for scale in (3, 1000):
        histogram = rng.integers(0, scale, 64)
        histogram[0] = 0
        left = histogram.copy()
        for a, b, m, n in packing.solve(histogram, 64):
            assert a + m * b == 64 and n > 0
            left[a] -= n
            left[b] -= m * n
        assert (left >= 0).all()
        assert (left * np.arange(64)).sum() < 0.5 * (histogram * np.arange(64)).sum()


def test_chunks_are_the_tokenizers(prose):
    import random

    rnd = random.Random(3)
    parts = ["the", "'s", "'ll", "don't", "’", "é", "ª", "°", "9", "½", " ", "  ", "\n", "\t", "\xa0", "\x85", "\x1c", "漢", "🙂", "_", "<|endoftext|>"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(300)] + [prose(50, 2)]
    for text, data in zip(texts, packing.token_bytes(texts, PATH)):
        assert np.frombuffer(data, "<u4").tolist() == _ids(text)[:-1].tolist()
