import hashlib
from collections import Counter

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codewarden.llm import align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def brute():
    """groups(text) by the tokenizers' own whole encodings and set intersection; None where there are no tokens."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b, v = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B), align.vocabularies(A, B)
    a.encode_special_tokens = True

    def groups(text):
        if not text:
            return None
        sides = []
        for ids, table in ((a.encode(" " + text, add_special_tokens=False).ids, v.bytes_a), (b.encode(text), v.bytes_b)):
            ends, at = {}, 0
            if b"".join(table[i] for i in ids) != (" " + text).encode():
                return None
            for i in ids:
                at += len(table[i])
                ends[at] = i
            sides.append(ends)
        out, now = [], ([], [])
        for end in sorted(sides[0].keys() | sides[1].keys()):
            for ids, side in zip(now, sides):
                ids += [side[end]] if end in side else []
            if all(end in side for side in sides):
                out.append(now)
                now = ([], [])
        return out

    return groups


def written(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


ODD = [
    "<|endoftext|> a<|endoftext|>", "</s><s> x", "a\r\n b \r c;\r\n\r\nd", "  two", "\n\nx", "a  \t b", "ünï 漢字 🙂 \x01  x　y", "▁a", "a▁b",
    "x" * 5000, "a " * 300, " ", "\t", "a ", "a\n", "don't we'll", "a\x00b", "ﬁ １２", "a\x1cb \x1c c", " x", "a\xa0b \xa0",
]


@given(st.lists(st.integers(0, 60), unique=True), st.lists(st.integers(0, 60), unique=True))
@settings(max_examples=300, deadline=None)
def test_galloping_is_the_intersection(a, b):
    a, b = sorted(a), sorted(b)
    found = align.common_ends(a, b)
    assert [a[i] for i, _ in found] == sorted(set(a) & set(b)) == [b[j] for _, j in found]


@given(st.text(st.sampled_from(list(" \t\r\n;'sabé漢🙂▁\xa0　\x1c.")), max_size=30))
@settings(max_examples=400, deadline=None)
def test_stretches_align_as_whole_texts(brute, text):
    found = align.vocabularies(A, B).aligned(text) if text else None
    expected = brute(text)
    assert (found and b";".join(f[0] for f in found).decode()) == (expected and written(expected))


def test_links_and_counts(spark, docs_of, odd, prose, brute):
    rows = odd + [(20 + i, t) for i, t in enumerate(ODD)] + [(60 + i, prose(300, i)) for i in range(8)] + [(70, prose(300, 1))]
    groups = [(i, brute(t)) for i, t in rows]
    count = Counter((a[-1], b[-1]) for _, g in groups for a, b in g or ())
    top = {}
    for (_, b), n in count.items():
        top[b] = max(top.get(b, 0), n)
    expected = []
    for i, g in groups:
        pairs = [(a[-1], b[-1]) for a, b in g or ()]
        sizes = [sum(len(x[k]) for x in g or ()) for k in (0, 1)]
        digest = hashlib.sha256(written(g).encode()).hexdigest() if g else ""
        expected.append((i, *sizes, len(pairs), len(pairs), sum(count[p] == top[p[1]] for p in pairs), sum(count[p] for p in pairs), digest))
    got = [tuple(r) for r in align.linked(docs_of(rows).repartition(3), A, B).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(expected, key=key)
    assert sum(r[1] for r in got) > 3000


def test_kept_groups_and_no_rows(spark, docs_of):
    row = align.align(docs_of([(1, "two words")]), A, B, keep_groups=True).first()
    assert row.groups_sha256 == hashlib.sha256(row.groups.encode()).hexdigest() and row.n_groups == row.groups.count("|")
    assert align.linked(docs_of([]), A, B).collect() == []
    assert sorted(align.linked(docs_of([(1, None), (2, "")]), A, B).collect()) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_plain_words_have_the_library_s_ids():
    """Words that the encoder takes whole have the ids that the library gives, beside texts that its pattern cuts."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from codewarden.llm.packing import _chunk_encoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    chunks = [" word", "word", " Word's", " a", "a", " ", "  two", " x1", "1", " é", "\nline", " kalominetu", "thisthshntre", " under_score", "don't", ""]
    assert list(_chunk_encoder(path)(chunks)) == [e.ids for e in whole.encode_batch(chunks, add_special_tokens=False)]
