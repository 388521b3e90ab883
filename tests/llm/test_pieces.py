import random

import numpy as np
import public_tokenizers

from codewarden.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["the", "ing", "a", "b", "er", "  ", "   ", " ", "\n", "ö", "漢", "🙂", "\t", "x", "on", "▁", "st", "ea", "0"]


def _ids(data):
    return np.frombuffer(data, "<u4").tolist()


def test_texts_against_the_library(prose):
    rnd, v = random.Random(1), pieces.vocabulary(PATH)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 60))) for _ in range(300)] + [prose(400, 1), "", " ", None, "thering" * 900]
    for text in texts:
        for size in (rnd.choice([3, 5, 8, 13]), pieces.CHUNK):
            data = pieces.encode_text(text, PATH, size)
            assert _ids(data) == v.model.encode(text or "")
        if "▁" not in (text or ""):
            assert pieces.decode_ids(data, PATH) == (text or "")


def test_matrices_combine_associatively():
    v, text = pieces.vocabulary(PATH), "▁" + "therstoning" * 12
    m = [pieces.transfer(v, text, s, min(len(text), s + 17)) for s in range(0, len(text), 17)]
    left = m[0]
    for x in m[1:]:
        left = pieces.combined(left, x)
    right = m[-1]
    for x in reversed(m[:-1]):
        right = pieces.combined(x, right)
    assert (left == right).all() and (left == pieces.transfer(v, text, 0, len(text))).all() and left.max() == 0


def test_chunks_of_a_table(docs_of, odd):
    rnd = random.Random(9)
    rows = [*odd, (50, "".join(rnd.choice(PARTS[:6] + PARTS[14:15]) for _ in range(400))), (51, "the" * 200)]
    found = pieces.decode(pieces.encode(docs_of(rows), PATH, size=64), PATH).collect()
    v, whole = pieces.vocabulary(PATH), {}
    for r in sorted(found, key=lambda r: r.chunk):
        ids, text = whole.get((r.doc_id, r.n_chars), ([], ""))
        whole[r.doc_id, r.n_chars] = (ids + _ids(r.ids), text + r.text)
    for i, text in rows:
        text = text or ""
        times = sum((a, len(t or "")) == (i, len(text)) for a, t in rows)
        ids, back = whole[i, len(text)]
        if times == 1:
            assert ids == v.model.encode(text) and back == text
        else:
            assert len(ids) == times * len(v.model.encode(text))


def test_empty_table(docs_of):
    assert pieces.digest(pieces.encode(docs_of([]), PATH), PATH).count() == 0


def test_states_by_halves_are_the_states_along_the_line():
    v, rnd = pieces.vocabulary(PATH), random.Random(5)
    for size in (2, 7, 17, 40):
        text = "▁" + "".join(rnd.choice(PARTS[:5] + ["▁x"]) for _ in range(120))
        m = [pieces.transfer(v, text, s, min(len(text), s + size)) for s in range(0, len(text), size)]
        assert pieces.states(m) == pieces.boundaries(m)
