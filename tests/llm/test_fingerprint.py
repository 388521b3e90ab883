import hashlib

import numpy as np

from codewarden.llm import fingerprint as P
from codewarden.llm.text import char_shingles


def test_sketches_are_the_smallest_hashes(prose):
    for n in (0, 1, 3, 40, 5000):
        text = prose(n, n) if n else ""
        want = np.unique(char_shingles(text, P.WIDTH))[: P.K]
        assert (P.sketch(text) == want).all() and (P.decode(P.encode(want)) == want).all()
    assert (P.sketch("ab" * 50_000) == np.unique(char_shingles("ab" * 50_000, P.WIDTH))[: P.K]).all()


def test_estimates(prose):
    a, b = prose(3000, 1), prose(3000, 2)
    sets = [set(char_shingles(t, P.WIDTH).tolist()) for t in (a, a + " " + b)]
    low = [P.sketch(a), P.sketch(a + " " + b)]
    assert abs(P.resemblance(*low) - len(sets[0] & sets[1]) / len(sets[0] | sets[1])) < 0.15
    assert abs(P.containment(*low) - 1.0) < 0.25 and abs(P.distinct(low[0]) / len(sets[0]) - 1) < 0.3
    assert P.resemblance(low[0], low[0]) == 1.0 and P.resemblance(P.sketch(""), low[0]) == 0.0 and P.resemblance(P.sketch(""), P.sketch("")) == 1.0


def test_merged_parts_are_the_whole(spark, prose):
    texts = {k: [prose(30, 10 * k + i) for i in range(9)] for k in range(3)}
    rows = [(k, P.encode(P.sketch(t))) for k, ts in texts.items() for t in ts] + [(0, None)]
    got = {r.key: r.fingerprint for r in P.merged(spark.createDataFrame(rows, "key int, fingerprint string").repartition(4), "key").collect()}
    for k, ts in texts.items():
        assert got[k] == P.encode(np.unique(np.concatenate([char_shingles(t, P.WIDTH) for t in ts]))[: P.K])


def _check(docs, rows):
    got = sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.near_next) for r in P.with_neighbours(docs).collect()), key=str)
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    want = []
    for at, (i, text) in enumerate(order):
        after = order[(at + 1) % len(order)][1]
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        own, other = P.sketch(text), P.sketch(after)
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), P.encode(own), P.resemblance(own, other)))
    assert got == sorted(want, key=str)


def test_neighbours(docs_of, odd, prose):
    rows = [r for r in odd if r[0] != 6] + [(6, odd[4][1]), (6, odd[4][1])] + [(-5, "minus"), (2**60, "large")] + [(100 + 7 * i, prose(i, i)) for i in range(1, 60)]
    _check(docs_of(rows).repartition(5), rows)
    _check(docs_of([(1, "alone in here")]), [(1, "alone in here")])
    assert P.with_neighbours(docs_of([])).count() == 0


def test_fingerprints(docs_of, odd):
    got = P.fingerprints(docs_of(odd)).collect()
    assert len(got) == len(odd) and len({r.fingerprint for r in got if r.doc_id in (5, 6)}) == 1
