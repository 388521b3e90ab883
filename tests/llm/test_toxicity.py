import random
import zlib

import numpy as np

from codewarden.llm import toxicity as T

BAD = ["grobian", "wortheless", "numskull"]


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_is_edit_distance():
    rnd = random.Random(1)
    words = ["=grobian", "=groban", "=wortheless", "=abcd", "=abcdefghij", "stem", "!loweis"]
    lexicon = {w: 1.0 + i for i, w in enumerate(words)}
    a = T.Automaton(lexicon)

    def brute(word):
        exact = [v for w, v in lexicon.items() if (word == w[1:] if w[0] in "=!" else word.startswith(w))]
        most = lambda w: 0 if len(w) < 5 else 1 if len(w) < 9 else 2
        near = [v for w, v in lexicon.items() if w[0] == "=" and 0 < _distance(word, w[1:]) <= most(w[1:])]
        return max(exact, default=0.0), max(near, default=0.0)

    for _ in range(4000):
        word = list(rnd.choice(words).lstrip("=!"))
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randrange(len(word) + 1)
            word[at : at + rnd.randint(0, 1)] = rnd.choice(["", "a", "b", "e", "x"])
        word = "".join(word) + rnd.choice(["", "", "schaft"])
        exact, near = a.match(word)
        want = brute(word)
        assert exact == want[0], word
        if exact == 0 or near:
            assert near == want[1], word


def _corpus(prose, n):
    rnd, rows, labels = random.Random(2), [], []
    for i in range(n):
        toxic = i % 8 == 0
        words = prose(40, 5000 + i).split()
        if toxic:
            for _ in range(2):
                words.insert(rnd.randrange(len(words)), rnd.choice(BAD))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def _labels(spark, rows):
    return spark.createDataFrame([(i, 1, t, "x") for i, t in rows], "doc_id long, quality int, toxic int, text string")


def test_held_out_accuracy(spark, docs_of, odd, prose):
    rows, labels = _corpus(prose, 600)
    more = [(10_000, "you are a numskul"), (10_001, None), (10_002, ""), (10_003, prose(30_000, 3)), (10_004, "grobian!!!"), (None, "worthless")]
    docs = docs_of(rows + more + rows[:2])
    model = T.learn(docs, _labels(spark, [*labels, (9_999, None), (None, 1), labels[3], (77_777, 1)]))
    assert all(any(w.startswith(t.lstrip("=!")) for t in model.lexicon) for w in BAD)
    got = T.scored(docs, model).collect()
    assert len(got) == len(rows) + len(more) + 2
    by = {r.doc_id: r for r in got}
    for i, toxic in labels:
        assert by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert by[i].predicted == toxic == int(by[i].score >= 0.5)
    assert by[10_000].score > by[10_001].score == by[10_002].score and by[10_004].predicted == 1 and by[10_003].predicted == 0
    assert all(0 <= r.score <= 1 for r in got)


def test_an_ordinary_word_near_a_term_spares_only_itself(spark, docs_of, prose):
    rows, labels = _corpus(prose, 600)
    rows = [(i, text + " trobian") if i % 8 == 1 else (i, text) for i, text in rows]
    more = [(10_000, "a trobian"), (10_001, "a grobiam"), (10_002, "a")]
    model = T.learn(docs_of(rows), _labels(spark, labels))
    assert "=grobian" in model.lexicon and "~trobian" in model.lexicon
    by = {r.doc_id: r.score for r in T.scored(docs_of(more), model).collect()}
    assert by[10_001] > by[10_000] == by[10_002]


def test_without_labels(spark, docs_of):
    docs = docs_of([(1, "x"), (2, None)])
    for labels in ([], [(1, 0), (2, 0)]):
        assert [r.score for r in T.scored(docs, T.learn(docs, _labels(spark, labels))).collect()] == [0.0, 0.0]
    assert T.scored(docs_of([]), T.Model({}, None)).count() == 0


def test_context():
    text = 'he said "grobian" twice\nwhat a grobian'
    at = text.index("grobian")
    assert T._quoted(text, at, at + 7) and not T._quoted(text, len(text) - 7, len(text))


def test_fit_separates():
    x = np.array([[0.0, 1], [0, 1], [3, 1], [4, 1]] * 20)
    w = T.fit(x, np.array([0, 0, 1, 1] * 20, float))
    assert (x @ w > 0).tolist() == [False, False, True, True] * 20
