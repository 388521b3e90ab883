import random
import re

from codewarden.llm import neardup
from codewarden.llm.components import components


def _sets(rows):
    out = {}
    for i, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        out[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    return out


def _brute(rows, percent):
    sets = _sets(rows)
    label = {i: i for i in sets}
    ids = sorted(i for i in sets if i is not None)
    changed = True
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {i: (len(sets[i]), None if i is None else label[i], i is None or label[i] == i) for i in sets}


def _edited(text, rnd, n):
    words = text.split(" ")
    for _ in range(n):
        words[rnd.randrange(len(words))] = "edit%d" % rnd.randrange(10**6)
    return " ".join(words)


def test_against_brute_force(docs_of, odd, prose):
    rnd = random.Random(4)
    rows = list(odd)
    for base in range(6):  # groups around and above the threshold, chains included
        text = prose(220, 50 + base)
        for k in range(14):
            rows.append((100 + 20 * base + k, text))
            text = _edited(text, rnd, rnd.choice([0, 1, 1, 2, 3, 4]))
    rows += [(400 + k, prose(60, 9) + " " + prose(60, 500 + k)) for k in range(25)]  # half of every text is shared
    got = neardup.near_duplicates(docs_of(rows)).collect()
    assert len(got) == len(rows)
    want = _brute(rows, 85)
    wrong = [(r.doc_id, r.component_id, want[r.doc_id]) for r in got if (r.n_shingles, r.component_id, r.kept) != want[r.doc_id]]
    assert not wrong


def test_a_large_group_of_near_copies(docs_of, prose):
    rnd, text = random.Random(1), prose(300, 3)
    rows = [(i, _edited(text, rnd, 1)) for i in range(300)]
    assert {r.component_id for r in neardup.near_duplicates(docs_of(rows)).collect()} == {0}


def test_an_id_with_two_texts_is_one_node(docs_of, prose):
    a, b, c = prose(100, 1), prose(100, 2), prose(100, 3)
    rows = [(1, a), (2, a + " x"), (2, b), (3, b + " y"), (4, c)]
    got = {(r.doc_id, r.component_id) for r in neardup.near_duplicates(docs_of(rows)).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_empty_table(docs_of):
    assert neardup.near_duplicates(docs_of([])).count() == 0


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(45)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {n: n for e in edges if e[0] != e[1] for n in e}
    for _ in range(len(label)):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label
