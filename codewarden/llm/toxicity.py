"""Toxicity scores: a lexicon trie, Levenshtein automata over it, and the context of each match.

The lexicon is learned from a bounded sample of labelled rows: words and word beginnings that occur in toxic
documents and hardly in others. It is one trie; the Levenshtein automaton of all its words at once is a set of
(node, edits) that is made deterministic while texts are read, so a known word costs a look-up and a misspelled
one a step per letter. Words of 5 letters may miss by one edit, of 9 by two; beginnings match exactly. Words near to
one of the lexicon that ordinary documents of the sample hold themselves are no misspellings of it.

Every match is judged in its context: whether quotation marks enclose it or a word of reporting stands in the
window before it. What a match of each kind means for a document is a logistic regression, fitted on
one half of the sample with a lexicon from the other, so a term's own document does not vouch for it.

Defined results: null and empty texts score the base rate; a null label is no label; repeated rows are rows of
their own; without labels of both kinds every score is 0; an empty table gives no rows; other columns are
ignored. Labels, ids, languages and sources are no inputs of a score.
"""

import math
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codewarden.llm.text import map_rows
from codewarden.session import cut_lineage

#: Labelled rows that the model is fitted on (chosen by a hash of the id), at most; they bound the terms of the lexicon.
SAMPLE_ROWS = 24_000
PREFIXES = range(4, 9)
MIN_TOXIC, MIN_SHARE = 4, 0.9
WINDOW = 60  # characters on either side of a match
_WORD = re.compile(r"[^\W_]+")
_OPEN, _SHUT = "\"'“„«‹‘»", "\"'”“»›’«"
# Words of reporting before a match.
_SAYS = frozenset("said says say called calls word words term wrote writes quote quoted quotes dit mot sagt wort sagte dijo palabra llama".split())
FEATURES = 9


def _terms(text: str | None) -> set[str]:
    """The features of a text: words as '=word', beginnings as they are."""
    words = set(_WORD.findall((text or "").lower()))
    out = {"=" + w for w in words}
    for w in words:
        out.update(w[:n] for n in PREFIXES if n <= len(w))
    return out


def _counted(sample: DataFrame) -> DataFrame:
    """(half, term, toxic documents, other documents) over the sample; combined within partitions first."""

    def rows(it):
        held: dict[tuple, list[int]] = {}
        for half, toxic, text in it:
            for term in _terms(text):
                pair = held.setdefault((half, term), [0, 0])
                pair[0 if toxic else 1] += 1
            if len(held) > 300_000:
                yield from ((*k, *v) for k, v in held.items())
                held = {}
        yield from ((*k, *v) for k, v in held.items())

    some = map_rows(sample.select("half", "toxic", "text"), rows, "half int, term string, n1 long, n0 long", 20_000)
    return some.groupBy("half", "term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def choose(counts: dict[str, tuple[int, int]], base: float, tried: int) -> dict[str, float]:
    """Lexicon: term -> log-odds. A beginning replaces the longer ones it explains as well.

    A term's surprise under the ``base`` share of toxic documents must outweigh the number of terms
    ``tried``, so chance adds about one term in three samples.
    """

    def surprise(c):
        n, share = c[0] + c[1], c[0] / (c[0] + c[1])
        rest = (1 - share) * math.log((1 - share) / (1 - base)) if share < 1 else 0.0
        return n * (share * math.log(share / base) + rest)

    least = math.log(max(2, tried)) + 1
    strong = {t: c for t, c in counts.items() if c[0] >= MIN_TOXIC and c[0] >= MIN_SHARE * (c[0] + c[1]) and surprise(c) >= least}
    kept: dict[str, float] = {}
    weight = lambda c: math.log((c[0] + 0.5) / (c[1] + 0.5))
    for term in sorted(strong, key=lambda t: (t.startswith("="), len(t), t)):
        word = term.lstrip("=")
        shorter = [word[:n] for n in PREFIXES if n < len(word) or (n == len(word) and term.startswith("="))]
        covered = any(s in kept for s in shorter)
        # A whole word that is most of its beginning's documents stays: it can be matched with edits.
        if not covered or (term.startswith("=") and len(word) >= 5 and any(strong[term][0] >= 0.5 * strong[s][0] for s in shorter if s in kept)):
            kept[term] = weight(strong[term])
    return dict(sorted(kept.items(), key=lambda x: (-x[1], x[0])))


class Automaton:
    """The lexicon's trie met by the Levenshtein automata of its words, determinized as needed."""

    LIMIT = 200_000

    def __init__(self, lexicon: dict[str, float]):
        self.next: list[dict[str, int]] = [{}]
        self.stem: dict[int, float] = {}
        self.word: dict[int, tuple[float, int]] = {}
        self.edits = [0]  # most edits that any word below a node may still use
        self.ordinary = {term[1:] for term in lexicon if term[0] == "~"}  # no misspellings
        for term, weight in lexicon.items():
            if term[0] == "~":
                continue
            text = term.lstrip("=!")
            most = (0 if len(text) < 5 else 1 if len(text) < 9 else 2) if term[0] == "=" else 0
            node = 0
            self.edits[0] = max(self.edits[0], most)
            for c in text:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.edits.append(0)
                node = self.next[node][c]
                self.edits[node] = max(self.edits[node], most)
            if term[0] in "=!":
                self.word[node] = (weight, most)
            else:
                self.stem[node] = weight
        self._reset()

    def _reset(self):
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.ends: list[tuple[float, float]] = []  # weight of the best exact and misspelled word that ends in the state
        self.stems: list[float] = []
        self.start = self._state({0: 0})

    def _state(self, best: dict[int, int]) -> int:
        todo = list(best.items())
        while todo:  # a letter of the lexicon that the text lacks
            node, e = todo.pop()
            for child in self.next[node].values():
                if e + 1 <= self.edits[child] and e + 1 < best.get(child, 9):
                    best[child] = e + 1
                    todo.append((child, e + 1))
        key = frozenset(best.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            exact = max((self.word[n][0] for n, e in key if e == 0 and n in self.word), default=0.0)
            near = max((self.word[n][0] for n, e in key if 0 < e <= self.word.get(n, (0, 0))[1]), default=0.0)
            self.ends.append((exact, near))
            self.stems.append(max((self.stem[n] for n, e in key if e == 0 and n in self.stem), default=0.0))
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        best: dict[int, int] = {}
        for node, e in self.sets[state]:
            for letter, child in self.next[node].items():
                cost = e + (letter != c)
                if cost <= self.edits[child] and cost < best.get(child, 9):
                    best[child] = cost
            if e + 1 <= self.edits[node] and e + 1 < best.get(node, 9):  # a letter too many
                best[node] = e + 1
        out = self._state(best) if best else -1
        self.steps[state][c] = out
        return out

    def match(self, word: str) -> tuple[float, float]:
        """Weights of the best exact match (a word, or a beginning) and of the best misspelled word; 0 if none."""
        if len(self.sets) > self.LIMIT:
            self._reset()
        state, stem = self.start, 0.0
        for c in word:
            after = self.steps[state].get(c)
            state = self._step(state, c) if after is None else after
            if state < 0:
                return stem, 0.0
            stem = max(stem, self.stems[state])
        exact, near = self.ends[state]
        return max(exact, stem), 0.0 if near and word in self.ordinary else near


def _quoted(text: str, start: int, end: int) -> bool:
    """Whether quotation marks enclose a place within its window, or a word of reporting comes before it."""
    before, after = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
    opened = max(before.rfind(c) for c in _OPEN)
    line = "\n" not in before[opened:] if opened >= 0 else False
    enclosed = line and (opened == 0 or not before[opened - 1].isalnum()) and any(c in after.split("\n")[0] for c in _SHUT)
    return enclosed or bool(_SAYS & set(_WORD.findall(before.lower())[-4:]))


def features(text: str | None, automaton: Automaton, known: dict) -> list[float]:
    """Of the matches: strongest and number, for exact and misspelled, plain and quoted; and a constant."""
    low = (text or "").lower()
    hits = {}
    for word in set(_WORD.findall(low)):
        found = known.get(word)
        if found is None:
            found = known[word] = automaton.match(word)
        if found != (0.0, 0.0):
            hits[word] = found
    out = [0.0] * FEATURES
    out[-1] = 1.0
    if hits:
        for m in _WORD.finditer(low):
            if m[0] in hits:
                exact, near = hits[m[0]]
                at = (0 if exact else 4) + (2 if _quoted(low, m.start(), m.end()) else 0)
                out[at] = max(out[at], exact or near)
                out[at + 1] += 1
        for at in (1, 3, 5, 7):
            out[at] = math.log1p(out[at])
    return out


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method with a ridge on all but the constant."""
    w, penalty = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w




def _featured(sample: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    def rows(it):
        automaton, known = Automaton(lexicon), {}
        for toxic, text in it:
            if len(known) > 600_000:
                known.clear()
            yield toxic, features(text, automaton, known)

    return map_rows(sample.select("toxic", "text"), rows, "toxic int, x array<double>")


def _with_ordinary(sample: DataFrame, lexicon: dict[str, float]) -> dict[str, float]:
    """The lexicon, and ('~' before them) words near to one of it that are no misspellings.

    Counts, per near word that is not in the lexicon, the toxic and other documents of the sample that hold it;
    where others prevail, the word says nothing. Every other misspelling of the same term still counts.
    """
    if not any(t[0] == "=" for t in lexicon):
        return lexicon

    def rows(it):
        automaton, known, held = Automaton(lexicon), {}, {}
        for toxic, text in it:
            for word in set(_WORD.findall((text or "").lower())):
                near = known.get(word)
                if near is None:
                    if len(known) > 600_000:
                        known.clear()
                    exact, weight = automaton.match(word)
                    near = known[word] = not exact and weight > 0
                if near:
                    held.setdefault(word, [0, 0])[0 if toxic else 1] += 1
        yield from ((w, *c) for w, c in held.items())

    near = map_rows(sample.select("toxic", "text"), rows, "word string, n1 long, n0 long").groupBy("word").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    # At most the distinct near words of the bounded sample.
    return lexicon | {"~" + r["word"]: 0.0 for r in near.where(f"n1 < {MIN_SHARE} * (n1 + n0)").orderBy("word").collect()}


class Model:
    def __init__(self, lexicon: dict[str, float], weights: np.ndarray | None):
        self.lexicon, self.weights = lexicon, weights


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from at most about ``sample_rows`` of the labelled rows that are not held out."""
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where("toxic IN (0, 1) AND doc_id IS NOT NULL")
    marked = marked.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = marked.count()
    spread = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30))
    marked = marked.where(spread < int(min(1.0, sample_rows / max(1, n)) * (1 << 30))).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)).cast("int"))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sample = cut_lineage(own.join(marked, "doc_id").select("half", "toxic", "text"))
    counted = cut_lineage(_counted(sample))
    # Both counts and model are of the bounded sample.
    strong = counted.groupBy("term").agg(F.sum("n1").alias("n1")).where(F.col("n1") >= MIN_TOXIC).select("term")
    halves: dict[int, dict[str, tuple[int, int]]] = {0: {}, 1: {}}
    for row in counted.join(strong, "term").where("n1 > 0").where(F.col("n1") >= 0.5 * F.col("n0")).collect():
        halves[row["half"]][row["term"]] = (row["n1"], row["n0"])
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if set(sizes) != {0, 1}:
        return Model({}, None)
    base, tried = sizes[1] / (sizes[0] + sizes[1]), counted.count()
    both: dict[str, tuple[int, int]] = {}
    for half in halves.values():
        for term, (n1, n0) in half.items():
            a, b = both.get(term, (0, 0))
            both[term] = (a + n1, b + n0)
    first = _with_ordinary(sample.where("half = 0"), choose(halves[0], base, tried))
    rows = _featured(sample.where("half = 1"), first).collect()
    y = np.array([r["toxic"] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return Model({}, None)
    weights = fit(np.array([r["x"] for r in rows]), y)
    return Model(_with_ordinary(sample, choose(both, base, tried)), weights)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Scorer:
    """Scores texts, 0 to 1; remembers the words it has seen."""

    def __init__(self, lexicon: dict[str, float], weights: np.ndarray | None):
        self.automaton, self.weights, self.known = Automaton(lexicon), weights, {}

    def __call__(self, text: str | None) -> float:
        if self.weights is None:
            return 0.0
        if len(self.known) > 600_000:
            self.known.clear()
        z = float(np.dot(features(text, self.automaton, self.known), self.weights))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def score_column(model: Model, text_col: str = "text") -> F.Column:
    """The score as a column of the rows it is selected from."""
    import pandas as pd

    lexicon, weights = model.lexicon, model.weights

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(lexicon, weights)
        for batch in batches:
            yield pd.Series([scorer(text) for text in batch], dtype=float)

    return F.pandas_udf(score, "double")(F.col(text_col))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted."""
    lexicon, weights = model.lexicon, model.weights

    def rows(it):
        scorer = Scorer(lexicon, weights)
        for doc_id, out, text in it:
            score = scorer(text)
            yield doc_id, out, score, int(score >= 0.5)

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col).cast("long")), F.col(text_col))
    return map_rows(own, rows, "doc_id long, held_out boolean, score double, predicted int")
