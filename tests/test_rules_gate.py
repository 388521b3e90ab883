"""User rules reach the worker only where they can match, and lose no match."""

import random
import re

import pytest
from pyspark.sql import functions as F

from codewarden.functions.literals import Occurring, required
from codewarden.operators import custom
from codewarden.plans import file_pass

CASES = {
    "eval": {"eval"}, r"\bconst \w+": {"const "}, r"a*": None, r"(?:foo|ba[rz])x": {"foo", "ba"}, r"(foo)?bar+": {"ba"}, r"(?i)Token": {"to", "en"}, r"(?i)kiss": None,
    r"(?:abc){2,}d": {"abc"}, r"x(?i:abc)yz": {"yz"}, r"(?=abc)x": None, r"[ab]c": None, r"(?>abc)": {"abc"}, r"ab|c": None, r"(?x) a b c": {"abc"}, r"que(?=que)": {"que"},
    r'(?P<quote>")[0-9a-f]{32}(?P=quote)': None, r"ab??c": None, r"(": None, "é ß": {"é ß"},
}


@pytest.mark.parametrize("pattern", CASES)
def test_required_literals(pattern):
    group, _ = required(pattern)
    if CASES[pattern] is None:
        assert group is None
    else:
        assert group is not None and group <= CASES[pattern] | {"en", "to"} and group


def test_every_match_holds_a_literal():
    rnd = random.Random(2)
    patterns = [p for p in CASES if p != "("] + ["(?i)pass(word|wd)?\\s*=", "(?i)straße", "a(b(c|d)+e)+", "(?:x|yy|zzz)+end"]
    words = ["eval", "const a", "foox", "barx", "bazx", "TOKEN", "KISS", "kiſs", "abcabcd", "xABCyz", "queque", "abc", "PASSWD =", "password=", "STRASSE", "straße", "abcde", "zzzend", "é ß", "\n"]
    for _ in range(3000):
        text = "".join(rnd.choice([*words, " ", "b", "c"]) for _ in range(rnd.randint(0, 6)))
        for pattern in patterns:
            group, folded = required(pattern)
            if group and re.search(pattern, text):
                assert any(x in (text.lower() if folded else text) for x in group), (pattern, text)


def test_occurring_by_automaton_and_by_search():
    literals = ["ab", "abc", "bc", "x y", "é", "zz", "a", "b", "c", "cab"]
    for text in ("", "abcab", "x yé", "zzz", "nothing"):
        want = {x for x in literals if x in text}
        assert Occurring(literals).of(text) == want and Occurring(literals[:3]).of(text) == want & set(literals[:3])
    assert Occurring([]).of("x") == set()


RULES = [
    custom.CustomRule("plain", r"corp[.]internal", "m", "LOW", suffixes=(".py",)),
    custom.CustomRule("low", r"(?i)TODO:\s", "m", "LOW", suffixes=(".js", ".py")),
]


def test_only_possible_files_are_sent(spark, files_of):
    texts = {"a.py": "corp.internal", "b.py": "x = 1", "c.js": "corp.internal", "d.js": "// todo: x", "e.md": "todo: corp.internal", "f.py": None, "g.py": ""}
    files = files_of(list(("r", p, t) for p, t in texts.items()))
    from codewarden.functions import text as X

    gated = files.withColumn("_suffix", X.suffix_of(F.col("path"))).where(custom.can_match(RULES))
    assert {r.path for r in gated.collect()} == {"a.py", "d.js"}
    found = file_pass.findings(files, ("custom",), RULES)
    assert sorted((r.file, r.title) for r in found.collect()) == [("a.py", "plain"), ("d.js", "low")]


def test_many_rules_lose_nothing(files_of):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcde") for _ in range(4)) for _ in range(150)]
    rules = [custom.CustomRule(f"r{i}", f"{w}\\d*" if i % 3 else f"(?i){w}", "m", "LOW", suffixes=(".py",) if i % 2 else None) for i, w in enumerate(words)]
    texts = {f"f{n}.{rnd.choice(['py', 'js'])}": " ".join(rnd.choice(words).upper() if rnd.random() < 0.2 else rnd.choice(words) for _ in range(n)) for n in range(30)}
    got = sorted((r.file, r.title) for r in file_pass.findings(files_of(texts), ("custom",), rules).collect())
    want = sorted((p, r.id) for p, t in texts.items() for r in rules if r.suffixes is None or p.endswith(".py") for _ in re.finditer(r.pattern, t))
    assert got == want and want
