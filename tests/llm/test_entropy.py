import hashlib
import math
import random
import re
import time

from codewarden.llm import entropy


def _brute(text, start, end, width, bits):
    """Windows by recount."""
    out = []
    for lo in range(start, end - width + 1):
        part = text[lo : lo + width]
        h = -sum(part.count(c) / width * math.log2(part.count(c) / width) for c in set(part))
        if h >= bits - 1e-12:
            if out and lo <= out[-1][1]:
                out[-1] = (out[-1][0], lo + width)
            else:
                out.append((lo, lo + width))
    return out


def test_incremental_counts_are_recounts():
    rnd = random.Random(1)
    for n in range(200):
        text = "".join(rnd.choice("abcdef0123456789ABCDEFGHIJ"[: rnd.randint(2, 26)]) for _ in range(rnd.randint(0, 90)))
        for bits in (2.0, 3.0, 3.9):
            assert entropy.windows(text, 2, len(text), 24, bits) == _brute(text, 2, len(text), 24, bits)


KEY = "q7R2xL9vT4bN8mK1zW6pJ3dH5"


def test_kinds_and_allow_list():
    kinds = lambda t: [k for k, _, _ in entropy.spans(t)]
    assert kinds(f"see {KEY}Yc0Qf end") == ["entropy_base64"]
    assert kinds("pass" + "word = " + KEY) == ["assign"]
    assert kinds("AKIA" + "ABCDEFGH12345678") == ["access"]
    assert kinds("id " + hashlib.sha1(b"x").hexdigest()) == ["hex"]
    assert kinds("id " + hashlib.sha1(b"x").hexdigest().upper()) == ["entropy_hex"]
    assert kinds("123e4567-e89b-12d3-a456-426614174000 " + "xyz123" * 8 + " thequickbrownfoxjumpsoverthelazydog org.apache.spark2.sql.functions4.column") == []


def test_what_a_known_span_leaves_of_a_run():
    rnd = random.Random(3)
    tail = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(40))
    access, hexa = "AKIA" + "ABCDEFGH12345678", hashlib.md5(b"x").hexdigest()
    for text, kind, n in ((f"{access}/{tail}", "access", 20), (f"{hexa}-{tail[:30]}", "hex", 32)):
        found = entropy.spans(text)
        assert found[0] == (kind, 0, n) and found[1][0] == "entropy_base64" and found[-1][2] == len(text), found
        covered = {i for _, a, b in found for i in range(a, b)}
        assert set(range(len(text))) - covered <= {n}
        base = entropy.base_spans(text)
        assert all(b <= lo or hi <= a for _, lo, hi in base for k, a, b in found if k.startswith("entropy"))
    assert [k for k, _, _ in entropy.spans("my_client_pass" + "word=" + KEY)] == ["assign"]
    # Both sides of a known span.
    text = f"{tail}/{access}/{tail[::-1]}"
    assert [k for k, _, _ in entropy.spans(text)] == ["entropy_base64", "access", "entropy_base64"]


def _by_all_spans(text):
    """Entropy spans with every span so far looked at for each window."""
    out, taken = [], [(a, b) for _, a, b in entropy.base_spans(text)]
    for m in entropy.CANDIDATE.finditer(text):
        if any(p.fullmatch(m[0]) for p in entropy.ALLOW):
            continue
        for kind, characters, width, bits in entropy.CLASSES:
            for run in characters.finditer(text, m.start(), m.end()):
                for lo, hi in entropy.windows(text, run.start(), run.end(), width, bits):
                    if not entropy._mixed(text[lo:hi]):
                        continue
                    free = [i for i in range(lo, hi) if not any(a <= i < b for a, b in taken)]
                    rest = [(free[i], free[j]) for i, j in _stretches(free)]
                    rest = [(a, b + 1) for a, b in rest]
                    if rest != [(lo, hi)]:
                        rest = [(a, b) for a, b in rest if not any(p.fullmatch(text[a:b].strip("+/_.=-")) for p in entropy.ALLOW) and entropy._mixed(text[a:b])]
                    out += [(kind, a, b) for a, b in rest]
                    taken += rest
    return out


def _stretches(places):
    cuts = [i for i in range(1, len(places)) if places[i] != places[i - 1] + 1]
    return list(zip([0, *cuts], [*(c - 1 for c in cuts), len(places) - 1])) if places else []


def test_spans_are_those_of_looking_at_all():
    rnd = random.Random(8)
    hexa, wide = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    for _ in range(150):
        parts = []
        for _ in range(rnd.randint(1, 6)):
            kind = rnd.randint(0, 4)
            parts.append(["".join(rnd.choice(hexa) for _ in range(rnd.randint(20, 60))), "".join(rnd.choice(wide) for _ in range(rnd.randint(10, 60))), "AKIA" + "ABCDEFGH12345678", "tok" + "en=" + "".join(rnd.choice(wide) for _ in range(12)), "word"][kind])
            parts.append(rnd.choice(["/", "-", " ", ".", "_", ""]))
        text = "".join(parts)
        assert entropy.entropy_spans(text, entropy.base_spans(text)) == _by_all_spans(text), text


def test_very_many_secrets_of_one_text_are_linear():
    rnd = random.Random(9)
    one = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(40))
    took = []
    for n in (5_000, 20_000):
        text = " ".join("AKIA" + "ABCDEFGH12345678/" + one() for _ in range(n))
        start = time.process_time()
        assert len(entropy.spans(text)) >= 2 * n - n // 50
        took.append(time.process_time() - start)
    assert took[1] < 8 * took[0]


def test_whole_texts_against_the_contract(spark, docs_of, odd, prose):
    secret = "TOK" + "EN: '" + KEY + "'"
    rows = [*odd, (20, secret), (21, "x " * 60_000 + secret + " ſecret=" + "a" * 9 + " api" + "key=short to" + "ken=" + "a" * 8), (22, "0" * 31 + " " + "f" * 40 + "é" + "a" * 32)]
    got = {(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in entropy.scan(docs_of(rows)).collect()}
    want = set()
    for i, text in rows:
        text, found = text or "", []
        for at, (kind, pattern, flags, group, least) in enumerate([
            ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 8),
            ("access", "AKIA[A-Z0-9]+", 0, 0, 16),
            ("hex", "[0-9a-f]+", 0, 0, 32),
        ]):
            found += [(m.start(), at, kind, m.end()) for m in re.finditer(pattern, text, flags) if len(m[group]) >= least]
        line = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))
        want.add((i, *(sum(f[2] == k for f in found) for k in ("assign", "access", "hex")), hashlib.sha256(line.encode()).hexdigest()))
    assert got == want
    assert entropy.scan(docs_of(rows)).count() == len(rows)


def test_redacted(docs_of):
    texts = [r.text for r in entropy.redacted(docs_of([(1, f"a tok" + f"en={KEY} b"), (2, None), (3, "clean")])).orderBy("doc_id").collect()]
    assert texts == ["a [SECRET] b", None, "clean"]
    both = "AKIA" + "ABCDEFGH12345678/" + KEY + "Yc0QfUs4Vg7Xe"
    assert [r.text for r in entropy.redacted(docs_of([(1, f"a {both} b")])).collect()] == ["a [SECRET][SECRET] b"]


def test_empty_table(docs_of):
    assert entropy.scan(docs_of([])).count() == 0 and entropy.redacted(docs_of([])).count() == 0
