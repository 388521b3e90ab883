"""Lockfile entries as rows against the plain reading of one text."""

import json
import random

from codewarden.sources import manifests


def _version(rnd):
    return rnd.choice(["1.0.0", "1.0.0", "2.3.4-rc.1", "10.20.30", "file:../x", "1.0", "", None, 3, {"a": 1}])


def _nested(rnd, depth):
    out = {}
    for _ in range(rnd.randint(0, 3)):
        entry = {"version": _version(rnd)}
        if depth and rnd.random() < 0.6:
            entry["dependencies"] = _nested(rnd, depth - 1)
        if rnd.random() < 0.3:
            entry["requires"] = {"a": "1.0.0"}
        out[rnd.choice(["a", "b", "@s/c", 'quo"te', "back\\slash", "ü", "d e"])] = rnd.choice([entry, entry, entry, "text"])
    return out


def test_rows_are_the_plain_reading(spark):
    rnd, texts = random.Random(12), []
    for n in range(150):
        if n % 2:
            packages = {rnd.choice(["", "node_modules/a", "node_modules/x/node_modules/a", "node_modules/@s/c", 'node_modules/q"', "lib"]): {"version": _version(rnd), **({"link": True} if rnd.random() < 0.2 else {})} for _ in range(5)}
            document = {"packages": packages, "dependencies": _nested(rnd, 1)}
        else:
            document = {"name": "x", "version": "9.9.9", "dependencies": _nested(rnd, 3)}
        texts.append(json.dumps(document, indent=rnd.choice([None, 2, 1]), ensure_ascii=rnd.random() < 0.5))
    texts += ["", "[]", "{", "{}", '{"dependencies": 3}', None, '{"dependencies": {"a": {"version": "1.0.0"}}}\r\n', '{"dependencies":\r{"a":  {"version": "1.0.0"}}}']
    files = spark.createDataFrame([("r", f"{i}.json", t) for i, t in enumerate(texts)], "repo string, path string, content string")
    got = {}
    for r in manifests.lock_entries(files.repartition(3)).orderBy("path", "ord").collect():
        got.setdefault(r.path, []).append((r.name, r.version, r.line, r.raw))
    want = {f"{i}.json": [(e["name"], e["version"], e["line"], e["raw"]) for e in manifests._parse_lock(t)] for i, t in enumerate(texts)}
    assert got == {path: rows for path, rows in want.items() if rows} and len(got) > 80
