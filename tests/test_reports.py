"""SARIF rules as rows."""

import json
import time

from codewarden.sources import reports


def _read(spark, documents):
    rows = [("r", i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(documents)]
    return reports.sarif(spark.createDataFrame(rows, "repo string, doc bigint, json string"))


def _run(rules, results):
    return {"tool": {"driver": {"rules": rules}}, "results": results}


def test_the_last_rule_of_an_id_holds_inside_its_run(spark):
    score = lambda x: {"security-severity": x}
    one = _run([{"id": "a", "properties": score("9.5")}, {"id": "b", "helpUri": "h"}, {"id": "a", "properties": score(4.5), "helpUri": "u"}, {"properties": score("7.1")}, 3],
               [{"ruleId": "a"}, {"ruleId": "b", "level": "error"}, {"ruleId": "None"}, {"ruleId": ""}, {"ruleId": "c", "level": "note"}])
    two = _run([{"id": "c", "properties": score("NaN")}], [{"ruleId": "a", "level": "warning"}, {"ruleId": "c", "level": "error"}])
    found = _read(spark, [{"runs": [one, two]}, {"runs": "x"}, {"runs": [{"results": [{"ruleId": "a"}]}]}, "[]", "{"]).collect()
    got = sorted((r.emit_seq.file_seq, r.emit_seq.part, r.emit_seq.a, r.title, r.severity, list(r.references)) for r in found)
    assert got == [
        (0, 0, 0, "a", "MEDIUM", ["u"]), (0, 0, 1, "b", "HIGH", ["h"]), (0, 0, 2, "None", "HIGH", []), (0, 0, 3, "codeql-rule", "MEDIUM", []), (0, 0, 4, "c", "LOW", []),
        (0, 1, 0, "a", "MEDIUM", []), (0, 1, 1, "c", "HIGH", []), (2, 0, 0, "a", "MEDIUM", []),
    ]


def test_very_many_rules_of_one_run(spark):
    n = 20_000
    rules = [{"id": f"q{i % (n // 2)}", "properties": {"security-severity": "9.9" if i >= n // 2 else "0.1"}} for i in range(n)]
    results = [{"ruleId": f"q{i % (n // 2)}"} for i in range(n)]
    start = time.time()
    counts = {r.severity: r["count"] for r in _read(spark, [{"runs": [_run(rules, results)]}]).groupBy("severity").count().collect()}
    assert counts == {"CRITICAL": n} and time.time() - start < 40


def test_a_report_is_parsed_once_and_no_array_function_takes_schemas(spark):
    """A schema of a value is all of the value, so one per level reads a report again at each."""
    plan = reports.sarif_rows(spark.createDataFrame([], "repo string, doc bigint, json string"))._jdf.queryExecution().optimizedPlan().toString()
    cuts = [line for line in plan.splitlines() if "Generate" in line]
    assert len(cuts) == 2 and not any("chemaofvariant" in line.lower().replace("_", "") for line in cuts)
    assert plan.lower().replace("_", "").count("parsejson") == 1


def test_entries_of_other_types_lose_no_neighbour(spark):
    place = lambda **x: [{"physicalLocation": x}]
    results = [5, {"ruleId": 3}, {"locations": {"0": 1}}, {"locations": place(region={"startLine": 4, "snippet": "x"}, artifactLocation=[])}, {"message": "m"},
               {"locations": [7, *place(region={"startLine": 9})]}, {"message": {"text": " t "}, "locations": place(region={"startLine": 6, "snippet": {"text": " s "}}, artifactLocation={"uri": "u"})}]
    found = _read(spark, [{"runs": [1, _run({"id": "a"}, results), {"tool": [], "results": {}}]}]).collect()
    got = sorted((r.emit_seq.a, r.title, r.file, r.line, r.snippet) for r in found)
    rest = ("codeql-rule", ".")
    assert got == [(0, *rest, 1, ""), (1, *rest, 1, ""), (2, *rest, 4, ""), (3, *rest, 1, ""), (4, *rest, 1, ""), (5, "codeql-rule", "u", 6, "s")]
