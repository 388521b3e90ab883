"""Taint verdicts and sinks of Python modules, as expressions over the tables of their syntax."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codewarden.operators.closure import ROOT, reached_names
from codewarden.operators.facts_py import RETURN
from codewarden.rules import taint as T
from codewarden.rules.injection import INDEX


def _is_source(n: Column) -> Column:
    """Attributes of a request, program arguments, the environment, and console input."""
    dotted = F.concat_ws(".", n["owner"], n["text"])
    attribute = (n["root"] == T.PY_SOURCE_ROOT) | dotted.isin(*T.PY_SOURCE_ATTRIBUTES)
    call = F.when(n["kind"] == "Call:Attribute", dotted.isin(*T.PY_SOURCE_CALLS)).when(n["kind"] == "Call:Name", n["text"].isin(*T.PY_SOURCE_CALLS))
    return F.coalesce(F.when(n["kind"] == "Attribute", attribute).otherwise(call), F.lit(False))


def _builds_text(inner: Column) -> Column:
    """A text literal in a chain of operators that begins with + or %, a filled-in f-string, or a call of format."""
    top = F.get(inner, 0)
    text = lambda n: (n["kind"] == "JoinedStr") | ((n["kind"] == "Constant") & (n["text"] == "str"))
    chained = F.array_contains(F.transform(inner, lambda n, i: (n["chain"] == i) & F.coalesce(text(n), F.lit(False))), True)
    return (
        F.when(top["kind"] == "BinOp", top["text"].isin("Add", "Mod") & chained)
        .when(top["kind"] == "JoinedStr", F.exists(inner, lambda n: n["kind"] == "FormattedValue"))
        .otherwise((top["kind"] == "Call:Attribute") & (top["text"] == "format"))
    )


def _expression(nodes: Column, span: Column) -> Column:
    """struct<src,call,const,builds,fstring,names,calls> of the expression at a span."""

    def traits(inner: Column) -> Column:
        return F.struct(
            F.exists(inner, _is_source).alias("src"),
            F.exists(inner, lambda n: n["kind"].startswith("Call")).alias("call"),
            F.forall(inner, lambda n: n["kind"].isin("Constant", "List", "Tuple")).alias("const"),
            F.coalesce(_builds_text(inner), F.lit(False)).alias("builds"),
            (F.get(inner, 0)["kind"] == "JoinedStr").alias("fstring"),
            F.transform(F.filter(inner, lambda n: n["kind"] == "Name"), lambda n: n["text"]).alias("names"),
            F.transform(F.filter(inner, lambda n: n["kind"] == "Call:Name"), lambda n: n["text"]).alias("calls"),
        )

    return F.get(F.transform(F.array(F.slice(nodes, span["at"] + 1, span["n"])), traits), 0)


def _from_root(src: Column) -> Column:
    return F.when(src, F.array(F.lit(ROOT))).otherwise(F.array().cast("array<string>"))


def judged(syntax: Column) -> Column:
    """struct<functions,calls,assigns,edges>: the calls with the traits of their arguments, the assignments with those
    of their values, and the edges along which input travels (from ``srcs`` to ``dst``): 2 argument to parameter, 3 body
    to return value. No inner function reads a variable of an outer one: Spark would not take such input to Python."""
    nodes = syntax["nodes"]

    def fields(value: Column, *names: str) -> list[Column]:
        return [value[name].alias(name) for name in names]

    def call(c: Column) -> Column:
        args = F.transform(c["args"], lambda span: _expression(nodes, span))
        return F.struct(*fields(c, "seq", "line", "name", "bare", "recv", "root"), args.alias("args"), *fields(c, "has_kw", "shell_true", "safe_loader"))

    def feed(f: Column) -> Column:
        srcs = F.get(F.transform(F.array(_expression(nodes, f["value"])), lambda e: F.concat(_from_root(e["src"]), e["names"])), 0)
        return F.struct(*fields(f, "step", "ord"), srcs.alias("srcs"), f["dst"].alias("dst"))

    valued = F.transform(syntax["assigns"], lambda a: F.struct(a["name"].alias("name"), _expression(nodes, a["value"]).alias("value")))
    assigns = F.transform(valued, lambda a: F.struct(a["name"].alias("name"), *fields(a["value"], "src", "const", "calls")))
    calls, edges = F.transform(syntax["calls"], call), F.transform(syntax["feeds"], feed)
    whole = F.struct(syntax["functions"].alias("functions"), calls.alias("calls"), assigns.alias("assigns"), edges.alias("edges"))
    return F.when(syntax["functions"].isNotNull(), whole)


def reached(facts: Column) -> Column:
    """Names (and returns, prefixed) that untrusted input can reach, of judged facts."""

    def into(a: Column) -> Column:
        srcs = F.concat(_from_root(a["src"]), F.transform(a["calls"], lambda f: F.concat(F.lit(RETURN), f)))
        return F.struct(srcs.alias("srcs"), a["name"].alias("dst"))

    handed = F.transform(facts["edges"], lambda e: F.struct(e["srcs"].alias("srcs"), e["dst"].alias("dst")))
    return reached_names(F.concat(F.transform(facts["assigns"], into), handed))


def tainted_names(syntax: Column) -> Column:
    """:func:`reached` of a module's syntax."""
    return reached(judged(syntax))


def constant_names(facts: Column, tainted: Column) -> Column:
    """Names that only ever receive literals."""

    def names(keep) -> Column:
        return F.transform(F.filter(facts["assigns"], keep), lambda a: a["name"])

    literal = names(lambda a: a["const"] & ~a["src"])
    other = names(lambda a: ~a["const"] | a["src"])
    return F.array_except(F.array_except(literal, other), tainted)


def verdict(exprs: Column, tainted: Column, constants: Column) -> Column:
    """True: input reaches an expression; False: constants only; NULL: anything else, or none."""
    marks = F.transform(
        exprs,
        lambda e: F.when(e["src"] | F.arrays_overlap(e["names"], tainted), F.lit("T"))
        .when(e["call"], F.lit("N"))
        .when(F.size(F.array_except(e["names"], constants)) == 0, F.lit("F"))
        .otherwise(F.lit("N")),
    )
    return (
        F.when(F.array_contains(marks, "T"), F.lit(True))
        .when(F.array_contains(marks, "N") | (F.size(marks) == 0), F.lit(None).cast("boolean"))
        .otherwise(F.lit(False))
    )


def sink_hits(facts: Column, tainted: Column, constants: Column) -> Column:
    """array<struct<rule,line,part,a,b,c,reachable>> in the order of the calls in the module."""
    none = F.lit(None).cast("boolean")

    def reach(exprs: Column) -> Column:
        return verdict(exprs, tainted, constants)

    def per_call(c: Column) -> Column:
        args, name = c["args"], c["name"]
        n_args = F.size(args)
        first = F.slice(args, 1, 1)
        all_const = F.forall(args, lambda e: e["const"])
        arg0 = F.get(args, 0)

        def hit(check: int, when: Column, title: str, reachable: Column, alt: tuple | None = None) -> Column:
            rule = F.lit(INDEX[title]) if alt is None else F.when(alt[0], F.lit(INDEX[alt[1]])).otherwise(
                F.lit(INDEX[title])
            )
            return F.when(
                F.coalesce(when, F.lit(False)),
                F.struct(
                    rule.alias("rule"),
                    c["line"].alias("line"),
                    F.lit(0).alias("part"),
                    c["seq"].cast("bigint").alias("a"),
                    F.lit(check).cast("bigint").alias("b"),
                    F.lit(0).cast("bigint").alias("c"),
                    reachable.alias("reachable"),
                ),
            )

        def gated(check: int, when: Column, title: str, exprs: Column) -> Column:
            value = reach(exprs)
            return hit(check, when & (n_args > 0) & value, title, value)

        dynamic_eval = c["bare"] & name.isin("eval", "exec") & ~((n_args > 0) & ~c["has_kw"] & all_const)
        subprocess_call = (c["recv"] == "subprocess") | (c["bare"] & name.isin(*T.PY_SUBPROCESS_NAMES))
        constant_command = (n_args == 0) | arg0["const"]
        unsafe_family = name.isin(*T.PY_DESERIALIZE_METHODS) & F.coalesce(
            c["root"].isin(*T.PY_DESERIALIZE_RECEIVERS), F.lit(False)
        )
        checks = [
            hit(0, dynamic_eval, "exec() usage", reach(args), (name == "eval", "eval() usage")),
            hit(
                1,
                (c["recv"] == "os") & (name == "system"),
                "os.system() call",
                reach(args),
                ((n_args > 0) & all_const, "os.system() with constant command"),
            ),
            hit(
                2,
                F.coalesce(subprocess_call, F.lit(False)) & c["shell_true"],
                "shell=True with dynamic command",
                F.when(n_args > 0, reach(first)).otherwise(none),
                (constant_command, "shell=True with constant command"),
            ),
            hit(
                3,
                name.isin(*T.PY_SQL_SINKS) & arg0["builds"],
                "SQL string concatenation",
                reach(first),
                (arg0["fstring"], "SQL f-string query"),
            ),
            gated(
                4,
                name.isin(*T.PY_PATH_SINKS),
                "Path traversal",
                F.when((name == "send_from_directory") & (n_args > 1), F.slice(args, 2, 1)).otherwise(first),
            ),
            gated(
                5,
                (c["bare"] & (name == "urlopen"))
                | (~c["bare"] & name.isin(*T.PY_SSRF_METHODS) & c["root"].isin(*T.PY_SSRF_RECEIVERS)),
                "Server-side request forgery (SSRF)",
                first,
            ),
            gated(6, ~c["bare"] & unsafe_family, "Insecure deserialization", first),
            hit(
                7,
                ~c["bare"]
                & (n_args > 0)
                & (name == "load")
                & (c["recv"] == "yaml")
                & ~c["safe_loader"],
                "Insecure deserialization",
                none,
            ),
            gated(8, name.isin(*T.PY_REDIRECT_NAMES), "Open redirect", first),
        ]
        return F.array_compact(F.array(*checks))

    return F.flatten(F.transform(facts["calls"], per_call))
