"""Versions as sortable texts, and spans against the rule of the latest event."""

import random
import time

from pyspark.sql import functions as F

from codewarden.functions import versions as V
from codewarden.operators import deps

EVENT = "struct<introduced:string,fixed:string,last_affected:string>"
PACKAGES = f"vuln_id string, ecosystem string, name string, versions array<string>, ranges array<struct<type:string,events:array<{EVENT}>>>"


def _advisories(spark, rows):
    package = F.struct("ecosystem", "name").alias("package")
    made = spark.createDataFrame(rows, PACKAGES).select(
        F.col("vuln_id").alias("id"), F.lit("s").alias("summary"), F.lit("d").alias("details"), F.struct(F.lit("LOW").alias("severity")).alias("database_specific"),
        F.array(F.struct(package, "versions", "ranges")).alias("affected"),
    )
    return spark.createDataFrame(made.collect(), deps.ADVISORIES_DDL)


def _version(rnd, ecosystem):
    release = ".".join(str(rnd.choice([0, 0, 1, 2, 9, 10, 100])) for _ in range(rnd.randint(1, 4)))
    if ecosystem == "npm":
        return rnd.choice(["", "v"]) + release + rnd.choice(["", "", "-alpha", "-alpha.1", "-alpha.beta", "-1", "-rc.1+b.2", "-a\x01b"])
    return rnd.choice(["", "", "1!"]) + release + rnd.choice(["", "", "a1", "rc2", ".dev1", ".post1", "-2", "b1.dev3", "+local", "-odd-one"])


def test_texts_sort_like_keys(spark):
    rnd = random.Random(1)
    rows = [(eco, _version(rnd, eco), _version(rnd, eco)) for eco in ("npm", "PyPI") for _ in range(1500)]
    df = spark.createDataFrame(rows, "e string, a string, b string").select("*", *[
        F.when(f(F.col("a"), F.col("e")) < f(F.col("b"), F.col("e")), -1).when(f(F.col("a"), F.col("e")) == f(F.col("b"), F.col("e")), 0).otherwise(1).alias(name)
        for name, f in (("by_key", V.version_key), ("by_text", V.sort_key))
    ])
    wrong = [r for r in df.where("by_key <> by_text").collect() if "\x01" not in r.a + r.b]
    assert not wrong, wrong[:3]


def test_spans_are_the_latest_event(spark):
    rnd = random.Random(7)
    rows = []
    for n in range(120):
        eco = rnd.choice(["npm", "PyPI"])
        ranges = []
        for _ in range(rnd.randint(0, 3)):
            events = [{rnd.choice(["introduced", "introduced", "fixed", "fixed", "last_affected"]): rnd.choice([_version(rnd, eco), "0"])} for _ in range(rnd.randint(0, 5))]
            ranges.append((rnd.choice(["ECOSYSTEM", "SEMVER", "GIT", None]), [(e.get("introduced"), e.get("fixed"), e.get("last_affected")) for e in events]))
        rows.append((f"v{n}", eco, f"p{n % 9}", rnd.choice([None, [], [_version(rnd, eco) for _ in range(3)]]), ranges))
    advisories = _advisories(spark, rows)
    wanted = [(eco, f"p{n % 9}", _version(rnd, eco)) for eco in ("npm", "PyPI") for n in range(400)]
    wanted += [(eco, name, v) for _, eco, name, vs, _ in rows for v in (vs or [])]
    wanted = [w for w in wanted if "\x01" not in w[2]]
    dependencies = spark.createDataFrame(wanted, "ecosystem string, name string, version string")
    got = sorted(map(tuple, deps.match(dependencies, advisories).collect()))
    pairs = dependencies.withColumn("key", V.canonical_name(F.col("name"), F.col("ecosystem"))).join(deps.affected_packages(advisories), ["ecosystem", "key"])
    rule = pairs.where(deps.is_affected(F.col("version"), F.col("ecosystem"), F.col("versions"), F.col("ranges")))
    assert got == sorted(map(tuple, rule.select("ecosystem", "key", "version", "vuln_id").distinct().collect())) and len(got) > 100


def test_many_versions_and_ranges_of_one_package(spark):
    rows = [(f"v{n}", "npm", "p", None, [("SEMVER", [(f"{n % 400}.{n % 7}.0", None, None), (None, f"{n % 400}.{n % 7}.3", None)])]) for n in range(2000)]
    advisories = _advisories(spark, rows)
    versions = spark.range(10_000).select(F.lit("npm").alias("ecosystem"), F.lit("p").alias("name"), F.format_string("%d.%d.%d", F.col("id") % 400, F.floor(F.col("id") / 400) % 5, F.floor(F.col("id") / 2000)).alias("version"))
    start = time.time()
    found = deps.match(versions, advisories).count()
    assert time.time() - start < 40
    def minor(n):
        return n % 400, n % 7
    have = [(i % 400, i // 400 % 5, i // 2000) for i in range(10_000)]
    by_minor = {}
    for n in range(2000):
        by_minor[minor(n)] = by_minor.get(minor(n), 0) + 1
    assert found == sum(by_minor.get((a, b), 0) for a, b, c in set(have) if c < 3)
