"""Package names and versions as comparable columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONCRETE = r"^\d+\.\d+\.\d+"
# The published grammar of PyPI versions, and the stage words in their order.
_PYPI = (
    r"(?i)^\s*v?(?:(\d+)!)?(\d+(?:\.\d+)*)(?:[-_.]?(a|b|c|rc|alpha|beta|pre|preview)[-_.]?(\d*))?"
    r"(?:-(\d+)|[-_.]?(post|rev|r)[-_.]?(\d*))?(?:[-_.]?(dev)[-_.]?(\d*))?(?:\+.*)?\s*$"
)
_STAGES = {"a": "0", "alpha": "0", "b": "1", "beta": "1", "c": "2", "rc": "2", "pre": "2", "preview": "2"}


def canonical_name(name: Column, ecosystem: Column) -> Column:
    """PyPI names compare after normalization, npm names as they are."""
    return F.when(ecosystem == "PyPI", F.lower(F.regexp_replace(name, r"[-_.]+", "-"))).otherwise(name)


def _number(digits: Column) -> Column:
    """Text that sorts like a number of any length: how many digits, then the digits."""
    plain = F.regexp_replace(digits, r"^0+", "")
    return F.concat(F.lpad(F.length(plain).cast("string"), 4, "0"), plain)


def _release(numbers: Column) -> Column:
    """Keys of the dotted numbers; zeros at the end do not count."""
    return F.transform(F.filter(F.split(F.regexp_replace(numbers, r"(?:\.0+)+$", ""), r"\."), lambda p: p != ""), _number)


def _key(epoch: Column, release: Column, stage: Column) -> Column:
    return F.struct(epoch.alias("epoch"), release.alias("release"), stage.alias("stage"))


def _pypi_key(version: Column) -> Column:
    """Epoch, release, then pre-release, post-release and development marks."""
    group = lambda i: F.regexp_extract(version, _PYPI, i)
    word, dev = F.lower(group(3)), group(8) != ""
    post = (group(5) != "") | (group(6) != "")
    rank = F.lit("2")
    for name, value in _STAGES.items():
        rank = F.when(word == name, F.lit(value)).otherwise(rank)
    # A development release of a final one comes before all its pre-releases; no mark is after them.
    pre = F.when(word != "", F.concat(F.lit("1"), rank, _number(group(4)))).when(dev & ~post, F.lit("0")).otherwise(F.lit("2"))
    after = F.when(post, F.concat(F.lit("1"), _number(F.concat(group(5), group(7))))).otherwise(F.lit("0"))
    stage = F.array(pre, after, F.when(dev, F.concat(F.lit("0"), _number(group(9)))).otherwise(F.lit("1")))
    return _key(_number(group(1)), _release(group(2)), stage)


def _semver_key(version: Column) -> Column:
    """Release, then the identifiers of a pre-release: numbers before words, fewer before more."""
    numbers = F.regexp_extract(version, r"^\s*[vV=]?\s*(\d+(?:\.\d+)*)", 1)
    tail = F.regexp_extract(version, r"^\s*[vV=]?\s*\d+(?:\.\d+)*-?([^+\s]*)", 1)
    parts = F.transform(
        F.split(tail, r"\."), lambda p: F.when(p.rlike(r"^\d+$"), F.concat(F.lit("0"), _number(p))).otherwise(F.concat(F.lit("1"), p))
    )
    return _key(F.lit("0000"), _release(numbers), F.when(tail == "", F.array(F.lit("2"))).otherwise(parts))


def version_key(version: Column, ecosystem: Column | None = None) -> Column:
    """A struct that sorts like the version under its ecosystem's rules; numbers of any length.

    PyPI versions that its grammar does not take, and all other ecosystems, compare by semantic
    versioning; build metadata and local parts do not count.
    """
    if ecosystem is None:
        return _semver_key(version)
    return F.when((ecosystem == "PyPI") & version.rlike(_PYPI), _pypi_key(version)).otherwise(_semver_key(version))


def sort_key(version: Column, ecosystem: Column) -> Column:
    """:func:`version_key` as one text that sorts by its bytes; no version's key is empty."""
    plain = F.translate(version, "\x00\x01", "")
    key = version_key(plain, ecosystem)
    # A part ends below every character, and parts of one list are set apart just above that: fewer come before more.
    return F.get(
        F.transform(F.array(key), lambda k: F.concat(k["epoch"], F.lit("\x00"), F.array_join(k["release"], "\x01"), F.lit("\x00"), F.array_join(k["stage"], "\x01"), F.lit("\x00"))), 0
    )
