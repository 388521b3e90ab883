"""Near-duplicate documents: MinHash with tensored banding, links confirmed on full shingle sets.

A signature has two small collections of sub-bands, each of ``SUB`` hashes of ``ROWS`` minima. A table
key is one sub-band of each collection, so ``SUB * SUB`` tables cost ``2 * SUB * ROWS`` minima instead
of ``SUB * SUB * 2 * ROWS``. A pair of similarity ``s`` meets in some table unless a whole collection
misses: 2 * (1 - s**ROWS)**SUB, 4e-4 at 0.85.

Texts with equal sets are one class, represented by the smallest id. In a bucket every member is compared
with the smallest one; buckets whose members are then connected need nothing more. In the others, each pair
across components meets in its first common bucket only; ``BITS`` one-bit minima, made for the documents of
those buckets, tell the pairs that can be alike enough, and all of these are confirmed on the full sets.

Defined results: a null, empty or blank text has no shingles and is linked with nothing; a row with a null
id takes part in no link and keeps a null component; repeated rows are listed as often as they come, and rows
of one id with different texts are one node that is linked through each of them; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codewarden.llm.components import components
from codewarden.llm.text import map_rows, mix, rolling, word_hashes
from codewarden.session import cut_lineage

SUB, ROWS = 9, 3
MINIMA = 2 * SUB * ROWS
BITS = 1024
_U = np.uint64


def _shingles(text: str | None, width: int) -> np.ndarray:
    return np.unique(rolling(word_hashes(text), width))


def _digest(own: np.ndarray) -> list[int]:
    """128 bits that tell shingle sets apart."""
    return _signed(np.array([mix(own).sum(), np.bitwise_xor.reduce(mix(own ^ _U(0x5BD1E995)))], _U))


def _signed(x) -> list[int]:
    return np.ascontiguousarray(x).view(np.int64).tolist()


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """Per row: doc_id, n_shingles, digest of the set (d1, d2), sub-bands (lefts, rights), 108 bits (s1, s2)."""

    def rows(it):
        seeds = mix(np.arange(1, MINIMA + 1, dtype=_U))[:, None] | _U(1)
        salts = mix(np.arange(1000, 1000 + MINIMA, dtype=_U))[:, None]
        weights = mix(np.arange(50, 50 + ROWS, dtype=_U)) | _U(1)
        places = _U(2) * (np.arange(MINIMA, dtype=_U) % _U(32))
        for doc_id, text in it:
            own = _shingles(text, width)
            if not len(own):
                yield doc_id, 0, 0, 0, None, None, 0, 0
                continue
            low = np.full(MINIMA, ~_U(0), _U)
            for at in range(0, len(own), 4096):
                spun = (own[at : at + 4096][None, :] ^ salts) * seeds
                np.minimum(low, (spun ^ (spun >> _U(32))).min(axis=1), out=low)
            bands = mix((mix(low).reshape(2 * SUB, ROWS) * weights).sum(axis=1))
            bits = (mix(low) & _U(3)) << places
            s1, s2 = np.bitwise_or.reduce(bits[:32]), np.bitwise_or.reduce(bits[32:])
            yield doc_id, len(own), *_digest(own), _signed(bands[:SUB]), _signed(bands[SUB:]), *_signed(np.array([s1, s2], _U))

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(own, rows, "doc_id long, n_shingles long, d1 long, d2 long, lefts array<long>, rights array<long>, s1 long, s2 long")


def _most_bits(percent: int) -> int:
    """Of the 2 bits kept per minimum, how many may differ: mean and 4.5 deviations at the least similarity."""
    miss = 1 - percent / 100
    return int(MINIMA * miss + 4.5 * (MINIMA * (1.5 * miss - miss * miss)) ** 0.5) + 1


def _near(x: str, y: str, percent: int) -> F.Column:
    """Cheap necessary test of a pair: sizes, and bits of the signatures."""
    c = lambda side, name: F.col(f"{side}.{name}")
    bits = sum((F.bit_count(c(x, s).bitwiseXOR(c(y, s))) for s in ("s1", "s2")), F.lit(0))
    return (100 * F.least(c(x, "n"), c(y, "n")) >= percent * F.greatest(c(x, "n"), c(y, "n"))) & (bits <= _most_bits(percent))


def _sketches(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(rep, d1, d2, bits) of the wanted documents: one bit of each of ``BITS`` minima, as bigints."""

    def rows(it):
        half = np.uint32
        seeds = mix(np.arange(9000, 9000 + BITS, dtype=_U)).astype(half)[:, None] | half(1)
        salts = mix(np.arange(20_000, 20_000 + BITS, dtype=_U)).astype(half)[:, None]
        for doc_id, text in it:
            full = _shingles(text, width)
            if not len(full):
                continue
            own = (full >> _U(32)).astype(half)
            low = np.full(BITS, ~half(0), half)
            for at in range(0, len(own), 512):
                spun = (own[at : at + 512][None, :] ^ salts) * seeds
                spun = (spun ^ (spun >> half(15))) * half(0x2C1B3C6D)
                np.minimum(low, (spun ^ (spun >> half(12))).min(axis=1), out=low)
            yield doc_id, *_digest(full), np.packbits((low * half(0x9E3779B1) >> half(31)).astype(np.uint8)).view(np.int64).tolist()

    texts = docs.join(wanted.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "text")
    return map_rows(texts, rows, "rep long, d1 long, d2 long, bits array<long>", 1000).dropDuplicates(["rep", "d1", "d2"])


def _sketches_near(percent: int) -> F.Column:
    """Whether two sketches can be of sets that are alike enough: mean and 4.5 deviations of the bits that differ."""
    share = (1 - percent / 100) / 2
    most = int(BITS * share + 4.5 * (BITS * share * (1 - share)) ** 0.5) + 1
    differ = sum((F.bit_count(F.get("x.bits", F.lit(k)).bitwiseXOR(F.get("y.bits", F.lit(k)))) for k in range(BITS // 64)), F.lit(0))
    return differ <= most


def _first_common() -> F.Column:
    """The pair shares no earlier sub-band in either collection, so of its common buckets this is the first."""
    terms = []
    for side, at in (("lefts", "i"), ("rights", "j")):
        for k in range(SUB - 1):
            terms.append((F.col(f"x.{at}") <= k) | (F.get(f"x.{side}", F.lit(k)) != F.get(f"y.{side}", F.lit(k))))
    out = terms[0]
    for term in terms[1:]:
        out = out & term
    return out


def _confirm(pairs: DataFrame, docs: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are alike enough; sets are made for documents in pairs only."""
    wanted = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = docs.join(wanted, "doc_id", "left_semi")

    def rows(it):
        for doc_id, text in it:
            own = _shingles(text, width)
            if len(own):
                yield doc_id, *_digest(own), _signed(own)

    each = map_rows(texts.select("doc_id", "text"), rows, "doc_id long, d1 long, d2 long, items array<long>", 200)
    sets = cut_lineage(each.dropDuplicates(["doc_id", "d1", "d2"]).select("doc_id", "items"))
    left = pairs.join(sets.withColumnsRenamed({"doc_id": "b", "items": "b_items"}), "b")
    both = left.join(sets.withColumnsRenamed({"doc_id": "a", "items": "a_items"}), "a")
    shared = F.size(F.array_intersect("a_items", "b_items"))
    alike = 100 * shared >= percent * (F.size("a_items") + F.size("b_items") - shared)
    return both.where(alike).select("a", "b")


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept. Linked: 100 * intersection >= percent * union."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = cut_lineage(signatures(own, width=width))
    key = ["n_shingles", "d1", "d2"]
    body = F.struct("lefts", "rights", "s1", "s2")
    classes = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.min_by(body, "doc_id").alias("body"))
    classes = cut_lineage(classes.select(*key, "rep", "body.*"))
    marks = classes.select(F.col("rep").alias("doc"), F.col("n_shingles").alias("n"), "s1", "s2")

    keyed = classes.select("rep", F.posexplode("lefts").alias("i", "x"), "rights").select("rep", "i", "x", F.posexplode("rights").alias("j", "y"))
    keyed = keyed.select(F.xxhash64("i", "x", "j", "y").alias("bucket"), "rep", F.col("i").cast("byte").alias("i"), F.col("j").cast("byte").alias("j"))
    buckets = keyed.groupBy("bucket").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).where("lead <> last").select("bucket", "lead")
    buckets = cut_lineage(buckets)  # read back, so that a hot bucket's side of the join can be split
    members = cut_lineage(keyed.join(buckets, "bucket"))  # only buckets of two or more

    def marked(pairs: DataFrame) -> DataFrame:
        x, y = (marks.select(*[F.col(c).alias(f"{side}_{c}") for c in marks.columns]) for side in "ab")
        both = pairs.join(x, F.col("a") == F.col("a_doc")).join(y, F.col("b") == F.col("b_doc"))
        sides = [F.struct(*[F.col(f"{side}_{c}").alias(c) for c in ("n", "s1", "s2")]).alias(side * 2) for side in "ab"]
        return both.select("a", "b", *sides).where(_near("aa", "bb", percent)).select("a", "b")

    stars = marked(members.where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct())
    first = cut_lineage(stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    links = cut_lineage(_confirm(first, own, percent, width))
    labels = cut_lineage(components(links))

    named = members.join(labels.withColumnsRenamed({"node": "rep", "component": "label"}), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    named = cut_lineage(named.drop("lead"))
    split = cut_lineage(named.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("bucket"))
    rest = cut_lineage(named.join(split, "bucket"))
    wanted = cut_lineage(rest.select("rep").distinct())
    about = classes.join(_sketches(own, wanted, width), ["rep", "d1", "d2"]).select("rep", "lefts", "rights", F.col("n_shingles").alias("n"), "s1", "s2", "bits")
    rest = cut_lineage(rest.join(cut_lineage(about), "rep"))
    x, y = rest.alias("x"), rest.alias("y")
    meet = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.label") != F.col("y.label"))
    meet = meet & _near("x", "y", percent) & _sketches_near(percent) & _first_common()
    pairs = x.join(y, meet).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    pairs = cut_lineage(pairs)
    more = cut_lineage(_confirm(pairs, own, percent, width))
    if not more.isEmpty():
        labels = cut_lineage(components(links.unionByName(more)))
    named = classes.select(*key, "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select(*key, F.coalesce("component", "rep").alias("component_id"))
    out = signed.select("doc_id", *key).join(named, key, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
