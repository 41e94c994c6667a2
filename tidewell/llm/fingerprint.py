"""Document fingerprints: homomorphic multiset hashes of paragraphs.

A document is the multiset of its paragraphs, here its lines cut at sentence
ends. Each is hashed to a wide vector, and the fingerprint is the sum of the
vectors, each component modulo a power of two (AdHash of Bellare and
Micciancio, 1997). So order doesn't matter, equal multisets are equal, and a
paragraph is put in or taken out by adding or subtracting its vector.

The vector has 62 components of one bit, kept modulo 2**30, two to a long with
a clear bit above each (no text has so many paragraphs, so they never wrap), four components of 32 bits, and the number 1.
The one-bit components read as signs are an AMS sketch (Alon, Matias, Szegedy,
1996): squared differences of two fingerprints estimate how many paragraphs
the documents don't share. Everything is Spark SQL.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import materialize

#: Longs of two components of 30 bits with a spare bit above each.
LANES, WIDTH, STEP = 31, 30, 31
MASK = sum(((1 << WIDTH) - 1) << (STEP * i) for i in range(2))
ONES = sum(1 << (STEP * i) for i in range(2))
LOW = 0xFFFFFFFF


def paragraphs(text: Column) -> Column:
    """Lines, cut after ``.``, ``!`` or ``?`` and a space; blank ones left out."""
    return F.filter(F.split(text, r"[\r\n]+|(?<=[.!?]) "), lambda p: p.rlike(r"\S"))


def with_vector(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the summed vector of a text column: ``array<long>`` of 31 packed
    sketch components, 4 of 32 bits and the count.

    Each step is a projection of its own, so that Catalyst computes the split
    and the hashes once and not in every sum that reads them.
    """
    p, near, wide, far = (f"{name}_{x}" for x in ("parts", "near", "wide", "far"))
    df = df.withColumn(p, paragraphs(F.col(text)))
    df = df.select(
        "*", F.transform(p, lambda x: F.xxhash64(x)).alias(near),
        F.transform(p, lambda x: F.xxhash64(x, F.lit(1))).alias(wide), F.transform(p, lambda x: F.xxhash64(x, F.lit(2))).alias(far),
    )

    def add(hashes: str, shift: int, bits: int, mask: int) -> Column:
        return F.aggregate(
            F.col(hashes), F.lit(0).cast("long"),
            lambda a, h: (a + F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(bits))).bitwiseAND(F.lit(mask)),
        )

    sketch = [add(near, i, ONES, MASK) for i in range(LANES)]
    halves = [add(h, shift, LOW, LOW) for h in (wide, far) for shift in (0, 32)]
    return df.withColumn(name, F.array(*sketch, *halves, F.size(p).cast("long"))).drop(p, near, wide, far)


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint of the multisets' sum, or with ``sign=-1`` of their difference."""
    spare = F.lit(ONES << WIDTH)

    def each(x: Column, y: Column, i: Column) -> Column:
        mask = F.when(i < LANES, F.lit(MASK)).otherwise(F.lit(LOW))
        if sign > 0:
            return (x + y).bitwiseAND(mask)
        room = F.when(i < LANES, spare).otherwise(F.lit(LOW + 1))
        return (x + room - y).bitwiseAND(mask)

    return F.transform(F.arrays_zip(a.alias("x"), b.alias("y")), lambda z, i: each(z["x"], z["y"], i))


def as_hex(vector: Column) -> Column:
    return F.lower(F.array_join(F.transform(vector, lambda v: F.lpad(F.hex(v), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common paragraphs, 0 to 1; equal fingerprints give 1."""

    def signs(v: Column) -> Column:
        n = F.element_at(v, -1)
        return F.flatten(
            F.transform(
                F.slice(v, 1, LANES),
                lambda p: F.array(*(F.lit(2) * F.shiftrightunsigned(p, STEP * i).bitwiseAND(F.lit((1 << WIDTH) - 1)) - n for i in range(2))),
            )
        )

    def norm(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))

    x, y = signs(a), signs(b)
    apart, total = norm(F.zip_with(x, y, lambda p, q: p - q)), norm(x) + norm(y)
    # Sums of multisets without a common paragraph differ by as much as they hold.
    return F.when(a == b, 1.0).when(total == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - apart / total))


def _below(edges: Column, x: Column) -> Column:
    """How many of the sorted edges are below ``x``, by halving."""
    lo, hi = (lambda s: s["lo"]), (lambda s: s["hi"])
    mid = lambda s: F.floor((lo(s) + hi(s)) / 2).cast("int")

    def step(s: Column, _: Column) -> Column:
        less = F.get(edges, mid(s)) < x
        return F.when(lo(s) >= hi(s), s).when(less, F.struct((mid(s) + 1).alias("lo"), hi(s).alias("hi"))).otherwise(F.struct(lo(s).alias("lo"), mid(s).alias("hi")))

    start = F.struct(F.lit(0).alias("lo"), F.size(edges).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(32)), start, step, lo)


def _edges(column: str, n: int, most: int = 512) -> Column:
    """Aggregate: sorted values that cut a column into about ``n`` ranges, even ones between ``most`` quantiles."""
    wide = min(n, most)
    each = -(-n // wide)
    q = F.array_sort(F.array_distinct(F.coalesce(F.percentile_approx(column, [i / wide for i in range(wide + 1)], 10_000), F.array().cast("array<bigint>"))))
    exact = lambda x: x.cast("decimal(20,0)")  # noqa: E731  ids may lie further apart than a long holds
    step = lambda x, i: F.floor((exact(F.coalesce(F.get(q, i + 1), x)) - exact(x)) / each)
    between = lambda x, i: F.transform(F.sequence(F.lit(0), F.lit(each - 1)), lambda j: (exact(x) + step(x, i) * j).cast("bigint"))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(q, between))))


def following(docs: DataFrame, fields: list[str], buckets: int | None = None) -> DataFrame:
    """``docs`` with ``next``, a struct of the fields of the next smaller doc_id.

    The last document is followed by the first. Documents are cut into ranges
    of doc_id by quantiles, and evenly between those, some for each task; every range also gets a copy of
    the one document that follows its last. The edges are one literal and the
    ranges' first documents a joined table of a row each, so the plan is the
    same for any number of ranges.
    """
    spark = docs.sparkSession
    # Several ranges a task, as they are dealt by hash.
    n = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = docs.agg(_edges("doc_id", n).alias("edges")).first().edges
    # One literal, however many ranges there are.
    range_of = _below(F.from_json(F.lit(json.dumps(edges)), "array<bigint>"), F.col("doc_id"))
    tops = materialize(docs.select("doc_id", range_of.alias("range")).groupBy("range").agg(F.max("doc_id").alias("top")).where("top is not null"), "fingerprint-tops")
    # A row for each range, in one task: who comes before its first document.
    first = Window.orderBy("range")
    heads = tops.select(F.col("top"), F.coalesce(F.lead("range").over(first), F.min("range").over(Window.partitionBy())).alias("before"))
    placed = docs.withColumn("range", range_of).join(heads, F.col("doc_id") == F.col("top"), "left")
    copies = F.explode(F.array_compact(F.array(F.struct("range", F.lit(False).alias("ghost")), F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("range"), F.lit(True).alias("ghost"))))))
    placed = placed.select("*", copies.alias("at")).drop("range", "top", "before").select("*", "at.range", "at.ghost").drop("at")
    order = Window.partitionBy("range").orderBy("ghost", F.col("doc_id").desc(), "tie")
    later = F.lead(F.struct(*fields)).over(order)
    return placed.withColumn("next", later).where("not ghost").drop("range", "ghost")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``.

    The edited text of a document is its own with the last ``n_chars // 2``
    code points replaced by the first as many of the next document's. A null
    text is empty; two empty texts have equal fingerprints and likeness 1.
    Rows that repeat a doc_id follow each other by their text's hash. A single
    document follows itself. Rows without an id come last. Very long texts are
    read whole. Other columns aren't read. An empty table gives no rows.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    base = with_vector(base.withColumn("tie", F.xxhash64("text")), "text", "vector")
    half = "cast(length(text) div 2 as int)"
    edited = following(base, ["text", "vector"]).select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), "vector", F.coalesce("next.vector", "vector").alias("next_vector"),
        F.expr(f"concat(substring(text, 1, length(text) - {half}), substring(coalesce(next.text, text), 1, {half}))").alias("edited"),
    )
    found = with_vector(edited.withColumn("edited_sha256", F.sha2("edited", 256)), "edited", "edited_vector")
    return found.select(
        "doc_id", "n_chars", "edited_sha256", as_hex(F.col("vector")).alias("fingerprint"), as_hex(F.col("edited_vector")).alias("edited_fingerprint"),
        likeness(F.col("vector"), F.col("edited_vector")).alias("near_edited"), likeness(F.col("vector"), F.col("next_vector")).alias("near_next"),
    )
