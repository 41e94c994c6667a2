"""Vector, version, date and token-estimate functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions.text import col


def as_doubles(v: Column | str) -> Column:
    return col(v).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def literal_vector(values: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; null where a vector is zero."""
    x, y = as_doubles(a), as_doubles(b)
    return dot(x, y) / F.nullif(norm(x) * norm(y), F.lit(0.0))


def as_score(similarity: Column) -> Column:
    """A cosine similarity clamped to 0..1; null, that of a zero vector, is like nothing."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(similarity, F.lit(0.0))))


def cosine_score(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity clamped to 0..1; a zero vector is like nothing."""
    return as_score(cosine(a, b))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - cosine; null where a vector is zero."""
    return F.lit(1.0) - cosine(a, b)


def l2_normalize(v: Column | str, eps: float = 1e-12) -> Column:
    x = as_doubles(v)
    return F.transform(x, lambda e: e / (norm(x) + F.lit(eps)))


def mean_pool(vectors: Column | str, mask: Column | str, eps: float = 1e-9) -> Column:
    """Mean of the vectors whose mask is 1."""
    dim = F.size(F.element_at(col(vectors), 1))
    total = F.aggregate(col(mask), F.lit(0.0), lambda s, m: s + m)
    return F.transform(
        F.sequence(F.lit(0), dim - 1),
        lambda i: F.aggregate(F.zip_with(col(vectors), col(mask), lambda v, m: F.get(v, i).cast("double") * m), F.lit(0.0), lambda s, x: s + x) / (total + F.lit(eps)),
    )


def pool(vectors: Column | str, mask: Column | str, mode: int) -> Column:
    """1 mean, 2 first, 3 last of the vectors in the mask."""
    if mode == 1:
        return mean_pool(vectors, mask)
    kept = F.filter(col(vectors), lambda _, i: F.get(col(mask), i) > 0)
    return F.try_element_at(kept, F.lit(1 if mode == 2 else -1))


def round_signed(x: Column, digits: int) -> Column:
    """``round`` that keeps the sign of what it rounds to zero, as IEEE and DuckDB do; Spark's goes by decimals and has no -0.0."""
    r = F.round(x, digits)
    return F.when(r == 0, x * F.lit(0.0)).otherwise(r)


def token_estimate(x: Column | str) -> Column:
    """A quarter of the UTF-8 bytes, rounded up; null counts nothing."""
    return F.ceil(F.octet_length(F.coalesce(col(x), F.lit(""))) / F.lit(4.0)).cast("bigint")


def semver_triple(x: Column | str) -> Column:
    """``struct(major, minor, patch)`` of the first numbers, missing parts 0; null without any."""
    t = col(x)
    part = lambda pattern: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(t, pattern, 1), F.lit("")), F.lit("9999999999")).cast("bigint"), F.lit(0).cast("bigint"))
    return F.when(
        t.rlike(r"\d"),
        F.struct(part(r"^\D*(\d+)").alias("major"), part(r"^\D*\d+\.(\d+)").alias("minor"), part(r"^\D*\d+\.\d*\.(\d+)").alias("patch")),
    )


def is_newer(latest: Column | str, current: Column | str) -> Column:
    """Whether the one version is above the other; false where one can't be read."""
    return F.coalesce(semver_triple(latest) > semver_triple(current), F.lit(False))


def version_parts(x: Column | str) -> Column:
    """First three numeric parts between dots; other parts are left out and the rest moves up."""
    parts = F.filter(F.transform(F.split(col(x), r"\."), lambda p: F.when(p.rlike(r"^\+?\d+$"), p.try_cast("bigint"))), lambda p: p.isNotNull())
    at = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit(0).cast("bigint"))
    return F.struct(at(1).alias("major"), at(2).alias("minor"), at(3).alias("patch"))


def compare_versions(current: Column | str, latest: Column | str) -> Column:
    """1 if latest is above current, -1 below, 0 alike; ``dev`` is below all."""
    c, n = col(current), col(latest)
    part = lambda v, i: F.coalesce(F.get(F.split(v, r"\."), F.lit(i)).try_cast("double"), F.lit(0.0))
    out = F.lit(0)
    for i in (2, 1, 0):
        out = F.when(part(c, i) < part(n, i), 1).when(part(c, i) > part(n, i), -1).otherwise(out)
    return F.when(c == "dev", 1).otherwise(out)


def backoff_ms(attempt: Column | str, base: int = 1000, most: int = 8000) -> Column:
    """Wait before the next attempt: doubled each time up to a bound."""
    return F.least(F.lit(float(most)), F.lit(float(base)) * F.pow(F.lit(2.0), col(attempt))).cast("bigint")


def days_before(now: str, days: int) -> Column:
    """A moment some days before ``now``, as a time without zone."""
    return F.expr(f"timestamp_ntz'{now}' - interval '{int(days)}' day")


def expired(created: Column, ttl_ms: Column, status: Column, completed: Column, now: Column, keep_ms: int = 300_000) -> Column:
    """Whether a task's time to live is over, or it ended more than five minutes ago."""
    since = lambda t: F.timestamp_diff("MILLISECOND", t, now)
    done = status.isin("completed", "failed", "cancelled")
    return F.coalesce(since(created) > ttl_ms, F.lit(False)) | F.coalesce(done & (since(completed) > keep_ms), F.lit(False))
