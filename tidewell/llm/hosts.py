"""Urls by rules, and by the reputation of their hosts where no rule fits.

Labelled outcomes of pages are counted by host and shrunk from above: all pages
give the prior of suffixes, a suffix that of its registered domains, a domain
that of its hosts. Each level is beta-binomial. Its concentration comes from the
moments of the level's own counts, and the prior mean of a node is its parent's
posterior mean without what the node itself has brought, so no outcome counts
twice. A host without outcomes has its prior. Hosts whose share of bad pages is
above a limit even at the lower posterior bound are blocked.

All of it is DataFrame functions. Counts are summed before they are exchanged;
what few hosts hold many pages are found by their counts and met by broadcast, the
others by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import materialize

#: ``(verdict, rule)``; a rule is a host and the beginning of a path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Second labels under which names are registered in two-letter suffixes.
SECOND = ("ac", "co", "com", "edu", "gov", "ne", "net", "or", "org")
#: A key with more than this share of all rows is met by broadcast: fewer than 1024 can be.
HOT = 1024


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What stands after the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none fits.

    A rule fits its host and all hosts under it where the path begins with the rule's.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, whole in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is asked first
        name, slash, rest = whole.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, whole).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def registered(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host, without user and port.

    The suffix is the last label, or the last two where a common second label
    stands under a two-letter one. Addresses and single labels are their own domain.
    """
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    labels = F.split(bare, r"\.")
    n = F.size(labels)
    wide = (n > 2) & (F.length(F.element_at(labels, -1)) == 2) & F.try_element_at(labels, F.lit(-2)).isin(*SECOND)
    last = lambda k: F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), k), ".")
    alone = (n == 1) | bare.rlike(r"^[0-9.]+$|^\[")
    return F.when(alone, bare).when(wide, last(3)).otherwise(last(2)), F.when(alone, bare).when(wide, last(2)).otherwise(last(1))


def met(rows: DataFrame, facts: DataFrame, key: str, weight: str = "rows") -> DataFrame:
    """``rows`` with the columns of ``facts``, which has one row a key (not null) and how many rows have it (``weight``).

    Keys with over a ``HOT``-th of the rows, fewer than ``HOT``, are broadcast to their rows,
    which then aren't exchanged; all other rows meet their facts by a shuffle.
    """
    total = facts.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    often = F.col(weight) * HOT > F.lit(total)
    hot, cold = facts.where(often).drop(weight), facts.where(~often).drop(weight)
    few = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, "left")
    return few.unionByName(rest)


def concentration(level: DataFrame, least: float = 1.0, most: float = 10_000.0) -> float:
    """Concentration of a beta-binomial level ``(n, bad, prior)``, by moments.

    Over all nodes the squares of ``bad - n * prior`` exceed the binomial variance by the
    intraclass correlation ``1 / (concentration + 1)`` times ``n * (n - 1) * prior * (1 - prior)``.
    Where no node has two outcomes nothing is known of it, and it is ``least``.
    """
    spread = F.col("prior") * (1 - F.col("prior"))
    extra = F.sum(F.pow(F.col("bad") - F.col("n") * F.col("prior"), F.lit(2.0)) - F.col("n") * spread)
    over, scale = level.agg(extra, F.sum(F.col("n") * (F.col("n") - 1) * spread)).first()
    if not scale:
        return least
    rho = over / scale
    return most if rho * (most + 1) <= 1 else max(least, 1 / rho - 1)


def reputations(counts: DataFrame, z: float = 1.6449) -> DataFrame:
    """``(host, rows, n, bad, mean, low)`` from ``(host, rows, n, bad)``: posterior mean and lower bound of the share of bad pages.

    ``rows`` are a host's pages, ``n`` those with an outcome, ``bad`` the bad ones. The bound is
    ``z`` posterior standard deviations under the mean.
    """
    domain, suffix = registered(F.col("host"))
    hosts = materialize(counts.select("host", domain.alias("domain"), suffix.alias("suffix"), "rows", "n", "bad"), "hosts")
    sums = (F.count("*").alias("children"), F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = materialize(hosts.groupBy("domain", "suffix").agg(*sums), "domains")
    suffixes = domains.groupBy("suffix").agg(*sums)
    n, bad = domains.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    # Above the suffixes stands one node with the even prior Beta(1, 1).
    own = F.lit(float(bad)) - F.col("bad"), F.lit(float(n)) - F.col("n")
    level = materialize(suffixes.withColumn("prior", (own[0] + 1.0) / (own[1] + 2.0)), "suffix-prior")
    for children, name, parent in ((domains, "domain", "suffix"), (hosts, "host", "domain")):
        k = concentration(level)
        above = level.select(F.col(parent), F.col("children").alias("held"), F.col("n").alias("pn"), F.col("bad").alias("pbad"), F.col("prior").alias("pprior"))
        found = met(children, above, parent, "held")
        prior = (F.lit(k) * F.col("pprior") + F.col("pbad") - F.col("bad")) / (F.lit(k) + F.col("pn") - F.col("n"))
        level = materialize(found.withColumn("prior", prior).drop("pn", "pbad", "pprior"), f"{name}-prior")
    k = concentration(level)
    a, b = F.lit(k) * F.col("prior") + F.col("bad"), F.lit(k) * (1 - F.col("prior")) + F.col("n") - F.col("bad")
    mean = a / (a + b)
    return level.select("host", "rows", "n", "bad", mean.alias("mean"), (mean - F.lit(z) * F.sqrt(mean * (1 - mean) / (a + b + 1))).alias("low"))


def outcomes_of(labels: DataFrame) -> DataFrame:
    """``(page_id, bad)`` from labels by the same id: bad is toxic or of no quality; null ids are left out.

    Of several labels of an id any bad one counts; a null value says nothing.
    """
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    told = labels.where("doc_id is not null and (quality is not null or toxic is not null)")
    return told.groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad.cast("long")).alias("bad"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, limit: float = 0.4, z: float = 1.6449) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` of every row of ``pages``.

    ``outcomes`` has ``(page_id, bad)`` with 0 or 1, one row an id. The longest rule that
    fits decides; where none does, ``block`` if the lower posterior bound of the host's share of bad
    pages is above ``limit``, else ``allow``. Pages under a rule are counted for their host too.

    A null url, or one without ``://``, has an empty host and path; such rows are one host of their
    own, as is any other text between ``://`` and the path, ports and users included. Long
    urls are whole. Repeated rows are judged and counted one by one, with an outcome each; a row
    without an id has none. Other columns play no part. No pages give no rows; without
    outcomes nothing is known against any host.
    """
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    # Equal rows are counted together before they are exchanged.
    by_id = parsed.groupBy("page_id", "host").agg(F.count("*").alias("m"))
    known = by_id.where("page_id is not null").join(outcomes, "page_id").select("host", F.lit(0).cast("long").alias("rows"), F.col("m").alias("n"), (F.col("m") * F.col("bad")).alias("bad"))
    there = parsed.groupBy("host").agg(F.count("*").alias("rows")).withColumns({"n": F.lit(0).cast("long"), "bad": F.lit(0).cast("long")})
    counts = there.unionByName(known).groupBy("host").agg(*(F.sum(c).alias(c) for c in ("rows", "n", "bad")))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    verdicts = reputations(counts, z).select("host", "rows", F.when(F.col("low") > F.lit(limit), "block").otherwise("allow").alias("reputation"))
    found = met(parsed, materialize(verdicts, "host-verdicts"), "host")
    return found.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.col("reputation")).alias("verdict"))
