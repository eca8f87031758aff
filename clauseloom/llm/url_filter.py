"""URL filters: written rules first, then an empirical-Bayes host reputation.

A page without a rule is judged by its host. Labelled page outcomes (bad or not) are counted by host, registered
domain and suffix. Each level's bad rate has a beta prior whose mean is the posterior mean of the level above and whose
strength is estimated by moments from the spread of rates at that level; a host's posterior is so shrunk towards its
domain, the domain's towards its suffix, the suffix's towards all pages. A page is blocked when the lower bound of its
host's posterior bad rate (mean less ``Z`` standard deviations) is over ``MAX_BAD``. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Verdict, host, path prefix.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Public suffixes of two labels; every other suffix is the last label.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "com.br", "com.cn", "co.in", "co.nz", "co.za")
Z, MAX_BAD = 1.0, 0.25
#: Bounds of a prior's strength, in pages.
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1000.0


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parsed(pages: DataFrame) -> DataFrame:
    """``pages`` with host, path, domain, suffix (replaced if there) from url. A null url, or one without ``://``, has
    all four empty."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = _lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    out = pages.drop("host", "path", "domain", "suffix").withColumns({"host": host, "path": path})
    labels = F.split(F.regexp_replace("host", r"(^.*@)|(:[0-9]*$)", ""), r"\.")
    two = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    suffix = F.when((F.size(labels) >= 2) & two.isin(*SUFFIXES), two).otherwise(F.element_at(labels, -1))
    out = out.withColumn("suffix", suffix)
    n = F.size(labels) - F.size(F.split("suffix", r"\."))
    return out.withColumn("domain", F.when(n >= 1, F.array_join(F.slice(labels, F.greatest(n, F.lit(1)), 10), ".")).otherwise(F.col("host")))


def with_rule(pages: DataFrame, rules=RULES) -> DataFrame:
    """``pages`` (parsed) with rule and ruled: the longest rule that fits, as host and path, and its verdict; or nulls."""
    out = pages.withColumns({"rule": F.lit(None).cast("string"), "ruled": F.lit(None).cast("string")})
    if not rules:
        return out
    rule, ruled = None, None
    for verdict, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1:])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule = F.when(fits, host + path) if rule is None else rule.when(fits, host + path)
        ruled = F.when(fits, verdict) if ruled is None else ruled.when(fits, verdict)
    return out.withColumns({"rule": rule, "ruled": ruled})


def _shrunk(counts: DataFrame, prior: Column) -> DataFrame:
    """``counts`` (n, bad and keys) with the posterior's a and b, given the prior's mean. The prior's strength k is one
    number for the level, by moments: with z = (bad - n m)^2 / (m (1 - m)), the mean of sum z is
    sum n + (sum n^2 - sum n) / (k + 1)."""
    with_m = counts.withColumn("m", F.least(F.greatest(prior, F.lit(1e-6)), F.lit(1 - 1e-6)))
    off = F.col("bad") - F.col("n") * F.col("m")
    got = with_m.agg(F.sum(off * off / (F.col("m") * (1 - F.col("m")))).alias("z"), F.sum("n").alias("n1"), F.sum(F.col("n") * F.col("n")).alias("n2")).first()
    z, n1, n2 = got["z"] or 0.0, got["n1"] or 0, got["n2"] or 0
    k = min(max((n2 - n1) / (z - n1) - 1, LEAST_STRENGTH), MOST_STRENGTH) if z > n1 else MOST_STRENGTH
    return with_m.withColumns({"a": k * F.col("m") + F.col("bad"), "b": k * (1 - F.col("m")) + F.col("n") - F.col("bad")}).drop("m")


def reputation(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """host, n, bad, a, b, bound for every host of ``pages`` (parsed): the posterior beta(a, b) and the lower bound of
    the bad rate. outcomes: page_id and bad (0 or 1, one row for each page). Hosts without outcomes have the posterior
    that their domain lends them."""
    labelled = pages.join(outcomes, "page_id", "left")
    n, bad = F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")
    hosts = staged(labelled.groupBy("host", "domain", "suffix").agg(n, bad), "hosts")
    total = lambda df, *keys: df.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = total(hosts, "domain", "suffix")
    suffixes = total(hosts, "suffix")
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    mean = F.col("a") / (F.col("a") + F.col("b"))
    s = _shrunk(suffixes, F.lit(((whole["bad"] or 0) + 1) / ((whole["n"] or 0) + 2)))
    d = _shrunk(domains.join(s.select("suffix", mean.alias("prior")), "suffix"), F.col("prior"))
    h = _shrunk(hosts.join(d.select("domain", "suffix", mean.alias("prior")), ["domain", "suffix"]), F.col("prior"))
    size = F.col("a") + F.col("b")
    bound = mean - Z * F.sqrt(F.col("a") * F.col("b") / (size * size * (size + 1)))
    return h.select("host", "n", "bad", "a", "b", bound.alias("bound"))


def outcomes_of(labels: DataFrame) -> DataFrame:
    """Labelled page outcomes: a page is bad if the labelled row of the same number has quality 0 (the worst of
    several rows; null ids and null qualities are no outcome)."""
    return labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("page_id")).agg(F.max((F.col("quality") == 0).cast("int")).alias("bad"))


def judged(pages: DataFrame, outcomes: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, bound for every row of ``pages``: the rule's verdict, else block where the
    host's bound is over ``MAX_BAD`` and allow elsewhere. Repeated rows are judged alike; only page_id and url are
    read; an empty table gives no rows."""
    own = with_rule(parsed(pages.select("page_id", "url")), rules)
    rep = reputation(own.select("page_id", "host", "domain", "suffix"), outcomes).select("host", F.round("bound", 6).alias("bound"))
    found = F.coalesce("ruled", F.when(F.col("bound") > MAX_BAD, "block").otherwise("allow"))
    return own.join(rep, "host", "left").select("page_id", "host", "path", "rule", found.alias("verdict"), "bound")
