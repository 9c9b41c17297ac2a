"""URL filters: stated rules first, else the reputation of the page's host.

A rule has a host, a path and a verdict; it fits its host and all subdomains if the url's
path starts with the rule's, and of several the longest decides. Other pages are judged by
an empirical-Bayes estimate of the share of good pages of their host. Labelled outcomes are
counted by host, registered domain and suffix. From the top down the posterior mean of a
level is the prior mean of the next, and the prior's strength is fitted at each level from
all of its groups: within-group and between-group mean squares give the intra-class
correlation of a beta-binomial, whose inverse less one is the strength in pages. A host
with few labels keeps near its domain, a domain near its suffix, a suffix near the whole.
A page is allowed if its host's posterior mean less `z` posterior deviations reaches
`least`; a host without labels has the prior of its domain, with the prior's deviation.

Everything is decided once for each host and joined to the pages. Counts are aggregated
before any shuffle; hosts with a thousandth of all pages are joined where the pages are.

Defined cases: the host reaches from the first `://` up to `/`, `?`, `#` or the end, A-Z
lower-cased, port included; the path up to `?`, `#` or the end; a null url or one without
`://` has an empty host and path, which is a host like others. An empty path starts with
no rule's `/`. Ports don't count for domains; an address of digits is its own domain and
suffix. Equal rules: the longer host, then block, decides. Null outcomes are no outcomes;
repeated and null page ids are judged row by row; without any outcome the prior mean is
one half; empty tables give no row. Other columns of the pages are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import forget
from . import base

#: Suffixes of two labels under which domains are registered; any other suffix is the last label.
SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "com.cn", "co.in", "gov.uk", "org.au", "org.uk")

#: Bounds of a prior's strength in pages, and the strength where no level shows it.
WEAKEST, STRONGEST, UNKNOWN = 2.0, 1000.0, 20.0

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The levels below the whole, from the top.
LEVELS = ("suffix", "domain", "host")


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def suffix(name: Column) -> Column:
    """name: a host without its port."""
    last = F.substring_index(name, ".", -1)
    two = F.substring_index(name, ".", -2)
    return F.when(name.rlike(r"^[0-9.]*$"), name).when(two.isin(*SUFFIXES), two).otherwise(last)


def domain(name: Column) -> Column:
    """The suffix and the label before it; the name itself if there is none."""
    two, three = F.substring_index(name, ".", -2), F.substring_index(name, ".", -3)
    return F.when(name.rlike(r"^[0-9.]*$"), name).when(two.isin(*SUFFIXES), three).otherwise(two)


def strength(groups: DataFrame, above: str | None) -> DataFrame:
    """One row: the strength of the prior inside each group of the level above. groups: n and good of each group with labels."""
    n, good = F.col("n").cast("double"), F.col("good").cast("double")
    parts = groups.groupBy(above) if above else groups.groupBy()
    of = parts.agg(F.count("*").alias("k"), F.sum("n").alias("all"), F.sum("good").alias("right"), F.sum(good * good / n).alias("share"), F.sum(n * n).alias("squares")).filter(F.col("all") > 0)
    whole = of.agg(
        F.sum(F.col("k") - 1).alias("between"), F.sum(F.col("all") - F.col("k")).alias("within"), F.sum(F.col("all") - F.col("squares") / F.col("all")).alias("sizes"),
        F.sum(F.col("share") - F.col("right").cast("double") * F.col("right") / F.col("all")).alias("apart"), F.sum(F.col("right") - F.col("share")).alias("inside"),
    )
    b, w = F.col("apart") / F.col("between"), F.col("inside") / F.col("within")
    size = F.col("sizes") / F.col("between")
    rho = (b - w) / (b + (size - 1) * w)
    known = (F.col("between") > 0) & (F.col("within") > 0) & (F.coalesce(F.col("apart") + F.col("inside"), F.lit(0.0)) > 0)
    pages = F.when(known & (b > w), F.least(F.greatest(1 / rho - 1, F.lit(WEAKEST)), F.lit(STRONGEST))).when(known, F.lit(STRONGEST)).otherwise(F.lit(UNKNOWN))
    return whole.select(pages.alias("strength"))


def reputations(hosts: DataFrame, z: float) -> DataFrame:
    """hosts: (host, n, good, ...), one row for each host. Adds posterior mean and bound, and the levels' names."""
    name = F.regexp_replace("host", ":[0-9]*$", "")
    known = base.written(hosts.withColumn("domain", domain(name)).withColumn("suffix", suffix(name)), "hosts")
    fitted = known.agg(((F.sum("good") + 1.0) / (F.sum("n") + 2.0)).alias("mean")).select(F.coalesce("mean", F.lit(0.5)).alias("mean"))
    strengths, counts = {}, {}
    for level, above in zip(LEVELS, (None, *LEVELS), strict=False):
        counts[level] = known.groupBy(*([level] if above is None else [level, above])).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
        strengths[level] = strength(counts[level].filter("n > 0"), above).first()["strength"]
    shrunk = lambda rows, level, prior: rows.select(level, ((prior * strengths[level] + F.col("good")) / (strengths[level] + F.col("n"))).alias("prior"))
    suffixes = shrunk(counts["suffix"], "suffix", F.lit(fitted.first()["mean"]))
    domains = shrunk(counts["domain"].join(suffixes, "suffix"), "domain", F.col("prior"))
    k = strengths["host"]
    a, b = F.col("prior") * k + F.col("good"), (1 - F.col("prior")) * k + F.col("n") - F.col("good")
    mean = a / (a + b)
    return known.join(domains, "domain").withColumn("posterior", mean).withColumn("bound", mean - z * F.sqrt(mean * (1 - mean) / (a + b + 1))).drop("prior")


def judge(pages: DataFrame, rules: DataFrame, outcomes: DataFrame, least: float = 0.8, z: float = 1.645, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict, posterior, bound) of every page.

    rules: (host, path, verdict), of any number; outcomes: (host, n, good), labelled and
    good pages of a host, in any number of rows.
    """
    rows = pages.select(F.col(key), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    counted = rows.groupBy("host").agg(F.count("*").alias("n_pages"))
    labelled = outcomes.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    both = counted.join(labelled, "host", "full").select("host", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_pages", "n", "good")))
    rated = reputations(both, z)
    listed = base.written(rules.select("host", "path", "verdict").distinct(), "rules")
    labels = listed.agg(F.max(F.size(F.split("host", "[.]"))).alias("n")).first()["n"] or 0
    # a host meets the rules of its last label, of its last two, and so on, as far as rules go
    asked = rated.select("host", F.explode(F.array_distinct(F.array(F.col("host"), *(F.substring_index("host", ".", -k) for k in range(1, labels + 1))))).alias("of"))
    met = asked.join(listed.withColumnRenamed("host", "of"), "of").groupBy("host").agg(
        F.sort_array(F.collect_set(F.struct((-F.length("of") - F.length("path")).alias("size"), (-F.length("of")).alias("host_size"), F.when(F.col("verdict") == "block", 0).otherwise(1).alias("mild"), F.col("path").alias("path"), F.concat("of", "path").alias("rule"), "verdict"))).alias("rules")
    )
    decided = base.written(rated.join(met, "host", "left").filter("n_pages > 0").select("host", "n_pages", "posterior", "bound", "rules"), "reputations")
    judged = base.join_with_hot_keys(rows, decided, "host", "n_pages")
    first = F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(0))
    verdict = F.coalesce(first["verdict"], F.when(F.col("bound") >= least, "allow").otherwise("block"))
    forget(listed)
    return judged.select(key, "host", "path", first["rule"].alias("rule"), verdict.alias("verdict"), "posterior", "bound")
