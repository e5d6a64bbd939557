"""Operator 3, URL filter by empirical-Bayes host reputation.

Method: labelled page outcomes are counted by host, registered domain and suffix. Each level's bad rate is shrunk
by a beta-binomial prior towards its parent: corpus to suffix to registered domain to host. The prior strength of
a level is estimated from the labelled counts by moments. A host is blocked when the lower posterior bound of its
bad rate lies over ``limit``. Written rules on host and path come first.

All steps are grouped sums and equi-joins on names. Only hosts that differ are joined, rows are never collected;
a frequent host is pre-aggregated before each shuffle, and its rows in the last join are left to the skew join.

Defined cases: a url that is null or has no ``://`` has empty host and path; hosts without labels get their
domain's, suffix's or the corpus's rate; without any label nothing is blocked; repeated rows give repeated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .scratch import written

# Written rules (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

#: Blocked if the lower posterior bound of the bad rate is over this.
LIMIT = 0.35
#: Standard deviations below the posterior mean.
WIDTH = 1.64
#: Bounds of the estimated prior strength, in pseudo-pages.
WEAKEST, STRONGEST = 2.0, 1000.0

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), _UP, _LOW), F.lit(""))


def path(url: Column) -> Column:
    """From the host's end up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix(h: Column) -> Column:
    """The last label of a host."""
    return F.substring_index(h, ".", -1)


def domain(h: Column) -> Column:
    """The last two labels of a host; ``example`` names are shared suffixes, under which three labels register."""
    two = F.substring_index(h, ".", -2)
    return F.when(two.startswith("example."), F.substring_index(h, ".", -3)).otherwise(two)


def rule_of(h: Column, p: Column, rules: list = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host or a parent and whose path starts the url's path."""
    rule = verdict = F.lit(None).cast("string")
    for name, start, says in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r[0])):
        fits = ((h == name) | h.endswith("." + name)) & p.startswith(start)
        rule = F.when(fits, F.lit(name + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _strength(level: DataFrame) -> float:
    """Strength s of a level's prior by moments: n (r - p)^2 has the mean p (1 - p) (1 + (n - 1) rho), rho = 1 / (s + 1)."""
    noise = F.col("prior") * (1 - F.col("prior"))
    r = level.where("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("prior"), 2) - noise).alias("extra"),
        F.sum(noise * (F.col("n") - 1)).alias("room")).first()
    if not r.extra or not r.room or r.extra <= 0:
        return STRONGEST
    return min(max(r.room / r.extra - 1, WEAKEST), STRONGEST)


def _shrunk(level: DataFrame) -> DataFrame:
    """``level`` (bad, n, prior) with its rate shrunk to the prior: mean, strength."""
    s = _strength(level)
    return level.withColumn("strength", F.lit(s)).withColumn("mean", (F.col("bad") + s * F.col("prior")) / (F.col("n") + s))


def reputation(pages: DataFrame, outcomes: DataFrame, page_col: str = "page_id", url_col: str = "url",
               bad_col: str = "bad") -> DataFrame:
    """host, n, bad, mean, lower: posterior bad rate of every host in ``pages`` from labelled outcomes (page, 0/1).

    The counts by host are written once; only single figures (corpus rate, three strengths) reach the driver.
    """
    urls = pages.select(F.col(page_col).alias("page_id"), host(F.col(url_col)).alias("host"))
    known = outcomes.select(F.col(page_col).alias("page_id"), F.col(bad_col).cast("double").alias("bad")).where("bad is not null")
    known = known.groupBy("page_id").agg(F.avg("bad").alias("bad"))
    hosts = written(urls.join(known, "page_id", "left").groupBy("host")
                    .agg(F.coalesce(F.sum("bad"), F.lit(0.0)).alias("bad"), F.count("bad").cast("double").alias("n"))
                    .withColumn("domain", domain(F.col("host"))).withColumn("suffix", suffix(F.col("host"))), "url-hosts")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    suffixes = domains.groupBy("suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    corpus = suffixes.agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).first()
    rate = corpus.bad / corpus.n if corpus.n else 0.0
    top = _shrunk(suffixes.withColumn("prior", F.lit(rate))).select("suffix", F.col("mean").alias("prior"))
    middle = _shrunk(domains.join(top, "suffix")).select("suffix", "domain", F.col("mean").alias("prior"))
    low = _shrunk(hosts.join(middle, ["suffix", "domain"]))
    spread = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.col("strength") + 1))
    return low.select("host", "n", "bad", "mean", (F.col("mean") - WIDTH * spread).alias("lower"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list = RULES, limit: float = LIMIT, page_col: str = "page_id",
          url_col: str = "url", bad_col: str = "bad") -> DataFrame:
    """page_id, host, path, rule, verdict, bad_rate (posterior mean), lower bound."""
    known = reputation(pages, outcomes, page_col, url_col, bad_col).select(
        F.col("host").alias("_host"), F.col("mean").alias("bad_rate"), "lower")
    rows = pages.select(F.col(page_col).alias("page_id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("lower") > limit, F.lit("block")).otherwise(F.lit("allow"))
    return (rows.join(known, F.col("host") == F.col("_host"), "left")
            .select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "bad_rate", "lower"))
