"""URL filters by empirical-Bayes host reputation.

Labelled page outcomes (bad or not) are added up per host, and each host's rate is shrunk through beta-binomial priors:
the suffix towards all pages, the registered domain towards its suffix, the host towards its domain. How strongly is
estimated from the data at each level (method of moments for the beta-binomial's intra-class correlation); where it
cannot be, the least strength holds. Outcomes of one group are alike, so n of them with correlation r count as
n / (1 + (n - 1) r) in the level above, and no host makes its whole suffix bad by its size. A group's prior comes from the
others of its parent, never from itself, and is no surer than these are: its variance is that within the level plus that
of the parent's own rate. A host is blocked when the lower bound of its posterior bad rate is above a threshold. Fixed
rules go before reputation.

All DataFrame functions. Hosts stay a distributed table; a hot host is one row of it after map-side sums, and the pages
join it on the host, where adaptive execution splits a hot side. Rows: a null url, or one without ``://``, has the host
and path ''; such pages share the reputation of the host ''. Unlabelled pages, and labels with a null outcome or a page
that isn't there, count for nothing. Repeated pages and labels count as often as they occur. An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumitrack.llm.common import cut

#: Suffixes of several labels (fixed values, an excerpt of common ones; a longer list of up to four labels each may be
#: given instead); any other suffix is a host's last label.
SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "net.au", "or.jp", "org.au", "org.uk")
#: The rules of the query contract (fixed values): host, path, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: A host is blocked if its bad rate is above MAX_BAD at Z standard deviations of its posterior.
MAX_BAD, Z = 0.5, 1.645
#: The least and the greatest prior strength, in pages.
STRENGTH = (1.0, 10_000.0)


def host_of(url: Column) -> Column:
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _name(host: Column) -> Column:
    return F.rtrim(F.regexp_replace(host, r":\d*$", ""), F.lit("."))


def _is_address(name: Column) -> Column:
    return name.rlike(r"^([0-9]{1,3}(\.[0-9]{1,3}){3}|\[.*)$")


def _labels(host: Column, more: int, suffixes: tuple[str, ...]) -> Column:
    name = _name(host)
    found = F.substring_index(name, ".", -1 - more)
    for k in range(2, 5):
        if these := [s for s in suffixes if s.count(".") == k - 1]:
            found = F.when(F.substring_index(name, ".", -k).isin(*these), F.substring_index(name, ".", -k - more)).otherwise(found)
    return F.when(_is_address(name), name).otherwise(found)


def suffix_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The public suffix of a host without its port, the longest that fits; an address is its own."""
    return _labels(host, 0, suffixes)


def domain_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The registered domain: the suffix and one label more; an address is its own."""
    return _labels(host, 1, suffixes)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null; of equally long ones, that of the longer host."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _strength(groups: DataFrame) -> float:
    """The prior strength of one level: groups with ``n`` outcomes, ``bad`` of them, around their parents' rates ``p``."""
    rate, size = F.col("bad") / F.col("n"), F.col("n")
    spread = size * F.pow(rate - F.col("p"), 2) / (F.col("p") * (1 - F.col("p")))
    x = groups.filter("n > 0").agg(F.sum(spread).alias("s"), F.count(F.lit(1)).alias("g"), F.sum(size).alias("n"), F.sum(size * size).alias("nn")).first()
    if not x["g"] or (room := x["n"] - x["nn"] / x["n"] - (x["g"] - 1)) <= 0:
        return STRENGTH[0]
    alike = (x["s"] - (x["g"] - 1)) / room
    return STRENGTH[1] if alike <= 0 else min(max(1 / alike - 1, STRENGTH[0]), STRENGTH[1])


def _level(groups: DataFrame, parent: str | None) -> tuple[DataFrame, float]:
    """``groups`` (n, bad, and the columns that name them) with what each counts for its parent, in e_n and e_bad; and the strength."""
    smoothed = (F.coalesce(F.sum("bad"), F.lit(0.0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0.0)) + 1)
    if parent:
        strength = _strength(groups.join(groups.groupBy(parent).agg(smoothed.alias("p")), parent))
    else:
        strength = _strength(groups.withColumn("p", F.lit(groups.agg(smoothed.alias("p")).first()["p"])))
    one = 1 / (1 + F.greatest(F.col("n") - 1, F.lit(0.0)) * F.lit(1 / (strength + 1)))
    return groups.withColumns({"e_n": F.col("n") * one, "e_bad": F.col("bad") * one}), strength


def _surely(strength: float, weight: Column) -> Column:
    """The strength of a prior whose mean is itself known from ``weight`` pages only."""
    return F.greatest(1 / (F.lit(1 / (strength + 1)) + 1 / (weight + 1)) - 1, F.lit(STRENGTH[0]))


def _others(prefix: str, strength: float) -> list[Column]:
    """Of each group of a level: the mean and strength of its prior, from its parent's sums (n, bad, prior) less its own part."""
    bad = F.col(f"{prefix}_bad") - F.col("e_bad") + F.col(f"{prefix}_k") * F.col(f"{prefix}_m")
    weight = F.col(f"{prefix}_n") - F.col("e_n") + F.col(f"{prefix}_k")
    return [(bad / weight).alias("m"), _surely(strength, weight).alias("k")]


def reputations(outcomes: DataFrame, z: float = Z, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """Per host of ``outcomes`` (host, n outcomes, n_bad of them): n, n_bad, bad_rate (posterior mean), bad_low, bad_high.

    The bounds are the posterior beta distribution's mean less or plus ``z`` standard deviations, within 0 and 1.
    """
    hosts = cut(outcomes.groupBy("host").agg(F.sum("n").cast("double").alias("n"), F.sum("n_bad").cast("double").alias("bad")))
    hosts, of_host = _level(hosts.withColumns({"domain": domain_of(F.col("host"), suffixes), "suffix": suffix_of(F.col("host"), suffixes)}), "domain")
    domains, of_domain = _level(cut(hosts.groupBy("domain", "suffix").agg(F.sum("e_n").alias("n"), F.sum("e_bad").alias("bad"))), "suffix")
    suffixes, of_suffix = _level(cut(domains.groupBy("suffix").agg(F.sum("e_n").alias("n"), F.sum("e_bad").alias("bad"))), None)
    every = suffixes.agg(F.sum("e_bad").alias("bad"), F.sum("e_n").alias("n")).first()
    # all pages: half a page bad and half a page not, before any is seen
    top = {"a_n": F.lit(every["n"] or 0.0), "a_bad": F.lit(every["bad"] or 0.0), "a_k": F.lit(1.0), "a_m": F.lit(0.5)}
    s = suffixes.withColumns(top).select("suffix", F.col("n").alias("s_n"), F.col("bad").alias("s_bad"), *(c.alias(f"s_{x}") for c, x in zip(_others("a", of_suffix), "mk", strict=True)))
    d = domains.join(s, "suffix").select("domain", F.col("n").alias("d_n"), F.col("bad").alias("d_bad"), *(c.alias(f"d_{x}") for c, x in zip(_others("s", of_domain), "mk", strict=True)))
    known = hosts.join(d, "domain").select("host", "n", "bad", *_others("d", of_host))
    weight = F.col("n") + F.col("k")
    rate = (F.col("bad") + F.col("k") * F.col("m")) / weight
    sd = F.sqrt(rate * (1 - rate) / (weight + 1))
    counts = F.col("n").cast("long").alias("n"), F.col("bad").cast("long").alias("n_bad")
    return known.select("host", *counts, rate.alias("bad_rate"), F.greatest(rate - z * sd, F.lit(0.0)).alias("bad_low"), F.least(rate + z * sd, F.lit(1.0)).alias("bad_high"))


def judged(pages: DataFrame, labels: DataFrame, rules=RULES, max_bad: float = MAX_BAD, z: float = Z, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """``pages`` (page_id, url) with host, path, rule, verdict and the host's reputation.

    ``labels`` (doc_id, toxic) label pages by their id; toxic = 1 is the bad outcome.
    """
    seen = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.count("toxic").alias("n"), F.sum((F.col("toxic") == 1).cast("int")).alias("n_bad"))
    each = seen.select("page_id", "host").join(marks, F.col("page_id") == F.col("doc_id"), "left")
    outcomes = each.select("host", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "n_bad")))
    known = reputations(outcomes, z, suffixes)
    rule = rule_for(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.col("bad_low") > max_bad, "block").otherwise("allow")
    return (
        seen.join(known, "host", "left")
        .withColumn("_rule", rule)
        .select("page_id", "url", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), by_method).alias("verdict"), "bad_rate", "bad_low", "bad_high")
    )


def op6(pages: DataFrame, labels: DataFrame) -> DataFrame:
    return judged(pages, labels).select("page_id", "host", "path", "rule", "verdict")
