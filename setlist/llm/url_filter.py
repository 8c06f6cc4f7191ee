"""URL filters: explicit rules first, else the host's reputation by empirical Bayes.

Labelled pages are outcomes, bad or not. A host with few of them says little, so shares shrink: a suffix towards
the whole table, a registered domain towards its suffix, a host towards its domain. At each level the strength
of the prior is estimated from the table itself (:func:`strength`, the moments of a beta-binomial). A host's posterior
is a beta distribution; its pages are blocked where the lower bound of the bad share (mean less :data:`Z`
deviations) is above :data:`MAX_BAD`, and allowed otherwise: a host needs evidence to be blocked.

Everything is an expression or an aggregation over hosts. Pages meet their host's reputation by salted keys, as one
host may have a third of them; only ids and urls are read.

A null url, or one without ``://``, has an empty host and path, and pages like these share one reputation. Pages
without a label, or with a label of nulls only, are no outcomes; a document's labels in several rows are bad if one is.
Null and repeated page ids keep their rows, each an outcome if its id has a label; urls of any length are split
whole; of rules that fit, the longest wins, then the longer host, then ``block``; extra columns are not read; an empty table
gives an empty result, without labels every bound is that of the prior alone.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, salted_lookup


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


#: The rules of the registered query.
RULES = [Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/")]
#: Public suffixes of two labels that the operator knows; every other suffix is the last label.
SUFFIXES = ["co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "co.in", "co.kr", "co.za", "com.br", "com.mx", "com.ar", "com.cn", "com.tr", "com.tw"]
MAX_BAD = 0.5
#: Of a normal distribution, the one-sided bound of 95 %.
Z = 1.645
#: Labels that a prior counts for, at least and at most.
WEAKEST, STRONGEST = 1.0, 1000.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a url without ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def levels(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host; an address, or a name without a dot, is its own."""
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", ""), r"\.$", "")
    labels = F.split(name, r"\.")
    n = F.size(labels)
    last = lambda k: F.array_join(F.slice(labels, F.greatest(F.lit(1), n - (k - 1)), k), ".")
    whole = (n < 2) | F.regexp_like(name, F.lit(r"(^\[|\.[0-9]+$)"))
    long = last(2).isin(SUFFIXES)
    return F.when(whole, name).when(long, last(3)).otherwise(last(2)), F.when(whole, name).when(long, last(2)).otherwise(last(1))


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """``struct<rule, verdict>`` of the longest rule that fits, or null. ``rules`` is a list of some hundreds at most."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.host) + len(r.path), len(r.host), r.verdict)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        best = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(best)
    return best


def outcomes(labels: DataFrame) -> DataFrame:
    """``page_id, bad``: a label's ``doc_id`` names the page."""
    known = labels.where(F.col("doc_id").isNotNull() & F.coalesce("quality", "toxic").isNotNull())
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    return known.groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad.cast("int")).alias("bad"))


def strength(groups: DataFrame) -> float:
    """How many labels the prior of ``groups`` (``n, bad, prior``) counts for. With correlation r within a group, the squared
    distance of a share from its prior mean m is m(1-m)(1 + (n-1) r) / n; r is solved for over all groups."""
    m, n = F.col("prior"), F.col("n")
    spread = m * (1 - m)
    row = groups.where("n > 0").agg(
        F.sum(n * F.pow(F.col("bad") / n - m, 2)).alias("seen"), F.sum(spread).alias("alone"), F.sum(spread * (n - 1)).alias("together")
    ).first()
    if not row["together"]:
        return STRONGEST
    r = (row["seen"] - row["alone"]) / row["together"]
    return min(STRONGEST, max(WEAKEST, 1 / r - 1)) if r > 0 else STRONGEST


def shrunk(groups: DataFrame, k: float) -> DataFrame:
    """``mean``: the share of bad outcomes, drawn to the prior as if that were ``k`` labels."""
    return groups.withColumn("mean", (F.col("bad") + k * F.col("prior")) / (F.col("n") + k))


def reputation(pages: DataFrame, z: float = Z) -> DataFrame:
    """(host, bad or null) rows to ``host, n, bad, bound``."""
    domain, suffix = levels(F.col("host"))
    hosts = cut(pages.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).withColumns({"domain": domain, "suffix": suffix}))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    overall = ((total["bad"] or 0) + 0.5) / ((total["n"] or 0) + 1.0)
    add = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = hosts.groupBy("domain", "suffix").agg(*add)
    suffixes = domains.groupBy("suffix").agg(*add).withColumn("prior", F.lit(overall))
    suffixes = cut(shrunk(suffixes, strength(suffixes)))
    domains = salted_lookup(domains, suffixes.select("suffix", F.col("mean").alias("prior")), "suffix", ["domain"])
    domains = cut(domains)
    domains = shrunk(domains, strength(domains))
    hosts = cut(salted_lookup(hosts, domains.select("domain", F.col("mean").alias("prior")), "domain", ["host"]))
    k = strength(hosts)
    mean = F.col("mean")
    deviation = F.sqrt(mean * (1 - mean) / (F.col("n") + k + 1))
    return shrunk(hosts, k).select("host", "n", "bad", (mean - z * deviation).alias("bound"))


def judge(pages: DataFrame, labels: DataFrame, rules: list[Rule] = RULES, max_bad: float = MAX_BAD, z: float = Z) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict``, the host's labelled and bad pages, and the bound."""
    host, path = split_url(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    seen = parts.select("page_id", "host").join(outcomes(labels), "page_id", "left").select("host", "bad")
    known = salted_lookup(parts, reputation(seen, z), "host", ["page_id", "path"])
    rule = fitting_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("bound") > max_bad, "block").otherwise("allow")
    return known.withColumn("fit", rule).select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", method).alias("verdict"),
        F.col("n").alias("n_labelled"), F.col("bad").cast("long").alias("n_bad"), F.round("bound", 6).alias("bad_bound"),
    )


def report(pages: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(pages, labels)
