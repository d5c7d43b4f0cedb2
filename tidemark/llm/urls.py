"""URL filter with DataFrame functions only: fixed rules, then empirical-Bayes reputation of hosts.

Page outcomes (bad or not) are counted by host, registered domain and suffix. Going down from all
pages to suffix, domain and host, each level's rate is shrunk to the one above through a beta-binomial
prior: mean = (bad + m * mean above) / (n + m). The concentration m of each level is estimated from
the counts by moments: with rates spread about the mean above as beta-binomial ones, the expectation of
sum(n * (rate - above)^2 / (above * (1 - above))) is K + rho * sum(n - 1) over K members, and
m = 1 / rho - 1, kept from ``LEAST`` to ``MOST``; ``strength`` where no member has two pages.
A host is blocked if the lower bound of its posterior, mean - z * standard deviation of the beta
distribution, is above ``threshold``. Hosts without an outcome take the posterior of the first level
above that has one: domain, suffix, all pages.

Reputation looks at the host without user, port and a last dot; an IP address is a domain of its own,
with the suffix ``ip``. A suffix is the last label; the last two, if a second-level label of
``SECOND`` stands before a country's two letters; or the longest of a list that is given, such as the
public suffix list.

At scale: outcomes are counted by host with map-side partial sums and written; levels above are sums
of that table, never of pages again; the different hosts of the pages meet the levels, and the page
table meets those hosts in one join, which adaptive execution splits for a hot host.

Cases: a null url, or one without ``://``, has empty host and path and no rule; its host is the empty
host. Null outcomes don't count. Repeated rows are judged each. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import only
from tidemark.sources.shared import written

#: Fixed values: (host, path, verdict) as the contract has them.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Second-level labels under which countries' registries sell names.
SECOND = ("ac", "co", "com", "edu", "gob", "gov", "go", "mil", "ne", "net", "nom", "or", "org", "sch")
#: The letters that are lower-cased.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bounds of the estimated concentrations.
LEAST, MOST = 1.0, 1000.0


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def name_of(host: Column) -> Column:
    """The host without user, port and last dot."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"(?::[0-9]*)?$|\.(?::[0-9]*)?$", "")


def is_address(name: Column) -> Column:
    return name.rlike(r"^(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|\[.*\]?)$")


def suffix_of(name: Column, suffixes: Iterable[str] = ()) -> Column:
    """The public suffix of a host's ``name``."""
    two = F.substring_index(name, ".", -2)
    out = F.when(two.rlike(rf"^(?:{'|'.join(SECOND)})\.[a-z]{{2}}$"), two).otherwise(F.substring_index(name, ".", -1))
    by: dict[int, list[str]] = {}
    for s in suffixes:
        by.setdefault(s.count(".") + 1, []).append(s)
    for n in sorted(by):
        out = F.when(F.substring_index(name, ".", -n).isin(by[n]), F.substring_index(name, ".", -n)).otherwise(out)
    return F.when(is_address(name), F.lit("ip")).otherwise(out)


def domain_of(name: Column, suffix: Column) -> Column:
    """The registered domain: the suffix and one label more, if there is one."""
    labels = F.split(name, r"\.")
    n = F.least(F.size(F.split(suffix, r"\.")) + 1, F.size(labels))
    return F.when(is_address(name), name).otherwise(F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), or null; length is that of host and path together."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _levels(df: DataFrame, suffixes: Iterable[str]) -> DataFrame:
    """``df`` (host) with domain and suffix."""
    return df.withColumn("_name", name_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("_name"), suffixes)).withColumn("domain", domain_of(F.col("_name"), F.col("suffix"))).drop("_name")


def shrunk(rows: DataFrame, above: Column, strength: float, out: str) -> DataFrame:
    """``rows`` (n, b) with ``out``: a struct of n, b, the mean r and the concentration m, shrunk to ``above`` as the counts of all rows suggest."""
    rows = rows.withColumn("_above", above)
    spread = F.sum(F.col("n") * F.pow(F.col("b") / F.col("n") - F.col("_above"), 2) / (F.col("_above") * (1 - F.col("_above"))))
    more = F.sum(F.col("n") - 1)
    rho = F.greatest((spread - F.count("*")) / more, F.lit(1e-9))
    m = rows.agg(F.when(more > 0, F.least(F.greatest(1 / rho - 1, F.lit(LEAST)), F.lit(MOST))).otherwise(strength)).scalar()
    return rows.withColumn("_m", m).withColumn(out, F.struct("n", "b", ((F.col("b") + F.col("_m") * F.col("_above")) / (F.col("n") + F.col("_m"))).alias("r"), F.col("_m").alias("m"))).drop("_above", "_m")


def reputation(hosts: DataFrame, outcomes: DataFrame, strength: float = 20.0, z: float = 1.645, suffixes: Iterable[str] = ()) -> DataFrame:
    """One row for each different host of ``hosts`` (host): n, bad, rate and lower bound of the posterior by ``outcomes`` (host, bad).

    They are those of the host, else of its domain, else of its suffix, else of all pages; null without any outcome.
    """
    suffixes = tuple(suffixes)
    seen = only(outcomes, host="string", bad="long").where("bad is not null")
    counts = seen.groupBy(F.coalesce("host", F.lit("")).alias("host")).agg(F.count("*").alias("n"), F.sum("bad").alias("b"))
    known = written(_levels(counts, suffixes), "hosts")
    every = known.agg(
        F.when(F.count("*") > 0, F.struct(F.sum("n").alias("n"), F.sum("b").alias("b"), ((F.sum("b") + 1.0) / (F.sum("n") + 2.0)).alias("r"), F.lit(strength).alias("m")))
    ).scalar()
    # each level is written, as it is read twice: for its concentration and by the level below
    ends = written(shrunk(known.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("b").alias("b")), every["r"], strength, "s").select("suffix", "s"), "suffixes")
    domains = known.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("b").alias("b")).join(ends, "suffix")
    domains = written(shrunk(domains, F.col("s.r"), strength, "d").select("domain", "d"), "domains")
    known = shrunk(known.join(domains, "domain"), F.col("d.r"), strength, "h").select("host", "h")
    rows = _levels(only(hosts, host="string").distinct(), suffixes)
    rows = rows.join(known, "host", "left").join(domains, "domain", "left").join(ends, "suffix", "left")
    rows = rows.select("host", F.coalesce("h", "d", "s", every).alias("x")).select("host", "x.n", F.col("x.b").alias("bad"), F.col("x.r").alias("rate"), "x.m")
    sd = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.col("m") + 1.0))
    return rows.withColumn("lower", F.col("rate") - z * sd).drop("m")


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad) for the pages whose id is labelled: bad is low quality or toxic. Repeated labels of an id count once, the worst."""
    known = only(labels, doc_id="long", quality="int", toxic="int")
    known = known.groupBy("doc_id").agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    return only(pages, page_id="long", url="string").join(known, F.col("page_id") == F.col("doc_id")).select(host_of(F.col("url")).alias("host"), "bad")


def judge(pages: DataFrame, outcomes: DataFrame, threshold: float = 0.5, strength: float = 20.0, z: float = 1.645, rules=RULES, suffixes: Iterable[str] = ()) -> DataFrame:
    """For each page: host, path, rule, verdict (the rule's, else the reputation's), and the posterior of its host or of the level that the host inherits from."""
    rows = only(pages, page_id="long", url="string").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = reputation(rows, outcomes, strength, z, suffixes)
    rows = rows.withColumn("_r", rule_of(F.col("host"), F.col("path"), rules)).join(known, "host", "left")
    verdict = F.coalesce(F.col("_r.verdict"), F.when(F.col("lower") > threshold, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), verdict.alias("verdict"), "n", "bad", "rate", "lower")
