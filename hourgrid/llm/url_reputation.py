"""URL filter: rules first, then the reputation that a host has by its labelled pages."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourgrid.sources.scratch import store

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    """``host`` and all its subdomains, where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Reputation:
    """Block a host if the share of bad pages is above ``tolerated`` at the lower bound, ``deviations``
    posterior standard deviations below the mean.
    """

    tolerated: float = 0.35
    deviations: float = 1.645
    least_correlation: float = 1e-4
    most_correlation: float = 0.9


def host_of(url: Column) -> Column:
    after = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return F.translate(F.coalesce(F.regexp_extract(after, r"^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    after = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as struct of text and verdict; equally long: the first given."""
    ordered = sorted(rules, key=lambda r: -len(r.text))
    cases = []
    for rule in ordered:
        inside = (host == rule.host) | host.endswith("." + rule.host)
        cases.append((inside & path.startswith(rule.path), F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))))
    nothing = F.lit(None).cast("struct<rule:string,verdict:string>")
    return reduce(lambda rest, case: F.when(case[0], case[1]).otherwise(rest), reversed(cases), nothing)


def _levels(host: Column) -> dict[str, Column]:
    """Suffix and registered domain: the last label and the last two, without user, port and final dot; an
    address of numbers is its own domain, of the suffix "ip".
    """
    bare = F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r"(:[0-9]*)?\.?$", "")
    number = bare.rlike(r"^([0-9]{1,3}(\.[0-9]{1,3}){3}|\[.*)$")
    return {
        "suffix": F.when(number, F.lit("ip")).otherwise(F.substring_index(bare, ".", -1)),
        "domain": F.when(number, bare).otherwise(F.substring_index(bare, ".", -2)),
    }


def _shrunk(level: DataFrame, keys: list[str], parent_mean: str, mean: str, settings: Reputation) -> DataFrame:
    """Add the posterior mean of every group, shrunk towards its parent's.

    The prior of a level is one beta distribution per parent with a common correlation, which the method of moments
    takes from how far the groups' shares lie from their parents' means.
    """
    m = F.col(parent_mean)
    share = F.col("x") / F.col("n")
    moments = level.agg(
        F.sum(F.col("n") * (share - m) * (share - m)).alias("spread"),
        (F.sum(F.col("n") * m * (1 - m)) / F.sum("n")).alias("plain"),
        F.count("*").alias("groups"),
        F.sum("n").alias("rows"),
    )
    raw = (F.col("spread") / F.col("plain") - F.col("groups")) / (F.col("rows") - F.col("groups"))
    usable = (F.col("plain") > 0) & (F.col("rows") > F.col("groups"))
    rho = F.least(F.greatest(F.when(usable, raw).otherwise(settings.least_correlation), F.lit(settings.least_correlation)), F.lit(settings.most_correlation))
    strength = moments.select((1 / rho - 1).alias(f"{mean}_strength"))
    kappa = F.col(f"{mean}_strength")
    # The moments are one row.
    return level.join(F.broadcast(strength)).select(
        *keys, "x", "n", kappa, m, ((F.col("x") + kappa * m) / (F.col("n") + kappa)).alias(mean)
    )


def _backed_off(hosts: DataFrame, by_host: DataFrame, by_domain: DataFrame, by_suffix: DataFrame, overall: DataFrame) -> DataFrame:
    """Hosts without labelled pages, with the mean of the lowest level that has some and the hosts' prior strength."""
    seen = by_host.select("host")
    unseen = hosts.where("host IS NOT NULL AND host <> ''").select("host").distinct().join(seen, "host", "left_anti").withColumns(_levels(F.col("host")))
    found = unseen.join(by_domain.select("suffix", "domain", "m2"), ["suffix", "domain"], "left").join(by_suffix.select("suffix", "m1"), "suffix", "left")
    # Both are one row.
    strength = by_host.agg(F.first("m3_strength").alias("m3_strength"))
    none = F.lit(0).cast("long")
    return found.join(F.broadcast(overall)).join(F.broadcast(strength)).select(
        "host", none.alias("x"), none.alias("n"), "m3_strength", F.coalesce("m2", "m1", "m0").alias("m3")
    )


def host_reputation(outcomes: DataFrame, settings: Reputation = Reputation(), hosts: DataFrame | None = None) -> DataFrame:
    """(host, n, x, posterior_mean, lower_bound, blocked) from (host, bad) rows, where bad is 0 or 1.

    Each level is shrunk to the one above: host to registered domain to suffix to all labelled pages. Rows with a null
    host or outcome do not count. Counts are taken per host before anything is joined, so a hot host
    is one row from there on. Those of ``hosts`` without labelled pages get rows too, with n = 0 and the mean of
    their domain, else of their suffix, else of all labelled pages.
    """
    known = outcomes.where("host IS NOT NULL AND bad IS NOT NULL")
    # Each level is read several times; stored, it keeps the plan small.
    keep = store
    counted = known.groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").cast("long").alias("x"))
    counted = keep(counted.withColumns(_levels(F.col("host"))), "host-counts")
    domains = counted.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    overall = suffixes.agg((F.sum("x") / F.sum("n")).alias("m0"))
    by_suffix = keep(_shrunk(suffixes.join(F.broadcast(overall)), ["suffix"], "m0", "m1", settings), "host-suffixes")
    by_domain = _shrunk(domains.join(by_suffix.select("suffix", "m1"), "suffix"), ["suffix", "domain"], "m1", "m2", settings)
    by_domain = keep(by_domain, "host-domains")
    by_host = _shrunk(counted.join(by_domain.select("suffix", "domain", "m2"), ["suffix", "domain"]), ["host"], "m2", "m3", settings)
    by_host = keep(by_host, "host-means")
    by_host = by_host.select("host", "x", "n", "m3_strength", "m3")
    if hosts is not None:
        by_host = by_host.unionByName(_backed_off(hosts, by_host, by_domain, by_suffix, overall))
    total = F.col("n") + F.col("m3_strength")
    bound = F.col("m3") - settings.deviations * F.sqrt(F.col("m3") * (1 - F.col("m3")) / (total + 1))
    return by_host.select(
        "host",
        "n",
        "x",
        F.round("m3", 6).alias("posterior_mean"),
        F.round(F.greatest(bound, F.lit(0.0)), 6).alias("lower_bound"),
        (bound > settings.tolerated).alias("blocked"),
    )


def judge_urls(pages: DataFrame, rules: list[Rule], reputation: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict, posterior_mean, lower_bound, labelled) of every page.

    The longest fitting rule decides, else the host's reputation; a host that has none there is allowed, as
    is a null url or one without "://", whose host and path are empty. Null and repeated page ids and copies
    stay as they are; extra columns are not read; an empty table gives an empty one. Only hosts are
    joined on, one reputation row each; a hot host's pages can be split over tasks.
    """
    cut = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = reputation.select("host", "posterior_mean", "lower_bound", "n", "blocked")
    joined = cut.join(known, "host", "left").withColumn("_rule", matching_rule(F.col("host"), F.col("path"), rules))
    earned = F.when(F.coalesce("blocked", F.lit(False)), BLOCK).otherwise(ALLOW)
    return joined.select(
        "page_id",
        "host",
        "path",
        F.col("_rule.rule").alias("rule"),
        F.coalesce("_rule.verdict", earned).alias("verdict"),
        "posterior_mean",
        "lower_bound",
        F.coalesce("n", F.lit(0).cast("long")).alias("labelled"),
    )
