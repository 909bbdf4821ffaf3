"""URL filters: rules by host and path, and Empirical-Bayes host reputation for the rest.

Labelled page outcomes are counted per host. A host's rate of bad pages is shrunk towards its registered
domain's, that one towards its suffix's, and that one towards the overall rate, each by a beta prior whose
strength is estimated from how much the rates of that level scatter (method of moments). A host is blocked
when the lower bound of its posterior rate exceeds a threshold. Everything is DataFrame code.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchantlens.llm.common import hot_keys, join_lookup, stored

LEVELS = ("suffix", "domain", "host")
# Second levels under which countries register domains.
SECOND_LEVEL = r"(?:^|\.)(?:ac|co|com|edu|go|gov|ne|net|or|org)\.[a-z][a-z]$"
# What stands for the suffix of numeric addresses; no host ends like that.
ADDRESS = "(address)"
OUTCOMES = ("_host", "_path", "_rule", "_verdict", "_n_labelled", "_n_bad", "_bad_rate", "_bad_rate_lower")


@dataclass(frozen=True)
class UrlRule:
    """``rule`` is a host, with all its subdomains, and the start of a path."""

    verdict: str
    rule: str

    @property
    def host(self) -> str:
        return self.rule.split("/", 1)[0]

    @property
    def path(self) -> str:
        return self.rule[len(self.host) :]


@dataclass(frozen=True)
class Reputation:
    """Block where the posterior mean less ``z`` standard deviations exceeds ``most_bad``."""

    most_bad: float = 0.5
    z: float = 1.64
    least_strength: float = 2.0
    most_strength: float = 1000.0


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for a null url and one without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, path


def matching_rule(host: Column, path: Column, rules: Sequence[UrlRule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, null if none does; blocking wins a tie."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule in sorted(rules, key=lambda r: (len(r.rule), r.verdict == "block")):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.rule).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def host_levels(host: Column) -> dict[str, Column]:
    """The host with its registered domain and suffix.

    The suffix is the last label, or the last two where they are a country's usual second level; the
    domain has one label more. User names and ports do not count; an address is a domain of its own.
    """
    name = F.regexp_replace(host, r"^.*@|:\d*$", "")
    address = name.rlike(r"^[\d.]+$|^\[")
    second = name.rlike(SECOND_LEVEL)
    suffix = F.when(second, F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1))
    domain = F.when(second, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))
    return {
        "suffix": F.when(address, F.lit(ADDRESS)).otherwise(suffix),
        "domain": F.when(address, name).otherwise(domain),
        "host": host,
    }


def host_reputation(outcomes: DataFrame, setting: Reputation | None = None, hosts: DataFrame | None = None) -> DataFrame:
    """(host, n_labelled, n_bad, mean, lower) from rows (host, bad); ``bad`` is 0, 1 or null (not counted).

    ``hosts`` are judged as well, those without an outcome by their domain, suffix and the overall rate.
    Counts are summed before the shuffle, so a host with most of the pages is one row per task.
    """
    setting = setting or Reputation()
    rows = outcomes.select("host", F.col("bad").cast("long").alias("bad"))
    if hosts is not None:
        rows = rows.unionByName(hosts.select("host", F.lit(None).cast("long").alias("bad")))
    per_host = rows.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    per_host = stored(per_host.where("host IS NOT NULL").withColumns(host_levels(F.col("host"))), "host-outcomes")
    total = per_host.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    # One pseudo-observation each keeps the overall rate inside (0, 1), without labels too.
    overall = ((total["k"] or 0) + 1.0) / ((total["n"] or 0) + 2.0)
    parent = None
    for depth, level in enumerate(LEVELS):
        keys = list(LEVELS[: depth + 1])
        counts = per_host.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        if parent is None:
            counts = counts.withColumn("prior", F.lit(overall))
        else:
            # A domain may have very many hosts, and a suffix very many domains: such rows stay in place.
            counts = stored(counts, f"outcomes-{level}")
            sizes = counts.groupBy(*keys[:-1]).agg(F.count("*").alias("size"))
            counts = join_lookup(counts, parent, keys[:-1], hot_keys(sizes, keys[:-1], "size", counts.count()))
        counts = stored(counts, f"reputation-{level}")
        strength = _strength(counts, setting)
        alpha = F.col("prior") * strength + F.col("k")
        beta = (1 - F.col("prior")) * strength + (F.col("n") - F.col("k"))
        mean = alpha / (alpha + beta)
        spread = F.sqrt(mean * (1 - mean) / (alpha + beta + 1))
        shrunk = counts.select(*keys, "n", "k", mean.alias("mean"), (mean - setting.z * spread).alias("lower"))
        parent = shrunk.select(*keys, F.col("mean").alias("prior"))
    return shrunk.select("host", F.col("n").alias("n_labelled"), F.col("k").alias("n_bad"), "mean", "lower")


def _strength(counts: DataFrame, setting: Reputation) -> float:
    """Prior observations that explain the scatter of a level's counts around their parents' rates."""
    n, prior = F.col("n"), F.col("prior")
    binomial = n * prior * (1 - prior)
    row = counts.agg(
        F.sum((F.col("k") - n * prior) ** 2).alias("scatter"),
        F.sum(binomial).alias("binomial"),
        F.sum(binomial * (n - 1)).alias("excess"),
    ).first()
    if not row["excess"]:
        return setting.most_strength
    correlation = (row["scatter"] - row["binomial"]) / row["excess"]
    if correlation <= 0:
        return setting.most_strength
    return min(setting.most_strength, max(setting.least_strength, 1 / correlation - 1))


def filter_urls(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[UrlRule], setting: Reputation | None = None, url: str = "url"
) -> DataFrame:
    """``pages`` with ``_host``, ``_path``, ``_rule``, ``_verdict``, the host's counts and its posterior.

    A rule's verdict stands before the reputation's. ``outcomes`` has one row (host, bad) per labelled page;
    a host without one has the reputation of its domain, suffix or all pages. A page without a host is
    allowed and has no posterior. Hosts that hold many pages are joined without being moved. Columns of
    ``pages`` that are called like one of the new ones give way.
    """
    setting = setting or Reputation()
    own = [name for name in pages.columns if name not in OUTCOMES]
    host, path = url_parts(F.col(url))
    parted = pages.select(*own, host.alias("_host"), path.alias("_path"))
    sizes = stored(parted.groupBy("_host").agg(F.count("*").alias("n")), "host-sizes")
    hot = hot_keys(sizes, "_host", "n", parted.count())
    hosts = sizes.where("_host != ''").select(F.col("_host").alias("host"))
    known = host_reputation(outcomes, setting, hosts).select(
        F.col("host").alias("_host"), F.col("n_labelled").alias("_n_labelled"), F.col("n_bad").alias("_n_bad"),
        F.col("mean").alias("_bad_rate"), F.col("lower").alias("_bad_rate_lower"),
    )
    judged = join_lookup(parted, known, "_host", hot)
    rule = matching_rule(F.col("_host"), F.col("_path"), rules)
    by_host = F.when(F.coalesce(F.col("_bad_rate_lower") > setting.most_bad, F.lit(False)), "block").otherwise("allow")
    return judged.select(
        *own, "_host", "_path", rule["rule"].alias("_rule"),
        F.coalesce(rule["verdict"], by_host).alias("_verdict"),
        F.coalesce("_n_labelled", F.lit(0)).alias("_n_labelled"), F.coalesce("_n_bad", F.lit(0)).alias("_n_bad"),
        "_bad_rate", "_bad_rate_lower",
    )
