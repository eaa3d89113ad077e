"""URL filters: rules by host and path, and empirical-Bayes reputation of hosts.

A rule names a host with its subdomains and a start of the path; of the rules that fit,
the longest decides. All other pages are judged by the reputation of their host:

Labelled pages are good or bad. The share of bad pages of a suffix, of the registered
domains in it, and of the hosts in those is taken as beta-binomial, level by level. The
prior of a level is a beta distribution with the posterior mean of the level above
and a strength fitted over all its units by the method of moments: units that differ
no more than chance are shrunk hard, units that differ are not. A page is blocked if
the lower bound of its host's posterior (mean less ``DEVIATIONS`` standard deviations) exceeds
``MOST_BAD``. Hosts without a label take the posterior of their domain, domains
that of their suffix, and suffixes that of all pages.

Counts are aggregated before anything is joined, by host first and then upwards, so a
host with a third of all pages is one row. A url without ``://`` and a null one have an
empty host and path, which no rule fits; their host is the empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

MOST_BAD = 0.5
DEVIATIONS = 1.64
#: Bounds of a prior's strength, in pages.
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 200.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Suffixes of two labels under which domains are registered.
TWO_LABELS = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in")


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> Column:
    """The longest rule that fits, as struct<rule, verdict>; null if none does."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        chosen = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABELS), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """The suffix and the label before it."""
    long = F.substring_index(host, ".", -2).isin(*TWO_LABELS)
    return F.when(long, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def _strength(units: DataFrame, mean: Column) -> Column:
    """Strength of the beta prior of units with ``bad`` of ``n`` and a mean from above, by the method of moments.

    Expected over units: sum (bad - n m)^2 = sum n m (1 - m) (1 + (n - 1) rho), with
    rho = 1 / (strength + 1).
    """
    noise = F.col("n") * mean * (1 - mean)
    excess = F.sum((F.col("bad") - F.col("n") * mean) ** 2 - noise)
    room = F.sum(noise * (F.col("n") - 1))
    rho = F.when(room > 0, excess / room)
    fitted = F.when(rho.isNull() | (rho <= 0), F.lit(MOST_STRENGTH)).when(rho >= 1, F.lit(LEAST_STRENGTH)).otherwise(1 / rho - 1)
    return F.least(F.greatest(fitted, F.lit(LEAST_STRENGTH)), F.lit(MOST_STRENGTH))


def reputations(labelled: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Posterior ``a, b`` of all pages, suffixes, domains and hosts, from rows with ``host`` and ``bad`` (0 or 1).

    Each level is a table of its units; the first has one row.
    """
    count = (F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    hosts = labelled.where("bad is not null").groupBy("host").agg(F.sum(F.col("bad").cast("double")).alias("bad"), F.count("*").alias("n"))
    hosts = stored(hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(*count)
    suffixes = domains.groupBy("suffix").agg(*count)
    whole = suffixes.agg(*count)
    n, bad = F.coalesce("n", F.lit(0)), F.coalesce("bad", F.lit(0.0))
    above = whole.select((bad + 0.5).alias("a"), (n - bad + 0.5).alias("b"))
    levels = [above]
    for units, key in ((suffixes, None), (domains, "suffix"), (hosts, "domain")):
        mean = above.select(*([key] if key else []), (F.col("a") / (F.col("a") + F.col("b"))).alias("m"))
        joined = units.crossJoin(F.broadcast(mean)) if key is None else units.join(mean, key)  # one row of all pages
        strength = joined.agg(_strength(joined, F.col("m")).alias("s"))
        joined = joined.crossJoin(F.broadcast(strength))  # one row
        a, b = F.col("m") * F.col("s") + F.col("bad"), (1 - F.col("m")) * F.col("s") + F.col("n") - F.col("bad")
        above = joined.withColumn("a", a).withColumn("b", b)
        levels.append(above)
    return tuple(levels)


def lower_bound(a: Column, b: Column, deviations: float = DEVIATIONS) -> Column:
    return a / (a + b) - deviations * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))


def judge(
    pages: DataFrame, labelled: DataFrame, rules: tuple[UrlRule, ...] = (), most_bad: float = MOST_BAD, deviations: float = DEVIATIONS
) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each row of ``pages`` (``page_id, url``).

    ``labelled`` has ``url`` and ``bad`` (0, 1 or null).
    """
    whole, suffixes, domains, hosts = reputations(labelled.select(host_of(F.col("url")).alias("host"), "bad"))
    url = F.col("url")
    own = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    known = own.select("host").distinct().withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    sides = [(hosts.select("host", "a", "b"), "host"), (domains.select("domain", "a", "b"), "domain"), (suffixes.select("suffix", "a", "b"), "suffix")]
    for i, (side, key) in enumerate(sides):
        known = known.join(side.withColumnsRenamed({"a": f"a{i}", "b": f"b{i}"}), key, "left")
    known = known.crossJoin(F.broadcast(whole.withColumnsRenamed({"a": "a3", "b": "b3"})))  # one row
    a, b = (F.coalesce(*(F.col(f"{x}{i}") for i in range(4))) for x in "ab")
    known = known.select("host", (lower_bound(a, b, deviations) > most_bad).alias("bad_host"))
    rule = rule_for(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("bad_host"), F.lit("block")).otherwise(F.lit("allow"))
    joined = own.withColumn("rule", rule).join(known, "host", "left")
    return joined.select("page_id", "host", "path", F.col("rule.rule").alias("rule"), F.coalesce("rule.verdict", method).alias("verdict"))
