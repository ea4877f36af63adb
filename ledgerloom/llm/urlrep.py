"""URL filters: empirical-Bayes host reputation, all in DataFrame expressions.

Labelled page outcomes are counted by host, registered domain (the suffix and one label more) and suffix (the last label, or two where a
country's code follows one of a few names such as `co`). Each level's rate
has a beta prior whose mean is the posterior mean of the level above; its strength comes from how much more the rates
of that level's groups differ than chance would have them (method of moments). A host whose lower posterior bound of
the bad rate is over the threshold is blocked; a host without outcomes inherits its domain's or suffix's posterior.

Explicit rules come first: of those whose host is the url's or a parent of it and whose path begins the url's, the longest
decides.

Outcomes are counted by host before anything is shuffled, levels meet the distinct hosts of the pages, and only the hosts that are
blocked meet the pages again, so a host with a third of all pages costs no more than another.

Defined results: a null url, and one without `://`, has empty host and path and is judged like a host without outcomes; a
null page_id is carried along; repeated rows are judged each; outcomes that are null are not counted; without any outcome
nothing but the rules blocks; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed values of the contract.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))
#: Labels under which registrars of two-letter countries sell names.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "go", "gob", "gouv", "ne", "net", "or", "org")
#: Standard deviations below the posterior mean, bad rate that blocks, and range of a prior's strength.
BOUND, THRESHOLD, WEAKEST, STRONGEST = 1.645, 0.5, 2.0, 500.0


def with_parts(pages: DataFrame) -> DataFrame:
    """Adds host and path."""
    url = F.coalesce(F.col("url"), F.lit(""))
    return pages.withColumn("host", F.translate(F.regexp_extract(url, "^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER)).withColumn("path", F.regexp_extract(url, "^(?s:.*?)://[^/?#]*([^?#]*)", 1))


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def ruled(rules: tuple[Rule, ...], host: Column, path: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        hit = fits(r, host, path)
        name, verdict = F.when(hit, F.lit(r.name)).otherwise(name), F.when(hit, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def _strength(groups: DataFrame, key: str, parent_mean: str) -> DataFrame:
    """One row: the strength of the prior under which rates of `groups` (key, n, bad, parent_mean) differ as they do."""
    n, rate, mean = F.col("n").cast("double"), F.col("bad") / F.col("n").cast("double"), F.col(parent_mean)
    spread = F.sum(n * (rate - mean) * (rate - mean)) - F.sum(mean * (1 - mean))
    scale = F.sum(n) - F.sum(n * n) / F.sum(n)
    got = groups.agg(spread.alias("spread"), scale.alias("scale"), (F.sum(n * mean * (1 - mean)) / F.sum(n)).alias("noise"))
    between = F.when((F.col("scale") > 0) & (F.col("spread") > 0), F.col("spread") / F.col("scale"))
    return got.select(F.coalesce(F.greatest(F.lit(WEAKEST), F.least(F.lit(STRONGEST), F.col("noise") / between - 1)), F.lit(STRONGEST)).alias("strength"))


def levels(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host."""
    labels = F.split(host, "\\.")
    n = F.when((F.size(labels) >= 3) & F.element_at(labels, -1).rlike("^[a-z]{2}$") & F.get(labels, F.size(labels) - 2).isin(*SECOND_LEVEL), 2).otherwise(1)
    last = lambda k: F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - k + 1), k), ".")
    return last(n + 1), last(n)


def _lower(mean: Column, total: Column) -> Column:
    return F.greatest(F.lit(0.0), mean - BOUND * F.sqrt(mean * (1 - mean) / (total + 1)))


def _by_level(outcomes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Hosts with their posteriors, and for a host without outcomes the lower bounds by domain, by suffix and of the whole: what
    is above the first level without outcomes is its prior."""
    domain, suffix = levels(F.col("host"))
    hosts = outcomes.where("bad is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad")).withColumn("domain", domain).withColumn("suffix", suffix)
    hosts = written(hosts, "hosts")  # all levels are counted from it
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    whole = suffixes.agg((F.sum("bad") / F.sum("n").cast("double")).alias("prior"))

    def shrunk(groups: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
        one = written(_strength(groups, key, "prior"), "strength")
        a = F.col("bad") + F.col("prior") * F.col("strength")
        total = F.col("n") + F.col("strength")
        return groups.crossJoin(F.broadcast(one)).withColumn("mean", a / total).withColumn("total", total), one

    def unseen(priors: DataFrame, strength: DataFrame, name: str) -> DataFrame:
        return priors.crossJoin(F.broadcast(strength)).withColumn(name, _lower(F.col("prior"), F.col("strength"))).drop("prior", "strength")

    s, of_suffixes = shrunk(suffixes.crossJoin(F.broadcast(whole)), "suffix")
    s = written(s.select("suffix", F.col("mean").alias("prior")), "suffixes")
    d, of_domains = shrunk(domains.join(s, "suffix"), "domain")
    d = written(d.select("domain", F.col("mean").alias("prior")), "domains")
    h, of_hosts = shrunk(hosts.join(d, "domain"), "host")
    h = h.select("host", "n", "bad", "mean", _lower(F.col("mean"), F.col("total")).alias("lower"))
    return h, unseen(d, of_hosts, "_domain"), unseen(s, of_domains, "_suffix"), unseen(whole, of_suffixes, "_whole")


def posteriors(outcomes: DataFrame) -> DataFrame:
    """(host, n, bad, mean, lower) from `outcomes` (host, bad 0/1 or null)."""
    return _by_level(outcomes)[0]


def judged(pages: DataFrame, outcomes: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of `pages` (page_id, url), from `outcomes` (host, bad)."""
    own, by_domain, by_suffix, whole = _by_level(outcomes)
    parts = with_parts(pages.select("page_id", "url"))
    domain, suffix = levels(F.col("host"))
    hosts = parts.select("host").distinct().withColumn("domain", domain).withColumn("suffix", suffix)
    known = hosts.join(own.select("host", F.col("lower").alias("_host")), "host", "left").join(by_domain, "domain", "left").join(by_suffix, "suffix", "left").crossJoin(F.broadcast(whole))
    bad = written(known.where(F.coalesce("_host", "_domain", "_suffix", "_whole") > threshold).select(F.col("host").alias("bad_host")), "bad")
    name, verdict = ruled(rules, F.col("host"), F.col("path"))
    joined = parts.join(bad, parts.host == bad.bad_host, "left")
    by_method = F.when(F.col("bad_host").isNotNull(), "block").otherwise("allow")
    return joined.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, by_method).alias("verdict"))


def outcomes_by_number(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad): the labels of documents whose number ends a page's path; bad is a quality of 0."""
    number = F.regexp_extract("path", "/([0-9]{1,18})(?:\\.html)?/?$", 1)
    numbered = with_parts(pages.select("url")).select("host", F.when(number != "", number).cast("long").alias("doc_id")).where("doc_id is not null")
    marks = labels.where("quality is not null and doc_id is not null").select("doc_id", (F.col("quality") == 0).cast("int").alias("bad"))
    return numbered.join(marks, "doc_id").select("host", "bad")
