"""Empirical-Bayes reputation of hosts, and url rules that go before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize

#: (verdict, host, path): a rule fits its host and all subdomains where the url's path starts with the rule's.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: How many labelled pages a prior counts for at a level where nothing can be learned of it, and the least and most.
PRIOR_WEIGHT, LEAST_WEIGHT, MOST_WEIGHT = 8.0, 0.5, 1000.0
#: A host is blocked when its share of bad pages lies above this with the confidence of Z normal deviations.
BAD_SHARE, Z = 0.2, 1.2815515655446004
#: Labels that form a suffix together with a country's two letters, as in co.uk.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "go", "ne", "net", "or", "org")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, nulls where none does."""
    fits = []
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fit = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        fits.append((fit, rule_host + rule_path, verdict))

    def first(k: int) -> Column:
        return F.coalesce(*[F.when(fit[0], F.lit(fit[k])) for fit in fits], F.lit(None).cast("string"))

    return first(1), first(2)


def levels(host: Column, second_level: tuple[str, ...] = SECOND_LEVEL) -> tuple[Column, Column]:
    """Registered domain and suffix of a host, without user and port.

    The suffix is the last label, or the last two where the last has two letters and the one before is of
    ``second_level``; the domain has one label more. An IP address is a domain by itself, with an empty suffix.
    """
    name = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    address, two = name.rlike(ADDRESS), name.rlike(two_labels(second_level))
    domain = F.when(address, name).when(two, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))
    suffix = F.when(address, "").when(two, F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1))
    return domain, suffix


#: A host that is an address, not a name.
ADDRESS = r"^[0-9.]+$|^\["


def two_labels(second_level: tuple[str, ...]) -> str:
    return r"(?:^|\.)(?:" + "|".join(second_level) + r")\.[a-z][a-z]$"


def spread(bad: Column, n: Column, mean: Column) -> tuple[Column, Column]:
    """Excess of the outcomes' squared deviations over those of independent pages, and what a correlation of 1 would make of it."""
    return F.sum((bad - n * mean) * (bad - n * mean) - n * mean * (1 - mean)), F.sum(n * (n - 1) * mean * (1 - mean))


def prior_weight(groups: DataFrame, bad: str, n: str, mean: Column) -> float:
    """The pages that a prior counts for, by moments: with prior means m the outcomes of groups of n pages have variance
    n m (1 - m) (1 + (n - 1) r), r = 1 / (weight + 1). Groups that differ much have a weak prior, alike ones a strong one.

    Without a group of two labelled pages or more it is PRIOR_WEIGHT; it stays between LEAST_WEIGHT and MOST_WEIGHT.
    """
    above, full = groups.agg(*spread(F.col(bad).cast("double"), F.col(n).cast("double"), mean)).first()
    if not full or full <= 0:
        return PRIOR_WEIGHT
    return 1 / min(max(above / full, 1 / (1 + MOST_WEIGHT)), 1 / (1 + LEAST_WEIGHT)) - 1


def reputation(hosts: DataFrame, z: float = Z) -> DataFrame:
    """Shrinks labelled outcomes from the corpus to suffix, registered domain and host.

    ``hosts(host, domain, suffix, n_bad, n_pages)`` has one row per host. At each level a beta-binomial posterior mean
    becomes the prior mean of the next: with prior mean m and weight w, n pages of which b are bad give
    alpha = w m + b, beta = w (1 - m) + n - b. The weights come from the spread between the suffixes, between the
    domains of a suffix and between the hosts of a domain (:func:`prior_weight`). Returns per host the posterior
    ``bad_share`` and its lower bound ``bad_low`` (mean less z standard deviations), and the labelled pages of the host
    and of its domain. The corpus mean is (bad + 1) / (pages + 20), which is 1/20 where nothing is labelled.
    """
    domains = materialize(hosts.groupBy("domain", "suffix").agg(F.sum("n_bad").alias("d_bad"), F.sum("n_pages").alias("d_pages")), compact=True)
    suffixes = materialize(domains.groupBy("suffix").agg(F.sum("d_bad").alias("s_bad"), F.sum("d_pages").alias("s_pages")), compact=True)
    bad, pages = suffixes.agg(F.coalesce(F.sum("s_bad"), F.lit(0)), F.coalesce(F.sum("s_pages"), F.lit(0))).first()

    def mean_of(groups: DataFrame, bad: str, n: str, prior: Column) -> Column:
        w = prior_weight(groups, bad, n, prior)
        return (w * prior + F.col(bad)) / (w + F.col(n))

    top = F.lit((bad + 1) / (pages + 20))
    suffixes = suffixes.select(F.col("suffix").alias("s_key"), mean_of(suffixes, "s_bad", "s_pages", top).alias("m_suffix"))
    domains = materialize(domains.join(suffixes, F.col("suffix").eqNullSafe(F.col("s_key"))).drop("s_key"), compact=True)
    domains = domains.select(F.col("domain").alias("d_key"), "d_pages", mean_of(domains, "d_bad", "d_pages", F.col("m_suffix")).alias("m_domain"))
    known = materialize(hosts.join(domains, F.col("domain") == F.col("d_key")), compact=True)
    w = prior_weight(known, "n_bad", "n_pages", F.col("m_domain"))
    alpha, beta = w * F.col("m_domain") + F.col("n_bad"), w * (1 - F.col("m_domain")) + F.col("n_pages") - F.col("n_bad")
    share = alpha / (alpha + beta)
    deviation = F.sqrt(alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1)))
    return known.select(F.col("host"), share.alias("bad_share"), (share - z * deviation).alias("bad_low"), F.col("n_pages").alias("n_labelled"), F.col("d_pages").alias("n_domain"))


def url_filter(pages: DataFrame, labels: DataFrame, rules=RULES, bad_share: float = BAD_SHARE, z: float = Z) -> DataFrame:
    """Judges every page by its url: page_id, host, path, rule, verdict, bad_share, bad_low, n_labelled.

    A page's outcome is the label of the document that the number in the path names (``/en/25`` is doc_id 25): bad
    when quality is 0, good when it is 1, unlabelled else. The longest rule that fits decides, of equally long ones the first
    of the list; where none does, the
    page is blocked if the lower posterior bound of its host's share of bad pages exceeds ``bad_share`` and its host or
    registered domain has a labelled page, else allowed: prior outcomes of other domains alone block nothing.
    A null url or one without ``://`` has host and path empty, forms one host '' and is judged like any other.
    Repeated pages are judged each; several labels of one document count as bad when any is 0; other columns are
    ignored. Outcomes are summed by host before anything is shuffled by host.
    """
    host, path = host_and_path(F.col("url"))
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    named = F.expr("try_cast(regexp_extract(path, '([0-9]+)[^0-9]*$', 1) AS bigint)")
    known = labels.where("quality is not null").groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(F.min("quality").alias("quality"))
    known = materialize(known)
    seen = parts.select("host", named.alias("named")).join(known, F.col("named") == F.col("labelled"), "left")
    domain, suffix = levels(F.col("host"))
    hosts = seen.groupBy("host").agg(F.count_if(F.col("quality") == 0).alias("n_bad"), F.count("quality").alias("n_pages"))
    hosts = materialize(hosts.withColumns({"domain": domain, "suffix": suffix}))
    judged = materialize(reputation(hosts, z))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    by_host = F.when((F.col("bad_low") > bad_share) & (F.col("n_domain") > 0), "block").otherwise("allow")
    return parts.join(judged.withColumnRenamed("host", "judged_host"), F.col("host") == F.col("judged_host"), "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_host).alias("verdict"), "bad_share", "bad_low", "n_labelled"
    )
