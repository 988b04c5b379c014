"""URL filters: explicit rules first, then empirical-Bayes host reputation.

Labelled outcomes of pages are counted by host, registered domain and suffix (the last label, or the last two where
the second-level name is a registry's). Each level's share of bad pages is a beta posterior whose prior is the level
above: from all pages to the suffix, from the suffix to the registered domain, from there to the host. The prior's
strength at each level is estimated from the spread of the level's raw shares (moments of the beta-binomial). A host
is blocked if the lower bound of its posterior (mean minus ``z`` standard deviations) is over ``max_bad``, so a host
with few outcomes is judged by its domain and not blocked for lack of evidence.

All steps are DataFrame expressions. A host with a third of all pages is counted by partial sums, and its reputation
is joined from a table of one row per host: broadcast while that table has at most BROADCAST_HOSTS rows, else by a
join on the host whose page side adaptive execution splits.

Defined cases: a null url, or one without ``://``, has empty host and path, no rule, and is judged by the prior of
all pages; a null page_id stays null; repeated rows each get their row; an empty table gives an empty result; without
any outcome every share is PRIOR_BAD; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, stored

BROADCAST_HOSTS = 200_000
#: The share of bad pages before any outcome, worth two pages.
PRIOR_BAD = 0.1
MIN_STRENGTH, MAX_STRENGTH = 2.0, 500.0
# Second-level names under which registries sell domains.
REGISTRY_NAMES = ("ac", "co", "com", "edu", "gov", "net", "org")
#: (rule, verdict): a host, with a path that the page's path must start with.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule whose host is the url's or a parent of it, and whose path starts the url's; null without one."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def suffix_of(host: Column) -> Column:
    parts = F.split(host, r"\.")
    n = F.size(parts)
    registry = (n >= 3) & F.get(parts, n - 2).isin(*REGISTRY_NAMES) & (F.length(F.get(parts, n - 1)) == 2)
    return F.when(registry, F.concat_ws(".", F.get(parts, n - 2), F.get(parts, n - 1))).otherwise(F.get(parts, n - 1))


def domain_of(host: Column) -> Column:
    """The registered domain: one name and the suffix; the host itself where it has no more names."""
    parts, suffix = F.split(host, r"\."), F.split(suffix_of(host), r"\.")
    keep = F.least(F.size(parts), F.size(suffix) + 1)
    return F.array_join(F.slice(parts, F.size(parts) - keep + 1, keep), ".")


def _strength(level: DataFrame, prior: str) -> Column:
    """Prior strength s of a beta-binomial from shares that scatter around their priors, by moments.

    E[(k - n p)^2] = n p (1 - p) (s + n) / (s + 1), so with D = sum of (k - n p)^2, A = sum of n p (1 - p) and
    B = sum of n^2 p (1 - p): s = (B - D) / (D - A). No excess scatter gives the greatest strength.
    """
    k, n, p = F.col("bad"), F.col("n"), F.col(prior)
    d, a, b = (F.sum(x) for x in ((k - n * p) ** 2, n * p * (1 - p), n * n * p * (1 - p)))
    s = F.when(d > a, F.try_divide(b - d, d - a)).otherwise(F.lit(MAX_STRENGTH))
    return F.coalesce(F.least(F.greatest(s, F.lit(MIN_STRENGTH)), F.lit(MAX_STRENGTH)), F.lit(MAX_STRENGTH))


def _shrunk(level: DataFrame, prior: str, mean: str) -> DataFrame:
    """Adds the level's strength and its posterior mean given the prior of the level above."""
    s = level.agg(_strength(level, prior).alias("strength"))
    return level.crossJoin(F.broadcast(s)).withColumn(mean, (F.col("bad") + F.col("strength") * F.col(prior)) / (F.col("n") + F.col("strength")))


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """From (host, bad 0 or 1 or null), for each host: n, bad, mean and lower bound inputs of its posterior.

    ``outcomes`` has every host, null outcomes included, so each host gets its row.
    """
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = stored(hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))}), "hosts")
    domains = stored(hosts.groupBy("domain").agg(F.first("suffix").alias("suffix"), F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domains")
    suffixes = stored(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "suffixes")
    # one row: the share over all pages
    whole = suffixes.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 2 * PRIOR_BAD) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("p_all"))
    suffixes = _shrunk(suffixes.crossJoin(F.broadcast(whole)), "p_all", "p_suffix").select("suffix", "p_suffix")
    domains = _shrunk(domains.join(suffixes, "suffix"), "p_suffix", "p_domain").select("domain", "p_domain")
    hosts = _shrunk(hosts.join(domains, "domain"), "p_domain", "mean")
    a, b = F.col("mean") * (F.col("n") + F.col("strength")), (1 - F.col("mean")) * (F.col("n") + F.col("strength"))
    return hosts.select("host", "domain", "suffix", "n", "bad", "mean", F.sqrt(a * b / ((a + b) ** 2 * (a + b + 1))).alias("sd"))


def url_filter(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = RULES, max_bad: float = 0.5, z: float = 1.64) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, bad_mean, bad_low.

    ``labels`` has (page_id, bad): the outcome of a page, 0 or 1.
    """
    url = F.col("url")
    seen = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    outcomes = labels.filter("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.max("bad").alias("bad"))
    reputation = host_reputation(seen.select("page_id", "host").join(outcomes, "page_id", "left").select("host", "bad"))
    reputation = stored(reputation.select("host", "mean", "sd"), "reputation")
    reputation = small(reputation, reputation.count(), BROADCAST_HOSTS)
    low = F.greatest(F.lit(0.0), F.col("mean") - z * F.col("sd"))
    rule = matched_rule(F.col("host"), F.col("path"), rules)
    said = F.lit(None).cast("string")
    for name, verdict in rules:
        said = F.when(F.col("rule") == name, F.lit(verdict)).otherwise(said)
    judged = seen.join(reputation, "host").select("page_id", "host", "path", rule.alias("rule"), F.round("mean", 6).alias("bad_mean"), F.round(low, 6).alias("bad_low"))
    own = F.when(F.col("bad_low") > max_bad, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce(said, own).alias("verdict"), "bad_mean", "bad_low")


def page_outcomes(labels: DataFrame) -> DataFrame:
    """The labels table as outcomes: a page is bad if its label is of low quality or toxic."""
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    return labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))


def _level_sql(name: str, source: str, prior: str, mean: str) -> str:
    return f"""
{name}_s AS (
  SELECT CASE WHEN d > a THEN least(greatest((b - d) / (d - a), {MIN_STRENGTH}), {MAX_STRENGTH}) ELSE {MAX_STRENGTH} END AS strength
  FROM (SELECT sum((bad - n * {prior}) ** 2) AS d, sum(n * {prior} * (1 - {prior})) AS a, sum(n * n * {prior} * (1 - {prior})) AS b FROM {source})),
{name}_p AS (SELECT *, (bad + strength * {prior}) / (n + strength) AS {mean} FROM {source}, {name}_s)"""


SQL = rf"""
WITH outcomes AS (
  SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END) AS bad
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
seen AS (
  SELECT page_id, coalesce(lower(regexp_extract(url, '^[\s\S]*?://([^/?#]*)', 1)), '') AS host,
         coalesce(regexp_extract(url, '^[\s\S]*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
hosts AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS bad, string_split(host, '.') AS parts
  FROM seen LEFT JOIN outcomes USING (page_id) GROUP BY host),
split AS (
  SELECT *, CASE WHEN len(parts) >= 3 AND parts[-2] IN ({", ".join(f"'{x}'" for x in REGISTRY_NAMES)}) AND length(parts[-1]) = 2 THEN 2 ELSE 1 END AS k FROM hosts),
named AS (SELECT host, n, bad, array_to_string(parts[-k:], '.') AS suffix, array_to_string(parts[-(k + 1):], '.') AS domain FROM split),
domains0 AS (SELECT domain, any_value(suffix) AS suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM named GROUP BY domain),
suffixes0 AS (SELECT suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM domains0 GROUP BY suffix),
whole AS (SELECT (sum(bad) + {2 * PRIOR_BAD}) / (sum(n) + 2) AS p_all FROM suffixes0),
suffixes1 AS (SELECT * FROM suffixes0, whole),
{_level_sql("suffix", "suffixes1", "p_all", "p_suffix")},
domains1 AS (SELECT d.*, p_suffix FROM domains0 d JOIN suffix_p USING (suffix)),
{_level_sql("domain", "domains1", "p_suffix", "p_domain")},
hosts1 AS (SELECT h.*, p_domain FROM named h JOIN domain_p USING (domain)),
{_level_sql("host", "hosts1", "p_domain", "mean")},
bounds AS (
  SELECT host, mean, greatest(0.0, mean - 1.64 * sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))) AS low
  FROM (SELECT host, mean, mean * (n + strength) AS a, (1 - mean) * (n + strength) AS b FROM host_p)),
ruled AS (
  SELECT page_id, host, path, round(mean, 6) AS bad_mean, round(low, 6) AS bad_low,
         CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
              WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
              WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM seen JOIN bounds USING (host))
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN bad_low > 0.5 THEN 'block' ELSE 'allow' END AS verdict, bad_mean, bad_low
FROM ruled
"""
