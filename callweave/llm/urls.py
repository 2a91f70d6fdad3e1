"""URL filtering: list rules first, then an empirical-Bayes reputation of hosts.

Labelled pages give each host a number of outcomes and of bad ones. The bad share of a host is shrunk
to that of its registered domain, the domain's to its suffix's, and the suffix's to that of all
labelled pages. Each level is a beta-binomial whose prior strength is estimated by moments from the
spread of the children about their parents. A host is blocked if the lower posterior bound of its bad
share reaches a limit: little evidence never blocks.

Outcomes are summed per host with map-side partial sums, all later levels are made from the host table,
and pages meet their host in a plain equality join, whose hot keys Spark splits at run time.

Defined cases: a null url or one without ``://`` has an empty host and path; no rule fits an empty host;
unlabelled hosts take what their domain, suffix or the whole gives; without any labels nothing is
blocked; repeated rows count as pages of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import lower_ascii


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The fixed rules of the query.
RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)
#: Prior strength (as a number of pages) is kept within these bounds.
WEAKEST, STRONGEST = 1.0, 1000.0
#: Standard deviations below the posterior mean, and the bad share that blocks.
DEPTH, LIMIT = 1.645, 0.5


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule (text and verdict) that fits, else null. Rules are part of the plan: keep them to hundreds."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def domain_of(host: Column, long_suffixes: Sequence[str] = ()) -> Column:
    """The registered domain: the last two labels, or one more below a suffix of ``long_suffixes`` (such as co.uk)."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(list(long_suffixes)), F.substring_index(host, ".", -3)).otherwise(two) if long_suffixes else two


def suffix_of(domain: Column) -> Column:
    return F.when(F.instr(domain, ".") > 0, F.expr("substr(domain, instr(domain, '.') + 1)")).otherwise(domain)


def _strength(children: DataFrame) -> DataFrame:
    """One row: the prior strength from children's ``n``, ``bad`` and their parents' ``mean``."""
    p = F.col("mean")
    spread = F.sum(F.when(F.col("n") > 0, F.col("n") * F.pow(F.col("bad") / F.col("n") - p, F.lit(2.0)) - p * (1 - p)))
    room = F.sum(F.when(F.col("n") > 0, (F.col("n") - 1) * p * (1 - p)))
    share = F.when(room > 0, spread / room)
    strength = F.when(share > 0, 1 / share - 1).otherwise(F.lit(STRONGEST))
    return children.agg(F.greatest(F.lit(WEAKEST), F.least(F.lit(STRONGEST), strength)).alias("strength"))


def _shrunk(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children with their parent's ``mean`` and ``var`` and the level's ``strength``."""
    met = children.join(parents.select(key, "mean", "var"), key)
    return met.withColumn("strength", _strength(met).scalar())


def reputations(outcomes: DataFrame, long_suffixes: Sequence[str] = (), depth: float = DEPTH) -> DataFrame:
    """One row per host from ``outcomes`` (host; bad: true, false, or null if unlabelled).

    Returns host, n, bad, mean and lower (bound of the bad share). Figures of a whole level are scalar
    subqueries over ungrouped aggregates.
    """
    bad = F.col("bad")
    hosts = outcomes.groupBy("host").agg(
        F.count(bad).alias("n"), F.coalesce(F.sum(bad.cast("long")), F.lit(0)).alias("bad")
    )
    hosts = hosts.withColumn("domain", domain_of(F.col("host"), long_suffixes))
    total = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = hosts.groupBy("domain").agg(*total).withColumn("suffix", suffix_of(F.col("domain")))
    suffixes = domains.groupBy("suffix").agg(*total)
    whole = suffixes.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1.0)).alias("mean"))

    weight = F.col("n") + F.col("strength")
    mean = (F.col("bad") + F.col("strength") * F.col("mean")) / weight
    # The variance of a level's own posterior, and what the parent's uncertainty adds where evidence is thin.
    var = mean * (1 - mean) / (weight + 1) + F.pow(F.col("strength") / weight, F.lit(2.0)) * F.col("var")
    posterior = [mean.alias("mean"), var.alias("var")]
    suffixes = suffixes.withColumns({"mean": whole.scalar(), "var": F.lit(0.0)})
    suffixes = suffixes.withColumn("strength", _strength(suffixes).scalar()).select("suffix", *posterior)
    domains = _shrunk(domains, suffixes, "suffix").select("domain", *posterior)
    hosts = _shrunk(hosts, domains, "domain").select("host", "n", "bad", *posterior)
    return hosts.select("host", "n", "bad", "mean", (F.col("mean") - depth * F.sqrt("var")).alias("lower"))


def judge(
    pages: DataFrame, rules: Sequence[Rule] = RULES, *, labels: Column | None = None, limit: float = LIMIT, long_suffixes: Sequence[str] = ()
) -> DataFrame:
    """Judge every page's ``url``: row (the input row), host, path, rule, verdict, bad_share_bound.

    ``labels`` is a boolean column of the pages (bad or not, null: unlabelled). Without it, the pages that a
    rule decides are the labelled ones.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row")
    url = F.col("url")
    given = F.lit(None).cast("boolean") if labels is None else labels
    parsed = pages.select(row, host_of(url).alias("host"), path_of(url).alias("path"), given.alias("given"))
    ruled = parsed.withColumn("found", fitting_rule(F.col("host"), F.col("path"), rules))
    label = F.col("found.verdict") == "block" if labels is None else F.col("given")
    known = reputations(ruled.select("host", label.alias("bad")), long_suffixes).select("host", "lower")
    out = ruled.join(known, "host", "left")
    method = F.when(F.col("lower") >= limit, "block").otherwise("allow")
    return out.select("row", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", method).alias("verdict"), F.col("lower").alias("bad_share_bound"))


def op4_url_filter(spark, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url")
    return judge(pages).select(F.col("row.page_id").alias("page_id"), "host", "path", "rule", "verdict")


SQL = f"""
WITH parsed AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), ruled AS (
  SELECT *, CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
                 WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
                 WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
                 WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
                 WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM parsed
), judged AS (
  SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS by_rule FROM ruled
), hosts AS (
  SELECT host, array_to_string(string_split(host, '.')[-2:], '.') AS domain, count(by_rule) AS n, count(*) FILTER (by_rule = 'block') AS bad FROM judged GROUP BY host
), domains AS (
  SELECT domain, CASE WHEN instr(domain, '.') > 0 THEN substr(domain, instr(domain, '.') + 1) ELSE domain END AS suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain
), suffixes AS (
  SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix
), s1 AS (
  SELECT s.*, w.mean, 0.0::DOUBLE AS var FROM suffixes s, (SELECT (sum(bad) + 0.5::DOUBLE) / (sum(n) + 1) AS mean FROM suffixes) w
), s2 AS (
  SELECT suffix, (bad + k * mean) / (n + k) AS mean, (bad + k * mean) / (n + k) * (1 - (bad + k * mean) / (n + k)) / (n + k + 1) + pow(k / (n + k), 2) * var AS var FROM s1, (SELECT greatest({WEAKEST}, least({STRONGEST}, CASE WHEN r > 0 AND s / r > 0 THEN r / s - 1 ELSE {STRONGEST} END)) AS k
    FROM (SELECT sum(n * pow(bad / n - mean, 2) - mean * (1 - mean)) AS s, sum((n - 1) * mean * (1 - mean)) AS r FROM s1 WHERE n > 0))
), d1 AS (
  SELECT d.*, s2.mean, s2.var FROM domains d JOIN s2 USING (suffix)
), d2 AS (
  SELECT domain, (bad + k * mean) / (n + k) AS mean, (bad + k * mean) / (n + k) * (1 - (bad + k * mean) / (n + k)) / (n + k + 1) + pow(k / (n + k), 2) * var AS var FROM d1, (SELECT greatest({WEAKEST}, least({STRONGEST}, CASE WHEN r > 0 AND s / r > 0 THEN r / s - 1 ELSE {STRONGEST} END)) AS k
    FROM (SELECT sum(n * pow(bad / n - mean, 2) - mean * (1 - mean)) AS s, sum((n - 1) * mean * (1 - mean)) AS r FROM d1 WHERE n > 0))
), h1 AS (
  SELECT h.*, d2.mean, d2.var FROM hosts h JOIN d2 USING (domain)
), h2 AS (
  SELECT host, (bad + k * mean) / (n + k) AS mean, (bad + k * mean) / (n + k) * (1 - (bad + k * mean) / (n + k)) / (n + k + 1) + pow(k / (n + k), 2) * var AS var FROM h1, (SELECT greatest({WEAKEST}, least({STRONGEST}, CASE WHEN r > 0 AND s / r > 0 THEN r / s - 1 ELSE {STRONGEST} END)) AS k
    FROM (SELECT sum(n * pow(bad / n - mean, 2) - mean * (1 - mean)) AS s, sum((n - 1) * mean * (1 - mean)) AS r FROM h1 WHERE n > 0))
), bounds AS (
  SELECT host, mean - {DEPTH}::DOUBLE * sqrt(var) AS lower FROM h2
)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN lower >= {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict
FROM judged LEFT JOIN bounds USING (host)
"""
