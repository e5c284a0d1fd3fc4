"""URL filter: written rules first, then empirical-Bayes reputation of the host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nilas.llm.common import renamed, saved

RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: One-sided width of the posterior bound, and the share of bad pages from which a host is blocked.
Z, BAD_SHARE = 1.645, 0.5
#: Prior strengths outside these limits aren't taken from the data.
STRENGTH = (2.0, 200.0)
#: Hosts with more pages than this and than one in so many of all pages aren't shuffled to their reputation.
HOT_PAGES, HOT_SHARES = 10_000, 1 << 14


def parts(url: Column) -> tuple[Column, Column]:
    """host and path: host between the first :// and / ? # or the end, A-Z lower-cased; path up to ? or #."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_column(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits as (rule, verdict); null if none does.

    A rule fits its host and all subdomains when the path starts with the rule's; of equally long ones the first in order of text wins.
    """
    out = None
    for verdict, domain, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        value = F.struct(F.lit(domain + start).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def reputation(pages: DataFrame, outcomes: DataFrame, z: float = Z) -> DataFrame:
    """pages (page_id, host) and outcomes (page_id, bad 0/1) -> (host, pages, n, bad, mean, low).

    Each level is a beta-binomial: the suffix (last label) shrinks to the overall share, the registered
    domain (last two labels) to its suffix, the host to its domain. A level's prior strength comes from the
    moments of its own groups, within STRENGTH. low is the posterior mean less z posterior deviations.
    A host without outcomes has its domain's expectation. Pages with an empty host get no row; an outcome
    that is null doesn't count; without any outcome the overall share is 0.
    """
    seen = pages.where("host <> ''").join(outcomes.where("bad IS NOT NULL").groupBy("page_id").agg(F.max("bad").alias("bad")), "page_id", "left")
    hosts = seen.groupBy("host").agg(F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad"), F.count("*").alias("pages"))
    hosts = saved(hosts.selectExpr("host", "pages", "n", "bad", r"substring_index(host, '.', -2) AS domain", "substring_index(host, '.', -1) AS suffix"), "hosts")
    lo, hi = STRENGTH
    sums = ["sum(n) AS n", "sum(bad) AS bad"]
    group = lambda df, *keys: df.groupBy(*keys).agg(*(F.expr(x) for x in sums))
    base = hosts.agg(F.expr("coalesce(sum(bad) / nullif(sum(n), 0), 0D) AS p0"))

    def level(own: DataFrame, above: DataFrame, key: str) -> DataFrame:
        """own (keys, n, bad) with above's mean p -> p and strength of the posterior."""
        both = own.join(above, key) if key else own.crossJoin(F.broadcast(above))  # above has one row if no key
        moments = "sum(n * p * (1 - p)) / sum(n) / nullif(greatest(sum(n * pow(bad / n - p, 2)) / sum(n) - sum(p * (1 - p)) / sum(n), 0D), 0D)"
        m = both.where("n > 0").agg(F.expr(f"least(greatest(coalesce({moments}, {hi}D), {lo}D), {hi}D) AS m"))
        both = both.crossJoin(F.broadcast(m))  # one row
        return both.selectExpr("*", "p * m + bad AS alpha", "(1 - p) * m + n - bad AS beta").drop("p", "m")

    top = level(group(hosts, "suffix"), base.select(F.col("p0").alias("p")), "")
    mid = level(group(hosts, "domain", "suffix"), top.selectExpr("suffix", "alpha / (alpha + beta) AS p"), "suffix")
    own = level(hosts.select("host", "domain", "pages", "n", "bad"), mid.selectExpr("domain", "alpha / (alpha + beta) AS p"), "domain")
    sd = "sqrt(alpha * beta / (pow(alpha + beta, 2) * (alpha + beta + 1)))"
    return own.selectExpr("host", "pages", "n", "bad", "alpha / (alpha + beta) AS mean", f"alpha / (alpha + beta) - {z}D * {sd} AS low")


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, bad_share: float = BAD_SHARE, hot_pages: int = HOT_PAGES) -> DataFrame:
    """pages (page_id, url, ...) with host, path, rule and verdict.

    A fitting rule decides; else the host is blocked when the lower posterior bound of its share of bad pages is over
    bad_share. Null urls and urls without :// have an empty host and path and are allowed. Columns with
    these names are replaced, others may have any name; repeated pages stay repeated; an empty table gives no rows.

    Of hosts with over hot_pages pages and over one in HOT_SHARES of all, so fewer than HOT_SHARES of them, the verdict is broadcast;
    only pages of the others, and those without a host, are shuffled or broadcast as Spark sees fit.
    """
    pages, names = renamed(pages.drop("host", "path", "rule", "verdict"), "page_id", "url")
    own = pages.columns
    host, path = parts(F.col("url"))
    pages = pages.withColumns({"host": host, "path": path})
    known = saved(reputation(pages.select("page_id", "host"), outcomes).select("host", "pages", (F.col("low") > bad_share).alias("bad")), "reputation")
    total = known.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    hot = F.broadcast(known.where(F.col("pages") > max(hot_pages, total / HOT_SHARES)).select("host", "bad"))
    # a page without a host is on the broadcast side too: however many there are, they have no reputation
    here = pages.join(hot, "host", "left").where("bad IS NOT NULL OR host = ''")
    there = pages.where("host <> ''").join(hot, "host", "left_anti").join(known.select("host", "bad"), "host", "left")
    fit = rule_column(F.col("host"), F.col("path"), rules)
    out = here.unionByName(there).select(*own, "host", "path", "bad", fit.alias("fit"))
    verdict = F.coalesce("fit.verdict", F.when(F.col("bad"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select(*own, "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict")).toDF(*names, "host", "path", "rule", "verdict")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    outcomes = labels.selectExpr("doc_id AS page_id", "CAST(quality = 0 OR toxic = 1 AS INT) AS bad")
    return filter_urls(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")


def _sql_level(name: str, own: str, above: str, on: str) -> str:
    lo, hi = STRENGTH
    return f"""
{name}_j AS (SELECT o.*, a.p FROM ({own}) o JOIN ({above}) a ON {on}),
{name}_m AS (SELECT least(greatest(coalesce(sum(n * p * (1 - p)) / sum(n) / nullif(greatest(sum(n * pow(bad / n - p, 2)) / sum(n) - sum(p * (1 - p)) / sum(n), 0), 0), {hi}), {lo}), {hi}) AS m FROM {name}_j WHERE n > 0),
{name} AS (SELECT j.*, p * m + bad AS alpha, (1 - p) * m + n - bad AS beta FROM {name}_j j, {name}_m)"""


_FITS = " ".join(
    f"WHEN (host = '{d}' OR host LIKE '%.{d}') AND starts_with(path, '{s}') THEN '{{{v}}}'".replace("{" + v + "}", f"{d}{s} {v}")
    for v, d, s in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
)
SQL = f"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM r),
o AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY 1),
h AS (SELECT host, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain, string_split(host, '.')[-1] AS suffix,
      CAST(count(bad) AS DOUBLE) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS bad FROM u LEFT JOIN o USING (page_id) WHERE host <> '' GROUP BY 1, 2, 3),
b AS (SELECT coalesce(sum(bad) / nullif(sum(n), 0), 0) AS p FROM h),
{_sql_level("t", "SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY 1", "SELECT p FROM b", "TRUE")},
{_sql_level("d", "SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY 1, 2", "SELECT suffix, alpha / (alpha + beta) AS p FROM t", "o.suffix = a.suffix")},
{_sql_level("e", "SELECT host, domain, n, bad FROM h", "SELECT domain, alpha / (alpha + beta) AS p FROM d", "o.domain = a.domain")},
k AS (SELECT host, alpha / (alpha + beta) - {Z} * sqrt(alpha * beta / (pow(alpha + beta, 2) * (alpha + beta + 1))) AS low FROM e),
f AS (SELECT u.*, low, CASE {_FITS} END AS fit FROM u LEFT JOIN k USING (host))
SELECT page_id, host, path, split_part(fit, ' ', 1) AS rule,
       CASE WHEN fit IS NOT NULL THEN split_part(fit, ' ', 2) WHEN low > {BAD_SHARE} THEN 'block' ELSE 'allow' END AS verdict FROM f
"""
