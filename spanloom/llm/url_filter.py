"""URL filtering by rules and by host reputation.

Reputation is empirical Bayes: the bad share of a host's labelled pages is shrunk towards its registered domain, that towards its
suffix and that towards all pages, each level by a beta prior whose strength comes from the spread between the members of that level
(method of moments) and whose mean leaves out the member's own pages, so that no page counts twice. A host is blocked if the lower bound of its posterior bad share, mean less Z standard deviations, is above LIMIT.
Explicit rules come first: a rule "host/path" fits its host and all subdomains if the url's path starts with its path; the longest wins, and
of equally long ones the last in the table.

A null or empty url, or one without "://", has an empty host and path; such urls share one empty host. A host without labelled pages gets the
prior of its domain or, failing that, suffix or all. With no labelled page at all nothing but rules blocks. Repeated rows count as often as they
occur; every url keeps its row, however long it is. Empty tables give an empty result, or one without blocked hosts. Only page_id and url are read
of pages, url and bad of outcomes, so other columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import storage

#: (verdict, rule) used by the query.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Public suffixes of two labels, as fixed values; every other suffix is the last label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "co.nz", "com.br", "co.in", "co.za", "com.cn", "com.mx")
LIMIT = 0.5
Z = 1.645


def parts(url: Column) -> tuple[Column, Column]:
    """(host with A-Z lower-cased, path)."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """Suffix and the label before it."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, nulls if none."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def page_outcomes(pages: DataFrame) -> DataFrame:
    """page_id, url, bad (0 or 1): a page is bad if over a fiftieth of its visible characters are symbols or over a fifth are capitals A-Z."""
    text = F.regexp_replace(F.coalesce(F.col("html"), F.lit("")), r"<[^>]*>", " ")
    n = F.greatest(F.length("text"), F.lit(1))
    symbols = F.length("text") - F.length(F.translate("text", "#*$%|", ""))
    upper = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]", ""))
    return pages.select("page_id", "url", text.alias("text")).select("page_id", "url", ((symbols * 50 > n) | (upper * 5 > n)).cast("int").alias("bad"))


def _strength(groups: DataFrame) -> float:
    """Prior strength from rows (n, bad, mean): mean is the parent's share. Over-dispersion rho gives 1 / rho - 1."""
    spread = F.sum(F.pow(F.col("bad") - F.col("n") * F.col("mean"), 2) / F.col("n"))
    chance = F.sum(F.col("mean") * (1 - F.col("mean")))
    more = F.sum(F.col("mean") * (1 - F.col("mean")) * (F.col("n") - 1))
    s, c, m = groups.agg(spread, chance, more).first()
    rho = (s - c) / m if m else 1e-4
    return 1 / min(max(rho, 1e-4), 0.5) - 1


def reputation(outcomes: DataFrame) -> DataFrame:
    """host, n, mean and sd of the posterior of its bad share. outcomes: url, bad."""
    host, _ = parts(F.col("url"))
    hosts = outcomes.where(F.col("bad").isNotNull()).select(host.alias("host"), F.col("bad").cast("double").alias("bad")).groupBy("host").agg(F.count("*").cast("double").alias("n"), F.sum("bad").alias("bad"))
    hosts = storage.cut(hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))}))
    total = hosts.agg(F.sum("n"), F.sum("bad")).first()
    top = (total[1] + 0.5) / (total[0] + 1) if total[0] else 0.0

    def shrunk(n: str, bad: str, k: float, towards: str) -> Column:
        return (F.expr(bad) + k * F.col(towards)) / (F.expr(n) + k)

    suffixes = storage.cut(hosts.groupBy("suffix").agg(F.sum("n").alias("sn"), F.sum("bad").alias("sbad")).withColumn("top", F.lit(top)))
    ks = _strength(suffixes.select(F.col("sn").alias("n"), F.col("sbad").alias("bad"), F.col("top").alias("mean")))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("dn"), F.sum("bad").alias("dbad")).join(suffixes, "suffix")
    domains = storage.cut(domains.select("domain", "dn", "dbad", shrunk("sn - dn", "sbad - dbad", ks, "top").alias("mean")))
    kd = _strength(domains.select(F.col("dn").alias("n"), F.col("dbad").alias("bad"), "mean"))
    hosts = hosts.join(domains, "domain")
    hosts = storage.cut(hosts.select("host", "n", "bad", shrunk("dn - n", "dbad - bad", kd, "mean").alias("mean")))
    k = _strength(hosts)
    found = hosts.select("host", "n", shrunk("n", "bad", k, "mean").alias("mean"))
    return found.withColumn("sd", F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + k + 1)))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, limit: float = LIMIT, z: float = Z) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block) of every page."""
    host, path = parts(F.col("url").cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    blocked = reputation(outcomes).where(F.col("mean") - z * F.col("sd") > limit).select("host", F.lit("block").alias("by_host"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    return rows.join(blocked, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(said, F.col("by_host"), F.lit("allow")).alias("verdict"))


_SUFFIXES = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)
_K = "1 / least(greatest(coalesce((s - c) / nullif(m, 0), 0.0001), 0.0001), 0.5) - 1"


def _level(rows: str) -> str:
    return f"(SELECT {_K} FROM (SELECT sum(pow(bad - n * mean, 2) / n) AS s, sum(mean * (1 - mean)) AS c, sum(mean * (1 - mean) * (n - 1)) AS m FROM {rows}))"


SQL = f"""
WITH u AS (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g') AS text FROM u),
o AS (SELECT host, CAST(((length(text) - length(translate(text, '#*$%|', ''))) * 50 > greatest(length(text), 1)
             OR (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) * 5 > greatest(length(text), 1)) AS DOUBLE) AS bad FROM p),
h AS (SELECT host, CAST(count(*) AS DOUBLE) AS n, sum(bad) AS bad, string_split(host, '.') AS l FROM o GROUP BY host),
hh AS (SELECT host, n, bad, array_to_string(l[-2:], '.') IN ({_SUFFIXES}) AS two,
              CASE WHEN array_to_string(l[-2:], '.') IN ({_SUFFIXES}) THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain,
              CASE WHEN array_to_string(l[-2:], '.') IN ({_SUFFIXES}) THEN array_to_string(l[-2:], '.') ELSE l[-1] END AS suffix FROM h),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (sum(bad) + 0.5) / (sum(n) + 1) FROM hh) AS mean FROM hh GROUP BY suffix),
s1 AS (SELECT suffix, n AS sn, bad AS sbad, mean AS top, {_level('s0')} AS ks FROM s0),
d0 AS (SELECT domain, dn AS n, dbad AS bad, (sbad - dbad + ks * top) / (sn - dn + ks) AS mean
       FROM (SELECT suffix, domain, sum(n) AS dn, sum(bad) AS dbad FROM hh GROUP BY suffix, domain) JOIN s1 USING (suffix)),
d1 AS (SELECT domain, n AS dn, bad AS dbad, mean AS dmean, {_level('d0')} AS kd FROM d0),
h0 AS (SELECT host, n, bad, (dbad - bad + kd * dmean) / (dn - n + kd) AS mean FROM hh JOIN d1 USING (domain)),
h1 AS (SELECT host, n + k AS w, (bad + k * mean) / (n + k) AS mean FROM (SELECT *, {_level('h0')} AS k FROM h0)),
b AS (SELECT host FROM h1 WHERE mean - {Z} * sqrt(mean * (1 - mean) / (w + 1)) > {LIMIT}),
r AS (SELECT page_id, p.host, path, b.host IS NOT NULL AS bad,
             CASE WHEN (p.host = 'example.net' OR p.host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                  WHEN (p.host = 'example.com' OR p.host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                  WHEN (p.host = 'org' OR p.host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                  WHEN (p.host = 'net' OR p.host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
      FROM p LEFT JOIN b ON p.host = b.host)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL OR bad THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
