"""URL filters: explicit rules, and empirical-Bayes reputation of hosts for the rest.

Labelled pages are bad or good outcomes of their host. The rate of bad ones is shrunk level by level: a
suffix towards the rate of all, a registered domain towards its suffix, a host towards its domain. The
prior of a level is Beta(c m, c (1 - m)), where m is the estimate of the level above and c, the same for the
whole level, comes from how much more the rates of the level differ than chance alone would have it (the moments of the
beta-binomial). A host is blocked if the lower bound of its posterior is above the threshold: mean less
`DEVIATIONS` standard deviations, which by Cantelli's inequality a rate is below with probability 1 / (1 + DEVIATIONS^2)
at most. A host without outcomes is judged by its domain's estimate.

Everything is DataFrame functions. Outcomes are counts by host, so a host with a third of all pages is
one row; pages meet their hosts in a join from which hosts with many pages are taken out: at most HOT of
them can have that share, so these few are broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .common import store

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Block where the rate of bad pages is above this, by so many deviations.
THRESHOLD, DEVIATIONS = 0.5, 3.0
#: Limits of a level's c.
LEAST, MOST = 0.5, 1000.0
#: Hosts with more than a HOT-th of all pages are at most HOT; names longer than a host name may be aren't among them.
HOT, LONGEST = 1024, 253
#: Bytes of domains or suffixes that may be broadcast.
SENT = 64 << 20
#: Labels before a two-letter ending that are part of the suffix.
SECOND = ("ac", "co", "com", "edu", "gov", "net", "org")
#: (host, path, verdict) of the registered query.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: then up to ?, # or the end. Empty where there is no ://."""
    rest = F.coalesce(F.get(F.split(url, "://", 2), F.lit(1)), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule, as struct(rule, verdict), whose host is this one or above it and whose path begins this one; null if none. Of the same rule twice, block wins."""
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != "block"))
    listed = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")) for h, p, v in ordered])
    fits = F.filter(listed, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    best = F.get(fits, F.lit(0))
    return F.when(F.size(fits) > 0, F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host; user, port and a last dot don't count. Addresses are domains of their own without a suffix."""
    name = F.regexp_replace(host, r"^.*@|:[0-9]*$|\.(?=:[0-9]*$|$)", "")
    second = "|".join(SECOND)
    address = F.rlike(name, F.lit(r"^[0-9.]+$|[\[\]:]"))
    suffix = F.when(address, F.lit("")).otherwise(F.regexp_extract(name, rf"((?:(?:^|(?<=\.))(?:{second})\.[a-z][a-z]|[^.]*))$", 1))
    own = F.regexp_extract(F.left(name, F.char_length(name) - F.char_length(suffix)), r"([^.]*\.)$", 1)
    return F.when(address, name).otherwise(F.concat(own, suffix)), suffix


def small(df: DataFrame, key: str) -> DataFrame:
    """`df` for a join on `key`: broadcast while its names take at most SENT bytes; else Spark splits the keys that are hot."""
    size = df.agg(F.sum(F.octet_length(key).cast("long") + 32)).first()[0] or 0
    return F.broadcast(df) if size <= SENT else df


def shrunk(counts: DataFrame, parents: DataFrame, above: str) -> DataFrame:
    """The level's counts with c and mean, given the estimates (above, mean) of the level above."""
    known = store(counts.join(small(parents.select(above, F.col("mean").alias("prior")), above), above), "known")
    v, n = F.col("prior") * (1 - F.col("prior")), F.col("n")
    fit = known.filter("n > 0").agg(F.sum(n * (F.col("bad") / n - F.col("prior")) ** 2 - v).alias("extra"), F.sum(v * (n - 1)).alias("free"))
    rho = F.when(F.col("free") > 0, F.col("extra") / F.col("free"))
    c = fit.select(F.when(rho > 1 / (MOST + 1), F.greatest(1 / rho - 1, F.lit(LEAST))).otherwise(F.lit(MOST))).first()[0]
    return known.withColumn("c", F.lit(c)).withColumn("mean", (F.col("bad") + c * F.col("prior")) / (n + c))


def reputation(outcomes: DataFrame, deviations: float = DEVIATIONS) -> DataFrame:
    """host, n, bad, mean, low: of each host its labelled pages, the bad ones, and mean and lower bound of the posterior rate of bad ones.

    `outcomes`: host, n, bad; rows of one host add up, n may be 0. Null hosts count as empty ones. An
    empty table gives no rows.
    """
    host = F.coalesce("host", F.lit("")).alias("host")
    hosts = outcomes.select(host, "n", "bad").groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domain, suffix = domain_and_suffix(F.col("host"))
    hosts = store(hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "bad"), "hosts")
    total = lambda *by: hosts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes, domains = store(total("suffix"), "suffixes"), store(total("domain", "suffix"), "domains")
    every = suffixes.agg(((F.sum("bad") + 1) / (F.sum("n") + 2)).alias("mean")).withColumn("everything", F.lit("all"))
    suffixes = shrunk(suffixes.withColumn("everything", F.lit("all")), every, "everything")
    domains = shrunk(domains, suffixes, "suffix")
    hosts = shrunk(hosts, domains, "domain")
    weight = F.col("n") + F.col("c")
    spread = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (weight + 1))
    return hosts.select("host", "n", "bad", "mean", (F.col("mean") - deviations * spread).alias("low"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = (), threshold: float = THRESHOLD, deviations: float = DEVIATIONS) -> DataFrame:
    """page_id, host, path, rule, verdict, low for each row of `pages` (page_id, url): allow or block, by the longest rule that fits, else by the host's reputation.

    `outcomes`: host, n, bad, as of `reputation`. low is the lower bound of the host's rate of bad pages. A null url, or
    one without ://, has an empty host and path, and the reputation of the empty host. Repeated rows are judged one by
    one. An empty table gives no rows; without outcomes all hosts are allowed unless a rule blocks them.
    """
    host, path = host_and_path(F.col("url"))
    seen = store(pages.select("page_id", host.alias("host"), path.alias("path")), "urls")
    per_host = store(seen.groupBy("host").agg(F.count(F.lit(1)).alias("pages")), "seen")
    known = reputation(outcomes.select("host", "n", "bad").unionByName(per_host.select("host", F.lit(0).alias("n"), F.lit(0).alias("bad"))), deviations)
    # at most HOT hosts have more than a HOT-th of the pages
    total = per_host.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    hot = per_host.filter((F.col("pages") > total // HOT) & (F.char_length("host") <= LONGEST)).select("host")
    hot = store(known.join(F.broadcast(hot), "host").select("host", "low"), "hot")
    often = seen.join(F.broadcast(hot), "host")
    rest = seen.join(F.broadcast(hot), "host", "left_anti").join(known.select("host", "low"), "host")
    rule = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("low") > threshold, F.lit("block")).otherwise(F.lit("allow"))
    judged = often.unionByName(rest).withColumn("found", rule)
    return judged.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", method).alias("verdict"), "low")


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """host, n, bad: the outcomes that labels give. The number that ends a page's path is the doc_id of the document it shows.

    A page is bad if its document is labelled of quality 0 or toxic, good if it has labels and none says
    so. A document with labels of both kinds teaches nothing.
    """
    host, path = host_and_path(F.col("url"))
    shown = pages.select(host.alias("host"), F.try_to_number(F.regexp_extract(path, r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1), F.lit("9" * 18)).cast("long").alias("doc_id"))
    shown = shown.filter("doc_id IS NOT NULL").groupBy("host", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    bad = F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), (F.col("quality") != 0) & (F.col("toxic") != 1), F.col("quality") == 0, F.col("toxic") == 1)
    told = labels.select("doc_id", bad.alias("bad")).filter("bad IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("bad").alias("bad"), F.max("bad").alias("other")).filter("bad = other")
    return shown.join(told, "doc_id").groupBy("host").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("bad").cast("long")).alias("bad"))


def contract(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """The registered query."""
    return judge(pages, labelled(pages, labels), RULES)


QUERY_COLUMNS = ("page_id", "host", "path", "rule", "verdict")


def _level(name: str, key: str, above: str) -> str:
    return f"""
{name}_k AS (SELECT x.{key}, x.{above}, x.n, x.bad, p.mean AS prior FROM {name}_n x JOIN {above}_e p USING ({above})),
{name}_f AS (SELECT sum(n * (bad::DOUBLE / n - prior) * (bad::DOUBLE / n - prior) - prior * (1 - prior)) AS extra, sum(prior * (1 - prior) * (n - 1)) AS free FROM {name}_k WHERE n > 0),
{name}_c AS (SELECT CASE WHEN free > 0 AND extra / free > 1 / {MOST + 1}::DOUBLE THEN greatest(free / extra - 1, {LEAST}::DOUBLE) ELSE {MOST}::DOUBLE END AS c FROM {name}_f),
{name}_e AS (SELECT {key}, n, c, (bad + c * prior) / (n + c) AS mean FROM {name}_k, {name}_c)"""


_SECOND = "|".join(SECOND)
ORACLE = rf"""
WITH u AS (
  SELECT page_id, regexp_replace(coalesce(url, ''), '^[^\x00]*?://', '') AS rest FROM pages WHERE contains(coalesce(url, ''), '://')
  UNION ALL SELECT page_id, '' FROM pages WHERE NOT contains(coalesce(url, ''), '://')
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), told AS (
  SELECT doc_id, bool_or(bad) AS bad FROM (
    SELECT doc_id, coalesce(quality = 0, false) OR coalesce(toxic = 1, false) AS bad FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)
  ) GROUP BY doc_id HAVING bool_or(bad) = bool_and(bad)
), o AS (
  SELECT host, count(t.doc_id) AS n, count(*) FILTER (t.bad) AS bad
  FROM h LEFT JOIN told t ON t.doc_id = try_cast(regexp_extract(path, '/([0-9]{{1,18}})(?:\.[a-z]+)?/?$', 1) AS BIGINT) GROUP BY host
), n AS (SELECT host, n, bad, regexp_replace(regexp_replace(host, '^.*@', ''), '\.?(:[0-9]*)?$', '') AS name FROM o
), a AS (SELECT *, regexp_matches(name, '^[0-9.]+$|[\[\]:]') AS address FROM n
), x AS (
  SELECT host, n, bad, name, address, CASE WHEN address THEN '' WHEN regexp_matches(name, '(^|\.)({_SECOND})\.[a-z][a-z]$') THEN regexp_extract(name, '({_SECOND})\.[a-z][a-z]$') ELSE regexp_extract(name, '[^.]*$') END AS suffix FROM a
), host_n AS (
  SELECT host, n, bad, suffix, CASE WHEN address THEN name ELSE regexp_extract(substr(name, 1, length(name) - length(suffix)), '([^.]*\.)$', 1) || suffix END AS domain FROM x
), domain_n AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM host_n GROUP BY domain, suffix
), suffix_n AS (SELECT suffix, 0 AS everything, sum(n) AS n, sum(bad) AS bad FROM host_n GROUP BY suffix
), everything_e AS (SELECT 0 AS everything, (sum(bad) + 1)::DOUBLE / (sum(n) + 2)::DOUBLE AS mean FROM host_n
), {_level("suffix", "suffix", "everything")}, {_level("domain", "domain", "suffix")}, {_level("host", "host", "domain")},
rules(rhost, rpath, verdict) AS (VALUES {", ".join(str(r) for r in RULES)}),
best AS (
  SELECT page_id, host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM h JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id, host, path
)
SELECT h.page_id, h.host, h.path, b.rule,
       coalesce(b.verdict, CASE WHEN e.mean - {DEVIATIONS} * sqrt(e.mean * (1 - e.mean) / (e.n + e.c + 1)) > {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict
FROM h JOIN host_e e ON e.host = h.host LEFT JOIN best b ON b.page_id = h.page_id AND b.host = h.host AND b.path = h.path
"""
