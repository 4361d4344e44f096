"""Operator 4: URL rules and empirical-Bayes host reputation, in DataFrame functions.

Outcomes of labelled pages (a label's doc_id is the page's id; low quality or
toxic: bad) are summed by site (the host without user and port), by registered
domain and by suffix. Rates are shrunk downwards through beta-binomial
priors: the suffix's mean towards the overall mean, the domain's towards the
suffix's, the site's towards the domain's. How many observations each prior
weighs comes from the data: at each level the spread of the children's rates
around their parent's, beyond what chance explains, gives the correlation within a
child, and its inverse the prior's weight (method of moments, pooled over all parents).
A site is blocked if the lower bound of its posterior
(mean less ``Z`` standard deviations of its beta distribution) is above
``MOST_BAD``. A site without labelled pages has the prior of its domain as its
posterior; a domain without any that of its suffix, and so on. Explicit rules come first: the longest rule that fits decides.

Sums by site combine before the shuffle. Verdicts of the sites go to all tasks if there are at most
``MOST_BROADCAST`` of them (counted); otherwise narrow rows of pages meet them in an equality join, whose hot sites adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from omniframe.llm import durable

#: Rules (host, path prefix).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: A country's two letters after one of these labels make a suffix of two labels, like co.uk.
SECOND_LEVEL = ("ac", "co", "com", "edu", "firm", "gen", "go", "gob", "gouv", "gov", "id", "ind", "info", "ltd", "me", "mil", "ne", "net", "nom", "or", "org", "plc", "sch", "web")
#: Weight of a prior where the data tell nothing about it, and its bounds.
PRIOR, LEAST_PRIOR, MOST_PRIOR = 10.0, 0.5, 1e6
#: Sites (a name and three numbers each) up to which their verdicts are broadcast.
MOST_BROADCAST = 200_000
Z = 1.645
MOST_BAD = 0.5
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def site(h: Column) -> Column:
    """The host without user, port and closing dot."""
    return F.regexp_replace(F.regexp_replace(h, r"^.*@", ""), r"\.?(:[0-9]*)?$", "")


ADDRESS = r"^([0-9]+\.){3}[0-9]+$|:"


def suffix(h: Column) -> Column:
    """The last label, or two where the rule of SECOND_LEVEL fits; an address is its own suffix and domain."""
    two = F.substring_index(h, ".", -2)
    by_country = two.rlike(rf"^({'|'.join(SECOND_LEVEL)})\.[a-z][a-z]$")
    return F.when(h.rlike(ADDRESS), h).when(by_country, two).otherwise(F.substring_index(h, ".", -1))


def domain(h: Column, s: Column) -> Column:
    """The suffix and the label before it; the whole host if there is none."""
    return F.when(s == h, h).when(s.contains("."), F.substring_index(h, ".", -3)).otherwise(F.substring_index(h, ".", -2))


def rule(h: Column, p: Column) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    which, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(RULES, key=lambda r: len(r[1])):
        at, slash, rest = text.partition("/")
        fits = ((h == at) | h.endswith("." + at)) & p.startswith(slash + rest)
        which, verdict = F.when(fits, F.lit(text)).otherwise(which), F.when(fits, F.lit(says)).otherwise(verdict)
    return which, verdict


def sums(n: str, x: str) -> list[Column]:
    """What a parent keeps of its children: observations, bad ones, children that have any, and two sums for the spread."""
    full = F.col(n) > 0
    return [
        F.sum(n).alias("n"), F.sum(x).alias("x"), F.count(F.when(full, 1)).alias("k"), F.sum(F.col(n).cast("double") * F.col(n)).alias("nn"),
        F.coalesce(F.sum(F.when(full, F.col(x).cast("double") * F.col(x) / F.col(n))), F.lit(0.0)).alias("xx"),
    ]


def strength(parents: DataFrame) -> float:
    """The weight of the prior that these parents give their children."""
    rate = F.col("x") / F.col("n")
    chance = rate * (1 - rate)
    spread = F.col("xx") - F.col("x") * rate - chance * (F.col("k") - 1)
    room = chance * (F.col("n") - F.col("nn") / F.col("n") - (F.col("k") - 1))
    got = parents.filter("n > 0").agg(F.sum(spread).alias("spread"), F.sum(room).alias("room")).first()
    if not got.room or got.room <= 0:
        return PRIOR
    return min(max(1 / max(got.spread / got.room, 1e-9) - 1, LEAST_PRIOR), MOST_PRIOR)


def reputation(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(site, blocked, n_host, bad_host) of every site; blocked is null if no page has a label."""
    known = labels.groupBy("doc_id").agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad")).filter("bad is not null")
    seen = pages.select("page_id", "site").join(known, F.col("page_id") == F.col("doc_id"), "left")
    h = seen.groupBy("site").agg(F.count("bad").alias("n_host"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad_host"))
    h = durable.save(h.withColumn("suffix", suffix(F.col("site"))).withColumn("domain", domain(F.col("site"), F.col("suffix"))), "sites")
    d = durable.save(h.groupBy("domain", "suffix").agg(*sums("n_host", "bad_host")), "domains")
    s = durable.save(d.groupBy("suffix").agg(*sums("n", "x")), "suffixes")
    whole = s.agg(*sums("n", "x"))
    k_site, k_domain, k_suffix = (F.lit(strength(t)) for t in (d, s, whole))
    base = whole.select((k_suffix * F.col("x") / F.nullif("n", F.lit(0)))).first()
    mean = F.lit(base[0] if base else None).cast("double")
    s = s.select("suffix", ((F.col("x") + mean) / (F.col("n") + k_suffix)).alias("mean_s"))
    d = d.join(s, "suffix").select("domain", ((F.col("x") + k_domain * F.col("mean_s")) / (F.col("n") + k_domain)).alias("mean_d"))
    h = h.join(d, "domain")
    a, b = F.col("bad_host") + k_site * F.col("mean_d"), F.col("n_host") - F.col("bad_host") + k_site * (1 - F.col("mean_d"))
    low = a / (a + b) - F.lit(Z) * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return h.select("site", (low > MOST_BAD).alias("blocked"), "n_host", "bad_host")


def judge(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, n_host, bad_host of every row.

    A null url, or one without ``://``, has an empty host and path and no rule;
    the empty host has a reputation like any other. Without any labelled page
    no host is blocked. Of several labels of a page one bad one counts; null labels and null ids
    count for nothing. Repeated pages are judged alike and count once each;
    an empty table gives no row; other columns are ignored.
    """
    rows = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")).withColumn("site", site(F.col("host")))
    known = durable.save(reputation(rows, labels), "reputation")
    if known.count() <= MOST_BROADCAST:
        known = F.broadcast(known)
    which, says = rule(F.col("host"), F.col("path"))
    out = rows.join(known, "site", "left")
    verdict = F.coalesce(says, F.when(F.coalesce("blocked", F.lit(False)), F.lit("block")).otherwise(F.lit("allow")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("page_id", "host", "path", which.alias("rule"), verdict.alias("verdict"), zero("n_host"), zero("bad_host"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    pages, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "labels"))
    return judge(pages, labels)


_TWO = "regexp_extract(site, '[^.]*\\.[^.]*$')"
_STRENGTH = f"""SELECT CASE WHEN sum(room) > 0 THEN least(greatest(1 / greatest(sum(spread) / sum(room), 1e-9) - 1, {LEAST_PRIOR}), {MOST_PRIOR}) ELSE {PRIOR} END AS m FROM (
    SELECT x / n * (1 - x / n) * (n - nn / n - (k - 1)) AS room, xx - x * x / n - x / n * (1 - x / n) * (k - 1) AS spread FROM"""
_SUMS = "CAST(sum({n}) AS DOUBLE) AS n, CAST(sum({x}) AS DOUBLE) AS x, count(CASE WHEN {n} > 0 THEN 1 END) AS k, sum({n}::DOUBLE * {n}) AS nn, coalesce(sum(CASE WHEN {n} > 0 THEN {x}::DOUBLE * {x} / {n} END), 0) AS xx"
SQL = f"""
WITH u0 AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '{URL}', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '{URL}', 2), '') AS path FROM pages
), u AS (
  SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), '\\.?(:[0-9]*)?$', '') AS site FROM u0
), known AS (
  SELECT doc_id, max(CAST(quality = 0 OR toxic = 1 AS INT)) AS bad FROM labels GROUP BY doc_id HAVING bad IS NOT NULL
), h0 AS (
  SELECT site, count(bad) AS n_host, CAST(coalesce(sum(bad), 0) AS BIGINT) AS bad_host FROM u LEFT JOIN known ON page_id = doc_id GROUP BY site
), h1 AS (
  SELECT *, CASE WHEN regexp_matches(site, '{ADDRESS}') THEN site WHEN regexp_matches({_TWO}, '^({'|'.join(SECOND_LEVEL)})\\.[a-z][a-z]$') THEN {_TWO} ELSE regexp_extract(site, '[^.]*$') END AS suffix FROM h0
), h AS (
  SELECT *, CASE WHEN suffix = site THEN site WHEN contains(suffix, '.') THEN regexp_extract(site, '([^.]*\\.)?[^.]*\\.[^.]*$') ELSE regexp_extract(site, '([^.]*\\.)?[^.]*$') END AS domain FROM h1
), d0 AS (
  SELECT domain, suffix, {_SUMS.format(n="n_host", x="bad_host")} FROM h GROUP BY domain, suffix
), s0 AS (
  SELECT suffix, {_SUMS.format(n="d0.n", x="d0.x")} FROM d0 GROUP BY suffix
), w0 AS (
  SELECT {_SUMS.format(n="s0.n", x="s0.x")} FROM s0
), kh AS ({_STRENGTH} d0 WHERE n > 0)), kd AS ({_STRENGTH} s0 WHERE n > 0)), ks AS ({_STRENGTH} w0 WHERE n > 0)),
s AS (
  SELECT suffix, (s0.x + ks.m * w0.x / nullif(w0.n, 0)) / (s0.n + ks.m) AS mean_s FROM s0, w0, ks
), d AS (
  SELECT domain, (d0.x + kd.m * mean_s) / (d0.n + kd.m) AS mean_d FROM d0 JOIN s USING (suffix), kd
), ab AS (
  SELECT site, n_host, bad_host, bad_host + kh.m * mean_d AS a, n_host - bad_host + kh.m * (1 - mean_d) AS b FROM h JOIN d USING (domain), kh
), r AS (
  SELECT site, n_host, bad_host, a / (a + b) - {Z}::DOUBLE * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > {MOST_BAD}::DOUBLE AS blocked FROM ab
), x AS (
  SELECT page_id, host, path, site,
    host = 'net' OR ends_with(host, '.net') AS net, host = 'example.net' OR ends_with(host, '.example.net') AS example_net,
    host = 'example.com' OR ends_with(host, '.example.com') AS example_com, host = 'org' OR ends_with(host, '.org') AS org FROM u
), y AS (
  SELECT *, CASE WHEN example_net AND starts_with(path, '/en/') THEN 'example.net/en/' WHEN example_com AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN org AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN net AND starts_with(path, '/') THEN 'net/' END AS rule FROM x
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN coalesce(blocked, false) THEN 'block' ELSE 'allow' END AS verdict,
  CAST(coalesce(n_host, 0) AS BIGINT) AS n_host, CAST(coalesce(bad_host, 0) AS BIGINT) AS bad_host
FROM y LEFT JOIN r USING (site)
"""
