"""URL filter: fixed rules first, then an empirical-Bayes reputation of the host.

A page outcome is bad or not.  Counts of labelled outcomes are summed per host, registered domain and public
suffix, the last label of a host or a country's customary second level with it (co.uk).  At each level the beta-binomial prior strength is estimated from all groups of that level (analysis
of variance, method of moments; from 1 to 999 pseudo-observations, 2 where it cannot be estimated), and every posterior mean serves as prior mean one level down: suffix
under the global rate, domain under its suffix, host under its domain.  A page is blocked when the lower bound of
its host's posterior, ``mean - z * sd``, reaches ``threshold``; hosts without labels inherit their domain's
posterior.  Everything is DataFrame code; hot hosts are summed map-side, counts are settled once per level, and verdicts
of hosts are broadcast if few were counted; else adaptive execution splits a dominating host.

A null URL or one without ``://`` has an empty host and path and forms a group of its own.  Null labels are
no outcomes.  Without labels every rate is 1/2 with the spread of a uniform prior, and the bound stays below
the threshold.
Ties and repeated rows are counted as they stand, urls of any length are judged whole.  Input columns are carried along whatever their
names, those with the names of results are replaced.  Without pages the result is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorloom.plans.recovery import settled, small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Share of bad pages that the lower bound must reach, and standard deviations below the mean.
THRESHOLD, Z = 0.25, 1.0
#: Second levels under which countries register domains (fixed values).
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "mil", "net", "ne", "nom", "or", "org", "sch")
#: A rule: verdict, host, path prefix.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (host itself or a subdomain, path prefix) and its verdict; else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for kind, name, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        rule = F.when(fits, F.lit(name + prefix)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def registered(host: Column, second: tuple[str, ...] = SECOND_LEVEL) -> tuple[Column, Column]:
    """Registered domain and public suffix of a host.

    The suffix is the last label, or the last two where the last has two letters and the one before is a customary second level; the domain
    has one label more.  A host that is a suffix, or has no dot, is its own domain.
    """
    last, before = F.substring_index(host, ".", -1), F.substring_index(F.substring_index(host, ".", -2), ".", 1)
    two = (F.length(last) == 2) & before.isin(*second) & (F.instr(host, ".") > 0)
    last_of = lambda n: F.substring_index(host, ".", -n)
    return F.when(two, last_of(3)).otherwise(last_of(2)), F.when(two, last_of(2)).otherwise(last_of(1))


def _strengths(groups: DataFrame) -> DataFrame:
    """_level, _c: prior strength of a beta-binomial from the (n, k) of every level's groups, by analysis of variance; one row per level."""
    n, k = F.col("n"), F.col("k")
    s = groups.groupBy("_level").agg(
        F.count(F.lit(1)).alias("m"), F.sum(n).alias("t"), F.sum(k).alias("b"),
        F.sum(k * k / n).alias("kk"), F.sum(n * n).alias("nn"),
    )
    m, t, b, kk, nn = (F.col(c).cast("double") for c in ("m", "t", "b", "kk", "nn"))
    between = (kk - b * b / t) / (m - 1)
    within = (b - kk) / (t - m)
    size = (t - nn / t) / (m - 1)
    rho = (between - within) / (between + (size - 1) * within)
    rho = F.when((m < 2) | (t <= m) | (between + (size - 1) * within <= 0), 1.0 / 3).otherwise(rho)
    rho = F.least(F.greatest(rho, F.lit(0.001)), F.lit(0.5))
    return s.select("_level", ((1 - rho) / rho).alias("_c"))


def reputations(outcomes: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """Posteriors of every labelled suffix, domain and host: level, name, mean, strength; and the numbers of the priors.

    ``outcomes`` has rows (host, bad 0/1).  They are summed once, per host, and settled; levels above are sums of the one below.
    """
    domain, suffix = registered(F.col("host"))
    hosts = outcomes.groupBy("host").agg(F.count("bad").cast("double").alias("n"), F.sum("bad").cast("double").alias("k")).where("n > 0")
    hosts = settled(hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "k"))
    sums = lambda df, *by: df.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    domains = settled(sums(hosts, "domain", "suffix"))
    suffixes = settled(sums(domains, "suffix"))
    leveled = [df.select(F.lit(level).alias("_level"), "n", "k") for level, df in (("host", hosts), ("domain", domains), ("suffix", suffixes))]
    c = {"host": 2.0, "domain": 2.0, "suffix": 2.0} | {r["_level"]: r["_c"] for r in _strengths(leveled[0].union(leveled[1]).union(leveled[2])).collect()}  # three rows
    bad, all_ = suffixes.agg(F.sum("k"), F.sum("n")).first()
    rate = ((bad or 0.0) + 1) / ((all_ or 0.0) + 2)

    def level(name: str, mean: Column) -> list[Column]:
        strength = F.col("n") + F.lit(c[name])
        return [F.lit(name).alias("level"), F.col(name).alias("name"), ((F.col("k") + F.lit(c[name]) * mean) / strength).alias("mean"), strength.alias("strength")]

    above = lambda df, name: df.select(F.col("name").alias("_name"), F.col("mean").alias("_mean"))
    by_suffix = settled(suffixes.select(*level("suffix", F.lit(rate))))
    by_domain = settled(domains.join(small(above(by_suffix, "suffix")), F.col("suffix") == F.col("_name")).select(*level("domain", F.col("_mean"))))
    by_host = hosts.join(small(above(by_domain, "domain")), F.col("domain") == F.col("_name")).select(*level("host", F.col("_mean")))
    return by_host.union(by_domain).union(by_suffix), c | {"rate": rate}


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, threshold: float = THRESHOLD, z: float = Z) -> DataFrame:
    """Rows of ``pages`` (needs url) with host, path, rule, bad_rate, bound and verdict.

    ``outcomes`` has rows (url, bad): a labelled page outcome each.
    """
    seen = outcomes.where(F.col("bad").isin(0, 1)).select(host_of(F.col("url")).alias("host"), F.col("bad").cast("long").alias("bad"))
    found, prior = reputations(seen)
    found = settled(found)
    rest = pages.drop("host", "path", "rule", "bad_rate", "bound", "verdict")
    # Carried columns go by their number, so that no name of theirs meets one of these.
    aside = [f"_column{k}" for k in range(len(rest.columns))]
    rows = rest.select(*(F.col(c).alias(a) for a, c in zip(aside, rest.columns)), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    domain, suffix = registered(F.col("host"))
    known = rows.select("host").distinct().select(F.col("host").alias("_host"), domain.alias("_domain"), suffix.alias("_suffix"))
    for name in ("host", "domain", "suffix"):
        of = found.where(F.col("level") == name).select(F.col("name").alias(f"_{name}_name"), F.col("mean").alias(f"_{name}_mean"), F.col("strength").alias(f"_{name}_strength"))
        known = known.join(small(of), F.col(f"_{name}") == F.col(f"_{name}_name"), "left")
    mean = F.coalesce("_host_mean", "_domain_mean", "_suffix_mean", F.lit(prior["rate"]))
    # A level without outcomes has only its prior's strength behind the mean of the level above.
    strength = F.coalesce("_host_strength", F.lit(prior["host"]))
    known = settled(known.select("_host", mean.alias("bad_rate"), (mean - z * F.sqrt(mean * (1 - mean) / (strength + 1))).alias("bound")))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    out = rows.join(small(known), F.col("host") == F.col("_host"), "left")
    method = F.when(F.col("bound") >= threshold, "block").otherwise("allow")
    return out.select(*(F.col(a).alias(c) for a, c in zip(aside, rest.columns)), "host", "path", "bad_rate", "bound", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"))


#: DuckDB: the same estimate over pages and labels.
SQL = f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(url, '(?s)\\A.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(url, '(?s)\\A.*?://[^/?#]*([^?#]*)', 1) AS path FROM u),
q AS (
  SELECT *, CASE WHEN len(l) <= parts THEN host ELSE array_to_string(l[-parts - 1:], '.') END AS domain,
         CASE WHEN len(l) <= parts THEN host ELSE array_to_string(l[-parts:], '.') END AS suffix
  FROM (SELECT *, string_split(host, '.') AS l, CASE WHEN len(l) > 1 AND length(l[-1]) = 2 AND l[-2] IN ({", ".join(f"'{x}'" for x in SECOND_LEVEL)}) THEN 2 ELSE 1 END AS parts FROM p)),
o AS (SELECT host, any_value(domain) AS domain, any_value(suffix) AS suffix, count(*)::DOUBLE AS n, sum(1 - quality)::DOUBLE AS k
      FROM q JOIN labels ON doc_id = page_id WHERE quality IN (0, 1) GROUP BY host),
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM o GROUP BY domain, suffix),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY suffix),
lv AS (SELECT 'h' AS l, n, k FROM o UNION ALL SELECT 'd', n, k FROM d UNION ALL SELECT 's', n, k FROM s),
v AS (SELECT l, count(*)::DOUBLE AS m, sum(n) AS t, sum(k) AS b, sum(k * k / n) AS kk, sum(n * n) AS nn FROM lv GROUP BY l),
w AS (SELECT l, m, t, (kk - b * b / t) / (m - 1) AS bt, (b - kk) / (t - m) AS wi, (t - nn / t) / (m - 1) AS sz FROM v),
r AS (SELECT l, least(greatest(CASE WHEN m < 2 OR t <= m OR bt + (sz - 1) * wi <= 0 THEN 1.0::DOUBLE / 3 ELSE (bt - wi) / (bt + (sz - 1) * wi) END, 0.001), 0.5) AS rho FROM w),
c AS (SELECT max(CASE WHEN l = 'h' THEN (1 - rho) / rho END) AS ch, max(CASE WHEN l = 'd' THEN (1 - rho) / rho END) AS cd,
             max(CASE WHEN l = 's' THEN (1 - rho) / rho END) AS cs FROM r),
z AS (SELECT (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2) AS p0 FROM s),
sm AS (SELECT suffix, (k + cs * p0) / (n + cs) AS m FROM s, c, z),
dm AS (SELECT domain, (d.k + cd * sm.m) / (d.n + cd) AS m FROM d JOIN sm USING (suffix), c),
hm AS (SELECT host, (o.k + ch * dm.m) / (o.n + ch) AS m, o.n + ch AS s FROM o JOIN dm USING (domain), c),
j AS (SELECT q.page_id, q.host, q.path, coalesce(hm.m, dm.m, sm.m, z.p0) AS m, coalesce(hm.s, c.ch) AS s
      FROM q LEFT JOIN hm ON hm.host = q.host LEFT JOIN dm ON dm.domain = q.domain LEFT JOIN sm ON sm.suffix = q.suffix, c, z),
f AS (SELECT page_id, host, path, m - {Z} * sqrt(m * (1 - m) / (s + 1)) AS bound,
        CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
             WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
             WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
             WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM j)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN bound >= {THRESHOLD} THEN 'block' ELSE 'allow' END AS verdict FROM f
"""
