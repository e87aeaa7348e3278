"""URL filters: rules by longest match, else empirical-Bayes host reputation.

Labelled page outcomes (good or bad) are counted by host, registered domain and suffix. Each level
is a beta-binomial whose prior mean is the posterior mean of the level above and whose strength is
fitted by moments from the spread of its children; the root prior is uniform. A page is blocked when
its host's good rate lies under a limit with at least `certainty` of the posterior (its upper bound is
under the limit), so little evidence never blocks. The posterior's tail is the incomplete beta function,
by its continued fraction. All of it is DataFrame expressions; counts combine before every shuffle, and
the table of hosts is written once.

For the reputation only, a host is taken without user part and port; an IP address is its own
registered domain and suffix; under a public suffix of several labels (`PUBLIC_SUFFIXES`, a parameter)
the registered domain has one label more.

Defined cases: a null url, or one without '://', has empty host and path and is judged by the root;
null outcomes do not count; repeated rows are judged one by one; hosts without a dot are their own
registered domain and suffix; urls of any length are read whole; an empty table gives no rows; extra
columns are ignored."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beamframe.llm.common import materialise


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Suffixes of more than one label under which names are registered, a default for common ones
PUBLIC_SUFFIXES = (
    "ac.jp", "ac.uk", "co.id", "co.il", "co.in", "co.jp", "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.hk",
    "com.mx", "com.my", "com.sg", "com.tr", "com.tw", "com.ua", "edu.au", "gov.uk", "ne.jp", "net.au", "net.br", "or.jp", "org.au", "org.br", "org.uk",
)


@dataclass(frozen=True)
class ReputationConfig:
    certainty: float = 0.95  # of the posterior, one-sided
    min_good_rate: float = 0.5
    max_strength: float = 1000.0
    min_strength: float = 2.0
    steps: int = 64  # of the continued fraction, two coefficients each
    suffixes: tuple[str, ...] = PUBLIC_SUFFIXES


RULES = (
    UrlRule("org", "/", "allow"),
    UrlRule("example.org", "/es/", "block"),
    UrlRule("example.org", "/en/1", "block"),
    UrlRule("com", "/fr/", "allow"),
    UrlRule("com", "/de/", "block"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reputation_host(host: Column) -> Column:
    """The host without user part and port."""
    return F.regexp_extract(host, r"(?s)^(?:.*@)?(\[[^\]]*\]|[^:]*)", 1)


def suffix_of(host: Column, suffixes: tuple[str, ...] = PUBLIC_SUFFIXES) -> Column:
    ip = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$|^\[")
    two = F.regexp_extract(host, r"([^.]*\.[^.]*)$", 1)
    return F.when(ip | two.isin(*suffixes), F.when(ip, host).otherwise(two)).otherwise(F.regexp_extract(host, r"([^.]*)$", 1))


def registered_domain(host: Column, suffix: Column) -> Column:
    """The suffix and the label before it, if there is one."""
    before = F.rtrim(F.substring(host, F.lit(1), F.length(host) - F.length(suffix)), F.lit("."))
    label = F.regexp_extract(before, r"([^.]*)$", 1)
    return F.when(F.length(host) > F.length(suffix), F.concat(label, F.lit("."), suffix)).otherwise(suffix)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest fitting rule (host and path together), else null."""
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.name))
    name = verdict = F.lit(None).cast("string")
    for r in reversed(ordered):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name = F.when(fits, F.lit(r.name)).otherwise(name)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def _strength(n: str, k: str, mean: str, cfg: ReputationConfig) -> Column:
    """Method-of-moments prior strength from children with counts n, successes k and prior mean.

    Expected sum of n(p-m)^2 over g children is m(1-m)(g + rho*(N-g)), rho = 1/(strength+1)."""
    g, total = F.count(F.lit(1)), F.sum(n)
    between = F.sum(F.col(n) * F.pow(F.col(k) / F.col(n) - F.col(mean), 2))
    var = F.greatest(F.max(F.col(mean) * (1 - F.col(mean))), F.lit(1e-6))
    rho = F.when(total > g, (between / var - g) / (total - g))
    return F.greatest(F.lit(cfg.min_strength), F.least(F.lit(cfg.max_strength), F.coalesce(F.when(rho > 0, 1 / rho - 1), F.lit(cfg.max_strength))))


def reputations(hosts: DataFrame, cfg: ReputationConfig = ReputationConfig()) -> DataFrame:
    """hosts(name, domain, suffix, n, k): k good of n labelled outcomes -> (level, key, a, b), the beta
    posteriors of every host, domain and suffix that has an outcome, and of the root."""
    hosts = hosts.where("n > 0").groupBy("name", "domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    n, k = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0))
    root = suffixes.agg((F.lit(1.0) + k).alias("a"), (F.lit(1.0) + n - k).alias("b"))
    # one row, under the key that every suffix has
    top = root.select(F.lit(0).alias("top"), "a", "b")
    suffixes = suffixes.withColumn("top", F.length("suffix") * 0)

    def level(children: DataFrame, parents: DataFrame, on: str) -> DataFrame:
        """Posterior of each child under its parent's mean and the strength fitted on its siblings."""
        with_m = children.join(parents.select(on, (F.col("a") / (F.col("a") + F.col("b"))).alias("m")), on)
        fitted = with_m.groupBy(on).agg(_strength("n", "k", "m", cfg).alias("s"))
        return with_m.join(fitted, on).withColumn("a", F.col("m") * F.col("s") + F.col("k")).withColumn("b", (1 - F.col("m")) * F.col("s") + F.col("n") - F.col("k")).drop("m", "s")

    # each level is read several times below it and is small: one row per host at most
    s = materialise(level(suffixes, top, "top"), "url-suffixes")
    d = materialise(level(domains, s, "suffix"), "url-domains")
    h = level(hosts, d, "domain")
    out = root.select(F.lit("root").alias("level"), F.lit("").alias("key"), "a", "b")
    for df, name, key in ((h, "host", "name"), (d, "domain", "domain"), (s, "suffix", "suffix")):
        out = out.unionByName(df.select(F.lit(name).alias("level"), F.col(key).alias("key"), "a", "b"))
    return out


def log_gamma(x: Column) -> Column:
    """Stirling's series, eight places up."""
    y = x + 8
    product = x
    for i in range(1, 8):
        product = product * (x + i)
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7))
    return (y - 0.5) * F.ln(y) - y + 0.9189385332046727 + series - F.ln(product)


def beta_below(a: Column, b: Column, x: float, steps: int) -> Column:
    """P(Beta(a, b) <= x), the regularised incomplete beta function: Lentz's continued fraction, from the
    side of the mean where it converges fast."""

    def fraction(p: Column, q: Column, at: float) -> Column:
        tiny = lambda v: F.when(F.abs(v) < 1e-300, 1e-300).otherwise(v)
        d0 = 1 / tiny(1 - (p + q) * at / (p + 1))
        start = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))

        def advance(t: Column, coefficient: Column) -> Column:
            d = 1 / tiny(1 + coefficient * t["d"])
            c = tiny(1 + coefficient / t["c"])
            return F.struct(c.alias("c"), d.alias("d"), (t["h"] * d * c).alias("h"))

        # two coefficients a step, even ones and odd ones
        def step(t: Column, i: Column) -> Column:
            m = F.floor(i / 2).cast("double")
            even = m * (q - m) * at / ((p + 2 * m - 1) * (p + 2 * m))
            odd = -(p + m) * (p + q + m) * at / ((p + 2 * m) * (p + 2 * m + 1))
            return advance(t, F.when(i % 2 == 0, even).otherwise(odd))

        got = F.aggregate(F.sequence(F.lit(2), F.lit(2 * steps + 1)), start, step, lambda t: t["h"])
        front = F.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * F.lit(math.log(at)) + q * F.lit(math.log(1 - at)))
        return front * got / p

    return F.when(F.lit(x) < (a + 1) / (a + b + 2), fraction(a, b, x)).otherwise(1 - fraction(b, a, 1 - x))


def judge_urls(pages: DataFrame, outcomes: DataFrame, cfg: ReputationConfig = ReputationConfig(), rules=RULES) -> DataFrame:
    """pages(page_id, url), outcomes(page_id, good) -> page_id, host, path, rule, verdict, bad_certainty."""
    p = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    told = outcomes.where("good is not null").groupBy("page_id").agg(F.min(F.col("good").cast("long")).alias("good"))
    # one row per distinct host with its labelled outcomes, written once
    hosts = p.select("page_id", "host").join(told, "page_id", "left").groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("k"))
    name = reputation_host(F.col("host"))
    hosts = hosts.withColumn("name", name).withColumn("suffix", suffix_of(F.col("name"), cfg.suffixes)).withColumn("domain", registered_domain(F.col("name"), F.col("suffix")))
    hosts = materialise(hosts, "url-hosts")
    rep = materialise(reputations(hosts, cfg), "url-reputations")
    # the finest level that has evidence
    levels = F.array(*[F.struct(F.lit(r).alias("rank"), F.lit(lv).alias("level"), k.alias("key")) for r, lv, k in ((0, "host", F.col("name")), (1, "domain", F.col("domain")), (2, "suffix", F.col("suffix")), (3, "root", F.lit("")))])
    keys = hosts.select("host", F.explode(levels).alias("x")).select("host", "x.*")
    best = keys.join(rep, ["level", "key"]).groupBy("host").agg(F.min(F.struct("rank", "a", "b")).alias("x"))
    judged = best.select("host", F.round(beta_below(F.col("x.a"), F.col("x.b"), cfg.min_good_rate, cfg.steps), 6).alias("bad_certainty"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("bad_certainty") >= cfg.certainty, "block").otherwise("allow")
    return p.join(judged, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "bad_certainty")


def outcomes_from_labels(labels: DataFrame) -> DataFrame:
    """A page is good when the labelled record of the same number is of quality and not toxic; null labels do
    not count. The tables label documents, not pages: that a page has the outcome of the document with
    its number is this function's assumption, and `judge_urls` takes any other outcomes."""
    good = F.when(F.col("quality").isNotNull() & F.col("toxic").isNotNull(), ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int"))
    return labels.select(F.col("doc_id").alias("page_id"), good.alias("good"))


ORACLE_SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id,
    CASE WHEN position('://' IN coalesce(url, '')) = 0 THEN ''
         ELSE translate(regexp_extract(substr(url, position('://' IN url) + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS host,
    CASE WHEN position('://' IN coalesce(url, '')) = 0 THEN ''
         ELSE regexp_extract(substr(url, position('://' IN url) + 3), '^[^/?#]*([^?#]*)', 1) END AS path
  FROM pages),
o AS (SELECT doc_id AS page_id, min(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS good
      FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1),
n AS (SELECT *, regexp_extract(host, '^(?:.*@)?(\[[^\]]*\]|[^:]*)', 1) AS name FROM p),
x AS (SELECT *, CASE WHEN regexp_matches(name, '^\d{1,3}(\.\d{1,3}){3}$|^\[') THEN name
        WHEN list_contains([SUFFIXES], regexp_extract(name, '([^.]*\.[^.]*)$', 1)) THEN regexp_extract(name, '([^.]*\.[^.]*)$', 1)
        ELSE regexp_extract(name, '([^.]*)$', 1) END AS suffix FROM n),
q AS (SELECT *, CASE WHEN length(name) > length(suffix) THEN regexp_extract(rtrim(left(name, length(name) - length(suffix)), '.'), '([^.]*)$', 1) || '.' || suffix ELSE suffix END AS domain FROM x),
h AS (SELECT name, domain, suffix, count(*)::DOUBLE AS n, sum(good)::DOUBLE AS k FROM q JOIN o USING (page_id) GROUP BY ALL),
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY ALL),
r AS (SELECT 1 + coalesce(sum(k), 0) AS a, 1 + coalesce(sum(n) - sum(k), 0) AS b FROM s),
sf AS (SELECT a / (a + b) AS m FROM r),
ss AS (SELECT greatest(2.0, least(1000.0, coalesce(CASE WHEN rho > 0 THEN 1 / rho - 1 END, 1000.0))) AS st FROM (
        SELECT CASE WHEN sum(n) > count(*) THEN (sum(n * (k / n - m) * (k / n - m)) / greatest(max(m * (1 - m)), 1e-6) - count(*)) / (sum(n) - count(*)) END AS rho FROM s, sf)),
sp AS (SELECT suffix, m * st + k AS a, (1 - m) * st + n - k AS b FROM s, sf, ss),
dm AS (SELECT d.*, sp.a / (sp.a + sp.b) AS m FROM d JOIN sp USING (suffix)),
ds AS (SELECT suffix, greatest(2.0, least(1000.0, coalesce(CASE WHEN rho > 0 THEN 1 / rho - 1 END, 1000.0))) AS st FROM (
        SELECT suffix, CASE WHEN sum(n) > count(*) THEN (sum(n * (k / n - m) * (k / n - m)) / greatest(max(m * (1 - m)), 1e-6) - count(*)) / (sum(n) - count(*)) END AS rho FROM dm GROUP BY suffix)),
dp AS (SELECT domain, m * st + k AS a, (1 - m) * st + n - k AS b FROM dm JOIN ds USING (suffix)),
hm AS (SELECT h.*, dp.a / (dp.a + dp.b) AS m FROM h JOIN dp USING (domain)),
hs AS (SELECT domain, greatest(2.0, least(1000.0, coalesce(CASE WHEN rho > 0 THEN 1 / rho - 1 END, 1000.0))) AS st FROM (
        SELECT domain, CASE WHEN sum(n) > count(*) THEN (sum(n * (k / n - m) * (k / n - m)) / greatest(max(m * (1 - m)), 1e-6) - count(*)) / (sum(n) - count(*)) END AS rho FROM hm GROUP BY domain)),
hp AS (SELECT name, m * st + k AS a, (1 - m) * st + n - k AS b FROM hm JOIN hs USING (domain)),
e AS (SELECT q.page_id, q.host, q.path,
        coalesce(hp.a, dp.a, sp.a, r.a) AS a, coalesce(hp.b, dp.b, sp.b, r.b) AS b
      FROM q LEFT JOIN hp ON q.name = hp.name LEFT JOIN dp ON q.domain = dp.domain LEFT JOIN sp ON q.suffix = sp.suffix CROSS JOIN r),
ab AS (SELECT DISTINCT a, b, 0.5 < (a + 1) / (a + b + 2) AS straight, CASE WHEN 0.5 < (a + 1) / (a + b + 2) THEN a ELSE b END AS p, CASE WHEN 0.5 < (a + 1) / (a + b + 2) THEN b ELSE a END AS q FROM e),
cf AS (SELECT a, b, p, q, 2 AS i, 1.0::DOUBLE AS c, 1 / (1 - (p + q) * 0.5::DOUBLE / (p + 1)) AS d, 1 / (1 - (p + q) * 0.5::DOUBLE / (p + 1)) AS h FROM ab
       UNION ALL
       SELECT a, b, p, q, i + 1, 1 + w / c, 1 / (1 + w * d), h * (1 + w / c) / (1 + w * d) FROM (
         SELECT *, CASE WHEN i % 2 = 0 THEN (i // 2) * (q - i // 2) * 0.5::DOUBLE / ((p + i - 1) * (p + i))
                        ELSE -(p + i // 2) * (p + q + i // 2) * 0.5::DOUBLE / ((p + i - 1) * (p + i)) END AS w FROM cf WHERE i <= 129)),
tail AS (SELECT ab.a, ab.b, CASE WHEN straight THEN v ELSE 1 - v END AS bad FROM ab JOIN (
         SELECT a, b, exp(lgamma(p + q) - lgamma(p) - lgamma(q) + (p + q) * ln(0.5::DOUBLE)) * h / p AS v FROM cf WHERE i = 130) USING (a, b)),
f AS (SELECT e.*, round(bad, 6) AS bad_certainty,
        CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
             WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
             WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
             WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
             WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM e JOIN tail USING (a, b))
SELECT page_id, host, path, rule,
  CASE rule WHEN 'example.org/en/1' THEN 'block' WHEN 'example.org/es/' THEN 'block' WHEN 'com/de/' THEN 'block'
    WHEN 'com/fr/' THEN 'allow' WHEN 'org/' THEN 'allow' ELSE CASE WHEN bad_certainty >= 0.95 THEN 'block' ELSE 'allow' END END AS verdict,
  bad_certainty
FROM f
""".replace("SUFFIXES", ", ".join(f"'{s}'" for s in PUBLIC_SUFFIXES))
