"""URL filter by empirical-Bayes host reputation. Built-in DataFrame functions only.

Labelled page outcomes (good or bad) are counted per host. Each level of the name tree shrinks
towards the level above it through a beta-binomial prior: suffix towards all pages, registered
domain towards its suffix, host towards its domain. The strength of each prior is estimated
from the spread between the groups of that level by moments. A host passes if the lower bound
``mean - z * sd`` of its beta posterior reaches ``least_good``; a host without labelled pages is
judged by what its domain lends it.

Explicit rules come first: a rule ``host/path`` fits its host and all subdomains where the
path of the url starts with the rule's; the longest fitting rule decides.

Defined results: a null url, or one without ``://``, has empty host and path; no rule fits it and
it is judged as a host of its own under an empty suffix. Outcomes that are null are not counted.
Repeated rows are judged one by one and each counts. No pages: no rows. Other columns of the
pages, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch

#: The rules of the contract: verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


@dataclass(frozen=True)
class Reputation:
    """``z``: standard deviations below the mean; ``least_good``: least share of good pages;
    ``suffixes``: public suffixes of two or three labels, or ``*.`` and a label under which each name is a suffix, as
    :func:`read_suffixes` takes them from a public suffix list; ``rho``: bounds of a prior's intra-class correlation."""

    z: float = 1.645
    least_good: float = 0.6
    suffixes: tuple[str, ...] = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br")
    rho: tuple[float, float] = (0.001, 0.5)


def read_suffixes(path: str) -> tuple[str, ...]:
    """The suffixes of two or three labels, and the wildcard rules, of a file in the format of the public suffix list, read by the driver. Exceptions are left out."""
    with open(path, encoding="utf-8") as f:
        rules = [line.split()[0].lower() for line in f if line.strip() and not line.startswith("//")]
    return tuple(sorted({r for r in rules if not r.startswith("!") and 1 <= r.count(".") <= 2}))


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    host = F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*", 0)
    return F.when(at > 0, F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise("")


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    after = F.substring(rest, F.length(F.regexp_extract(rest, r"^[^/?#]*", 0)) + 1, F.length(url))
    return F.when(at > 0, F.regexp_extract(after, r"^[^?#]*", 0)).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as ``host/path`` and its verdict; null if none fits."""
    fits = verdict = None
    for said, name, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2])):
        test = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        fits = F.when(test, name + start) if fits is None else fits.when(test, name + start)
        verdict = F.when(test, said) if verdict is None else verdict.when(test, said)
    none = F.lit(None).cast("string")
    return (none, none) if fits is None else (fits, verdict)


def suffix_of(host: Column, suffixes: tuple[str, ...]) -> Column:
    last, two, three = (F.substring_index(host, ".", -n) for n in (1, 2, 3))
    wild = [s[2:] for s in suffixes if s.startswith("*.") and s.count(".") == 1]
    pairs = [s for s in suffixes if s.count(".") == 1 and not s.startswith("*.")]
    triples = [s for s in suffixes if s.count(".") == 2 and not s.startswith("*.")]
    out = F.when(three.isin(*triples), three) if triples else F.when(F.lit(False), last)
    if pairs:
        out = out.when(two.isin(*pairs), two)
    if wild:
        out = out.when(last.isin(*wild), two)
    return out.otherwise(last)


def domain_of(host: Column, suffix: Column) -> Column:
    """The suffix and one label more; the host itself if it has no label more."""
    before = F.substring(host, F.lit(1), F.length(host) - F.length(suffix) - 1)
    return F.when(F.length(host) > F.length(suffix) + 1, F.concat_ws(".", F.substring_index(before, ".", -1), suffix)).otherwise(host)


def _strength(groups: DataFrame, mean: str, rho: tuple[float, float]) -> Column:
    """One row: the pseudo-count of the prior by which groups (n, k) shrink towards ``mean``."""
    n, k, m = F.col("n"), F.col("k"), F.col(mean)
    v = m * (1 - m)
    used = groups.filter(n > 0)
    spread = F.sum((k - n * m) * (k - n * m) / n - v) / F.sum((n - 1) * v)
    r = F.greatest(F.lit(rho[0]), F.least(F.lit(rho[1]), F.coalesce(spread, F.lit(rho[1]))))
    return used.agg((1 / r - 1).alias("s")).first()["s"]


def host_reputation(outcomes: DataFrame, p: Reputation = Reputation()) -> DataFrame:
    """``outcomes``: host string, good int (1, 0 or null). One row per host: n, k, posterior mean and bound."""
    hosts = scratch(
        outcomes.groupBy("host").agg(F.count("good").cast("double").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("double").alias("k"))
        .withColumn("suffix", suffix_of(F.col("host"), p.suffixes)).withColumn("domain", domain_of(F.col("host"), F.col("suffix"))),
        "hosts",
    )
    total = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    root = ((total["k"] or 0.0) + 1) / ((total["n"] or 0.0) + 2)
    counts = [F.sum("n").alias("n"), F.sum("k").alias("k")]

    suffixes = hosts.groupBy("suffix").agg(*counts).withColumn("up", F.lit(root))
    s = _strength(suffixes, "up", p.rho)
    suffixes = suffixes.select("suffix", ((F.col("k") + s * F.col("up")) / (F.col("n") + s)).alias("up"))

    domains = hosts.groupBy("suffix", "domain").agg(*counts).join(suffixes, "suffix")
    s = _strength(domains, "up", p.rho)
    domains = domains.select("domain", ((F.col("k") + s * F.col("up")) / (F.col("n") + s)).alias("up"))

    named = hosts.join(domains, "domain")
    s = _strength(named, "up", p.rho)
    mean = (F.col("k") + s * F.col("up")) / (F.col("n") + s)
    bound = F.col("mean") - p.z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + s + 1))
    return named.select("host", F.col("n").cast("long").alias("n"), F.col("k").cast("long").alias("k"), mean.alias("mean")).withColumn("bound", bound)


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, p: Reputation = Reputation()) -> DataFrame:
    """``pages``: page_id, url; ``outcomes``: url, good. Returns page_id, host, path, rule, verdict."""
    rep = host_reputation(outcomes.select(host_of(F.col("url")).alias("host"), "good"), p)
    judged = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bound") >= p.least_good, "allow").otherwise("block")
    return judged.join(rep.select("host", "bound"), "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(said, own).alias("verdict"))


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url and good of every page: 1 if its label says quality 1 and toxic 0, null if it has none.

    A page's labels are those of its id. Several label rows of one id: good only if all are."""
    good = F.when(F.col("quality").isNull() | F.col("toxic").isNull(), None).when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).otherwise(0)
    marks = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.min(good).alias("good"))
    return pages.select("page_id", "url").join(marks, "page_id", "left").select("url", "good")


def oracle(p: Reputation = Reputation(), rules=RULES) -> str:
    """DuckDB SQL for ``judge(pages, labelled(pages, labels))``."""
    names = ", ".join(f"'{s}'" for s in p.suffixes)
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))
    test = lambda r: f"(host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}')"
    rule = " ".join(f"WHEN {test(r)} THEN '{r[1]}{r[2]}'" for r in ordered)
    said = " ".join(f"WHEN {test(r)} THEN '{r[0]}'" for r in ordered)
    strength = lambda t: f"(SELECT 1 / greatest({p.rho[0]}, least({p.rho[1]}, coalesce(sum((k - n*up)*(k - n*up)/n - up*(1-up)) / nullif(sum((n-1)*up*(1-up)), 0), {p.rho[1]}))) - 1 AS s FROM {t} WHERE n > 0)"
    return f"""
WITH rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS r FROM pages),
cut AS (SELECT page_id, coalesce(translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*'), '') AS path FROM rest),
marks AS (SELECT doc_id AS page_id, min(CASE WHEN quality IS NULL OR toxic IS NULL THEN NULL WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS good FROM labels GROUP BY 1),
h0 AS (SELECT host, count(good)::DOUBLE AS n, coalesce(sum(good), 0)::DOUBLE AS k FROM cut LEFT JOIN marks USING (page_id) GROUP BY 1),
h1 AS (SELECT *, string_split(host, '.') AS l FROM h0),
h2 AS (SELECT *, CASE WHEN array_to_string(l[-2:], '.') IN ({names}) THEN array_to_string(l[-2:], '.') ELSE l[-1] END AS suffix FROM h1),
hosts AS (SELECT host, n, k, suffix, CASE WHEN length(host) > length(suffix) + 1 THEN string_split(substr(host, 1, length(host) - length(suffix) - 1), '.')[-1] || '.' || suffix ELSE host END AS domain FROM h2),
s1 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT (sum(k) + 1) / (sum(n) + 2) FROM hosts) AS up FROM hosts GROUP BY 1),
s2 AS (SELECT suffix, (k + s*up) / (n + s) AS up FROM s1, {strength("s1")}),
d1 AS (SELECT domain, n, k, up FROM (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY 1, 2) JOIN s2 USING (suffix)),
d2 AS (SELECT domain, (k + s*up) / (n + s) AS up FROM d1, {strength("d1")}),
p1 AS (SELECT host, n, k, up FROM hosts JOIN d2 USING (domain)),
p2 AS (SELECT host, n, s, (k + s*up) / (n + s) AS mean FROM p1, {strength("p1")}),
rep AS (SELECT host, mean - {p.z} * sqrt(mean * (1 - mean) / (n + s + 1)) AS bound FROM p2)
SELECT page_id, host, path, CASE {rule} END AS rule,
  coalesce(CASE {said} END, CASE WHEN bound >= {p.least_good} THEN 'allow' ELSE 'block' END) AS verdict
FROM cut LEFT JOIN rep USING (host)"""
