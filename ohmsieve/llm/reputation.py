"""Empirical-Bayes host reputation for page URLs.

Labelled outcomes of pages (good or not) are counted by host, registered
domain and public suffix.  Each level's rate is shrunk towards the level
above it by a beta-binomial prior whose strength is estimated by moments from
the spread between that level's groups.  A host's bound is the upper quantile
(QUANTILE) of its beta posterior, found on a grid of the posterior's density: its
rate lies below with that probability.  A host's pages are blocked if even the
bound is less than a share (LEAST_SHARE) of the rate of all labelled pages, so
it takes evidence of bad pages to block and few pages alone never do.  Explicit
rules come first; the longest that fits wins.  Only DataFrame functions are used.

Defined cases: a null url or one without ``://`` has an empty host and path
and the reputation of the empty host; a host without labelled pages is judged
by its domain's posterior, and if that has none either by its suffix's; without
any labelled page, or with good ones only, nothing is blocked; repeated pages
are judged, and count, each; labels that a page_id has from several urls count
as the worst of them; urls may be of any length; an empty table gives no row;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Workspace, read

#: (verdict, rule): a host and its subdomains, with the start of a path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Labels that make a public suffix of two labels when a country's two letters follow; any other suffix is the last label.
SECOND_LEVEL = "ac|co|com|edu|gob|gov|go|ltd|mil|ne|net|nom|or|org|plc|sch"
#: The bound is this quantile of the posterior, and must reach this share of the rate of all labelled pages.
QUANTILE, LEAST_SHARE = 0.95, 0.5
#: Least and most pages that a prior is worth.
STRENGTH = (2.0, 500.0)
#: Steps of the grid for a bound, a tenth of a standard deviation each.
GRID = 400
#: A host's pages meet its row in parts of at most one in so many of all pages; so no more than twice as many rows are copies.
PARTS = 1000


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    at = F.instr(url, "://")
    tail = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(tail, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(tail, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; both null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule in sorted(rules, key=lambda r: len(r[1])):
        domain, _, start = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + start)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def site_of(host: Column) -> tuple[Column, Column]:
    """Registered domain and public suffix of a host; a port or user name is ignored."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")
    wide = rf"(?:{SECOND_LEVEL})\.[a-z][a-z]"
    suffix = F.when(bare.rlike(r"^[\d.]+$"), F.lit("")).otherwise(F.regexp_extract(bare, rf"(?:^|\.)({wide}|[^.]*)$", 1))
    domain = F.when(bare.rlike(r"^[\d.]+$"), bare).otherwise(F.regexp_extract(bare, rf"((?:[^.]+\.)?(?:{wide}|[^.]*))$", 1))
    return domain, suffix


def strength(stats: DataFrame) -> float:
    """The prior's weight in pages, by moments: how far the rates of groups (k good of n, expected rate m) spread beyond what chance explains."""
    n, m = F.col("n"), F.col("m")
    sums = stats.filter("n > 0").agg(F.sum(n * m * (1 - m)), F.sum(n), F.count(F.lit(1)), F.sum(F.pow(F.col("k") - n * m, 2) / n))
    v, total, groups, q = sums.first()  # one row
    if not total:
        return STRENGTH[0]
    base = v / total
    between = (q - groups * base) / total
    return min(max(base / between - 1, STRENGTH[0]), STRENGTH[1]) if between > 0 else STRENGTH[1]


def beta_quantile(a: Column, b: Column, q: float = QUANTILE) -> Column:
    """The q-quantile of beta(a, b) with a, b > 0.

    In terms of u = ln(x / (1 - x)) the density is smooth and falls off
    exponentially on both sides for any a and b, so equal steps sum it well.
    """
    mode, sd = F.log(a / b), F.sqrt(1 / a + 1 / b)
    soft = lambda u: F.greatest(u, F.lit(0.0)) + F.log1p(F.exp(-F.abs(u)))
    at = lambda i: mode + sd * (i - GRID / 2) * 0.1
    weight = lambda i: F.exp(a * (at(i) - mode) - (a + b) * (soft(at(i)) - soft(mode)))
    mass = F.transform(F.sequence(F.lit(0), F.lit(GRID)), lambda i: weight(i.cast("double")))
    total = F.aggregate(mass, F.lit(0.0), lambda s, x: s + x)
    # the accumulator carries the goal, which would be computed anew for each step otherwise
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(-0.5).alias("steps"), (F.lit(q) * total).alias("goal"))
    # a step counts as far as the goal reaches into it; steps without any mass before it count whole
    share = lambda s, x: F.when(x > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (s["goal"] - s["sum"]) / x))).otherwise(F.when(s["sum"] > 0, 0.0).otherwise(1.0))
    found = F.aggregate(mass, start, lambda s, x: F.struct((s["sum"] + x).alias("sum"), (s["steps"] + share(s, x)).alias("steps"), s["goal"].alias("goal")))
    return 1 / (1 + F.exp(-at(found["steps"])))


def reputations(outcomes: DataFrame) -> DataFrame:
    """host, pages, labelled, host_rate, host_bound, all_rate from rows (host, domain, suffix, good), ``good`` null where a page has no label.

    Every host of the input gets a row, also without labels; ``all_rate`` is the rate of all labelled pages.
    """
    ws = Workspace(outcomes.sparkSession, "reputation")
    hosts = outcomes.groupBy("host", "domain", "suffix").agg(F.coalesce(F.sum("good"), F.lit(0)).cast("double").alias("k"), F.count("good").cast("double").alias("n"), F.count(F.lit(1)).alias("pages"))
    hosts = ws.table("counts", hosts)  # read at every level
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    suffixes = domains.groupBy("suffix").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    k, n = suffixes.agg(F.coalesce(F.sum("k"), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0.0))).first()  # one row
    every = (k + 1) / (n + 2)

    def shrunk(stats: DataFrame) -> DataFrame:
        """The posterior (a, b) of groups (k, n) with the prior rate m; a group without labels has that of the level above (a0, b0)."""
        w = strength(stats)
        own = lambda x, m: F.col(x) + w * m
        none = F.col("n") == 0
        a, b = F.when(none, F.col("a0")).otherwise(own("k", F.col("m"))), F.when(none, F.col("b0")).otherwise(F.col("n") - F.col("k") + w * (1 - F.col("m")))
        return stats.withColumns({"a": a, "b": b}).drop("m", "a0", "b0")

    above = lambda name, df: df.select(*name, (F.col("a") / (F.col("a") + F.col("b"))).alias("m"), F.col("a").alias("a0"), F.col("b").alias("b0"))
    suffixes = shrunk(suffixes.withColumns({"m": F.lit(every), "a0": F.lit(k + 1.0), "b0": F.lit(n - k + 1.0)}))
    domains = shrunk(domains.join(above(["suffix"], suffixes), "suffix"))
    hosts = shrunk(hosts.join(above(["domain", "suffix"], domains), ["domain", "suffix"]))
    rate = F.col("a") / (F.col("a") + F.col("b"))
    return ws.table("hosts", hosts.select("host", "pages", F.col("n").cast("long").alias("labelled"), rate.alias("host_rate"), beta_quantile(F.col("a"), F.col("b")).alias("host_bound"), F.lit(every).alias("all_rate")))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, least: float = LEAST_SHARE) -> DataFrame:
    """page_id, host, path, rule, verdict, host_rate, host_bound for every page; outcomes: (page_id, good 0 or 1), at most one row a page_id.

    A host may hold a third of all pages: counts are taken before any shuffle
    by host, and pages meet a host that has many in as many parts as its share
    of them asks for.
    """
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    domain, suffix = site_of(F.col("host"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    seen = rows.select("page_id", "host", domain.alias("domain"), suffix.alias("suffix")).join(outcomes.select("page_id", "good"), "page_id", "left")
    rep = reputations(seen)
    total = rep.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]  # one row
    hot = rep.filter(F.col("pages") * PARTS > total).select("host", F.ceil(F.col("pages") * PARTS / max(1, total)).cast("int").alias("parts"))
    hot = F.broadcast(hot)  # fewer than PARTS hosts have more than one in PARTS of all pages
    parts = F.coalesce("parts", F.lit(1))
    copies = rep.join(hot, "host", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    rows = rows.withColumns({"rule": name, "_said": verdict}).join(hot, "host", "left")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), parts).cast("int")).drop("parts")
    out = rows.join(copies, ["host", "salt"], "left")
    by_method = F.when(F.col("host_bound") < least * F.col("all_rate"), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("_said", by_method).alias("verdict"), "host_rate", "host_bound")


def outcomes_by_url(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels of pages whose url ends in the number of a labelled document: good is quality 1 and not toxic; one row a page_id."""
    number = F.expr("try_cast(regexp_extract(url, '://[^/?#]*/[a-z]+/([0-9]+)', 1) AS BIGINT)")
    good = F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0)
    by_doc = labels.filter(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min(good).alias("good"))
    numbered = pages.filter(F.col("page_id").isNotNull()).select("page_id", number.alias("doc_id"))
    return numbered.join(by_doc, "doc_id").groupBy("page_id").agg(F.min("good").alias("good"))


def op6_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return judge(pages, outcomes_by_url(pages, read(spark, sf_dir, "labels")))
