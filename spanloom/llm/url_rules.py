"""URL filters from association rules.

A URL is a set of tokens: the labels of its host, its path segments, query
keys and query values. FP-growth finds token sets that are
frequent among labelled URLs; a set becomes a rule when, of the labelled URLs
that hold it, a large enough share has one verdict, clearly more than with
any smaller set. Rules are matched through an inverted index: a rule is
listed under its rarest token, URLs are joined on their tokens, and the rule
holds if the URL has all its tokens.

Labels come from a fixed list of host and path rules, which also decides the
URLs it covers; the mined rules decide the rest.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import ceil

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.frames import LOWER, UPPER, col_of, stored


@dataclass(frozen=True)
class SiteRule:
    """A verdict for a host, its subdomains and the paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


SITE_RULES = (SiteRule("block", "net", "/"), SiteRule("allow", "example.net", "/en/"),
              SiteRule("block", "example.com", "/de/"), SiteRule("allow", "org", "/fr/"))

MIN_SUPPORT, MIN_ROWS, MIN_CONFIDENCE, MIN_LIFT, MAX_TOKENS = 0.002, 5, 0.9, 1.1, 3


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty for null or without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def site_rule(host: Column, path: Column, rules: tuple[SiteRule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = rule.fits(host, path)
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


#: Frequent items of a basket up to which FP-growth lists all their sets; with wider baskets, sets are counted by size.
WIDEST = 16


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens of the whole URL. Every number is the same token, so that tokens repeat."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    segments = F.filter(F.split(F.regexp_replace(path, "[0-9]+", "0"), "/"), lambda x: x != "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1)
    keys = F.filter(F.split(F.regexp_replace(query, "=[^&]*", ""), "&"), lambda x: x != "")
    values = F.filter(F.split(F.regexp_replace(query, "[0-9]+", "0"), "&"), lambda x: x.rlike("(?s)=."))
    prefixed = lambda kind, parts: F.transform(parts, lambda x: F.concat(F.lit(kind), x))
    return F.array_distinct(F.concat(prefixed("host:", labels), prefixed("path:", segments), prefixed("key:", keys), prefixed("value:", values)))


def _counted(baskets: DataFrame, least: int, longest: int) -> DataFrame:
    """What FP-growth finds, up to ``longest`` tokens: ``tokens``, ``verdict`` (null for any) and ``freq``, at least ``least``.

    Sets grow by one token at a time, only frequent ones go on; so baskets
    of many tokens cost a power of their width and not all their subsets.
    """
    now = baskets.groupBy("tokens", "verdict").agg(F.count("*").alias("w")).withColumn("set", F.array().cast("array<string>"))
    found = []
    for _ in range(longest):
        later = F.filter("tokens", lambda x: F.coalesce(x > F.get("set", F.size("set") - 1), F.lit(True)))
        grown = stored(now.withColumn("item", F.explode(later)).withColumn("set", F.array_append("set", F.col("item"))).drop("item"), "grown_sets")
        own = grown.groupBy("set", "verdict").agg(F.sum("w").alias("freq"))
        total = stored(own.groupBy("set").agg(F.sum("freq").alias("freq")).filter(F.col("freq") >= least), "frequent_totals")
        found += [own.filter(F.col("freq") >= least), total.select("set", F.lit(None).cast("string").alias("verdict"), "freq")]
        now = grown.join(total.select("set"), "set", "left_semi")
    return reduce(DataFrame.union, found).select(F.array_sort("set").alias("tokens"), "verdict", "freq")


def mine(labelled: DataFrame, support: float = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE, lift: float = MIN_LIFT, longest: int = MAX_TOKENS, widest: int = WIDEST) -> DataFrame:
    """Rules ``tokens`` -> ``verdict`` with ``confidence`` and ``support`` (rows).

    ``labelled`` has ``tokens`` and ``verdict``. The verdict joins the tokens
    as an item of its own, so one FP-growth run counts sets with and without
    it. A set without its verdict is a rule when confident enough, more so
    than the verdict is anyway by ``lift``, and more so than every set of one
    token less. Support is a share of all labelled rows (and ``MIN_ROWS``
    rows at least), so the number of frequent sets depends on that share and
    not on the rows. Tokens below it go before the mining. Where more than
    ``widest`` stay in a basket, ``_counted`` finds the same sets.
    """
    rows = labelled.count()
    support = min(1.0, max(support, MIN_ROWS / max(1, rows)))
    least = ceil(support * rows)
    numbered = stored(labelled.select(F.monotonically_increasing_id().alias("row"), "tokens", "verdict"), "labelled_urls")
    items = numbered.select("row", F.explode(F.array_distinct("tokens")).alias("token"))
    common = items.groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("token")
    kept = items.join(common, "token").groupBy("row").agg(F.collect_list("token").alias("tokens"))
    baskets = stored(numbered.select("row", "verdict").join(kept, "row", "left").select(F.array_sort(F.coalesce("tokens", F.array().cast("array<string>"))).alias("tokens"), "verdict"), "frequent_items")
    if (baskets.agg(F.max(F.size("tokens"))).first()[0] or 0) > widest:
        sets = stored(_counted(baskets, least, longest), "frequent_sets")
    else:
        sets = stored(_grown(baskets, support).filter(F.size("tokens") <= longest), "frequent_sets")
    plain = sets.filter(F.col("verdict").isNull()).select("tokens", F.col("freq").alias("total"))
    priors = labelled.groupBy("verdict").agg(F.count("*").alias("own")).withColumn("all", F.sum("own").over(_whole()))
    rules = sets.filter(F.col("verdict").isNotNull() & (F.size("tokens") > 0)).join(plain, "tokens").join(priors, "verdict").select(
        "tokens", "verdict", F.col("freq").alias("support"), (F.col("freq") / F.col("total")).alias("confidence"), (F.col("own") / F.col("all")).alias("prior"))
    rules = rules.filter((F.col("confidence") >= confidence) & (F.col("confidence") >= F.least(F.lit(1.0), lift * F.col("prior"))))
    smaller = rules.select("verdict", F.col("tokens").alias("less"), F.col("confidence").alias("less_confidence"))
    parts = rules.filter(F.size("tokens") > 1).withColumn("less", F.explode(F.transform("tokens", lambda x: F.array_remove("tokens", x))))
    needless = parts.join(smaller, ["verdict", "less"]).filter(F.col("less_confidence") >= F.col("confidence") - 1e-9).select("verdict", "tokens").distinct()
    return stored(rules.join(needless, ["verdict", "tokens"], "left_anti").select("tokens", "verdict", "support", "confidence"), "url_rules")


def _grown(baskets: DataFrame, support: float) -> DataFrame:
    """``tokens``, ``verdict`` (null for any) and ``freq`` of the sets that FP-growth finds."""
    item = F.concat(F.lit("is:"), F.col("verdict"))
    sets = FPGrowth(itemsCol="items", minSupport=support, minConfidence=1.0).fit(baskets.select(F.array_append("tokens", item).alias("items"))).freqItemsets
    verdicts = F.filter("items", lambda x: x.startswith("is:"))
    return sets.select(F.array_sort(F.filter("items", lambda x: ~x.startswith("is:"))).alias("tokens"), F.substring(F.get(verdicts, F.lit(0)), 4, 1000).alias("verdict"), "freq")


def _whole():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1))


def judge(pages: DataFrame, id: str = "page_id", url: str = "url", rules: tuple[SiteRule, ...] = SITE_RULES, default: str = "allow", **mining) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``mined`` (tokens of the mined rule used) and ``confidence``.

    A row per page, repeated rows and null ids included. Where several mined
    rules hold, the most confident decides, then the most supported, then the
    first in the order of tokens and verdict; where none holds, ``default``.
    Null, empty and malformed URLs have empty host and path, fit no rule and
    get the default. An empty table gives an empty result.
    """
    u = col_of(pages, url)
    host, path = host_of(u), path_of(u)
    cut = pages.select(col_of(pages, id).alias("page_id"), host.alias("host"), path.alias("path"), tokens(host, path, u).alias("tokens"))
    name, verdict = site_rule(F.col("host"), F.col("path"), rules)
    known = cut.withColumn("rule", name).withColumn("verdict", verdict)
    mined = mine(known.filter(F.col("rule").isNotNull() & (F.size("tokens") > 0)).select("tokens", "verdict"), **mining)
    # Distinct token sets of the open URLs; hosts with many like pages cost one row.
    open_sets = known.filter(F.col("rule").isNull()).select(F.array_sort("tokens").alias("tokens")).distinct()
    listed = _indexed(mined)
    best = F.max(F.struct(F.col("confidence"), F.col("support"), F.col("rule_tokens"), F.col("rule_verdict"))).alias("best")
    matched = open_sets.withColumn("token", F.explode("tokens")).join(listed, "token").filter(
        F.size(F.array_except("rule_tokens", "tokens")) == 0).groupBy("tokens").agg(best)
    result = known.withColumn("tokens", F.array_sort("tokens")).join(matched, "tokens", "left")
    decided = F.coalesce("verdict", "best.rule_verdict", F.lit(default))
    mine_only = lambda c: F.when(F.col("rule").isNull(), F.col(c))
    return result.select("page_id", "host", "path", "rule", decided.alias("verdict"), mine_only("best.rule_tokens").alias("mined"), mine_only("best.confidence").alias("confidence"))


def _indexed(mined: DataFrame) -> DataFrame:
    """The inverted index: every rule under its token of fewest rules."""
    per_token = mined.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    under = mined.withColumn("token", F.explode("tokens")).join(per_token, "token").groupBy("tokens", "verdict").agg(
        F.min(F.struct("n", "token"))["token"].alias("token"), F.max("support").alias("support"), F.max("confidence").alias("confidence"))
    return under.select("token", F.col("tokens").alias("rule_tokens"), F.col("verdict").alias("rule_verdict"), "support", "confidence")
