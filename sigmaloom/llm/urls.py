"""Operator 6, URL filters: association rules over URL tokens.

URLs that the rule list blocks carry the label; FP-growth over all URLs finds frequent token combinations with it. A
combination becomes a rule if ``min_confidence`` of all URLs that hold it are blocked (those that the list does not
cover are no evidence, so they count against it), if that is ``min_lift`` times the share of blocked URLs, and if it
names both a part of the host and a part of the path: a suffix of hosts or a folder alone never decides. A rule falls
away if a part of it is a rule already. Rules match through an inverted index on each rule's rarest token. The rule
list's own verdict comes first, the mined rules decide the rest; what none matches is allowed.

Defined results: a null url or one without ``://`` has empty host and path and no rule, and is allowed; repeated
rows are judged alike; an empty table gives no row; without blocked urls nothing is mined.

Mined rules number at most what the thresholds admit; their table is broadcast only below BROADCAST_RULES rows.
Matches join back on the url, whose copies adaptive skew splitting can part.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: (verdict, rule): host, then path. Fixed values of the contract.
RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.8
MIN_LIFT = 1.5
#: A rule holds a token of each of these kinds.
NEEDED = ("h:", "p:")
#: A combination needs so many urls in any case.
LEAST_URLS = 5
BROADCAST_RULES = 10_000
BLOCK = "label=block"


def with_parts(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url) with host (ASCII lower-cased) and path."""
    rest = F.expr("case when instr(url, '://') > 0 then substring(url, instr(url, '://') + 3) else '' end")
    host = F.regexp_extract("rest", r"^[^/?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    after = F.expr("substring(rest, length(regexp_extract(rest, '^[^/?#]*', 0)) + 1)")
    path = F.regexp_extract("after", r"^[^?#]*", 0)
    d = pages.select("page_id", "url").withColumn("rest", F.coalesce(rest, F.lit("")))
    return d.withColumn("host", lower).withColumn("after", after).withColumn("path", path).drop("rest", "after")


def listed_rule(rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest listed rule that fits host and path, else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        host, path = text.split("/", 1)
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(f"/{path}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def tokens() -> Column:
    """Distinct tokens of a url: labels of the host, alphabetic path parts, keys of the query, the extension."""
    host = F.transform(F.filter(F.split("host", r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    path = F.transform(F.regexp_extract_all("path", F.lit(r"/([A-Za-z_-]+)"), F.lit(1)), lambda x: F.concat(F.lit("p:"), x))
    query = F.transform(F.regexp_extract_all(F.coalesce("url", F.lit("")), F.lit(r"[?&]([A-Za-z_]+)="), F.lit(1)), lambda x: F.concat(F.lit("q:"), x))
    ext = F.transform(F.regexp_extract_all("path", F.lit(r"\.([a-z]{2,5})$"), F.lit(1)), lambda x: F.concat(F.lit("e:"), x))
    return F.array_distinct(F.concat(host, path, query, ext))


def holds(kind: str) -> Column:
    return F.exists("antecedent", lambda t: t.startswith(kind))


def mine_rules(urls: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT, needed: tuple[str, ...] = NEEDED) -> DataFrame:
    """(antecedent, confidence, support) from all (tokens, blocked): minimal token combinations that say block."""
    rows = urls.count()
    empty = urls.sparkSession.createDataFrame([], "antecedent array<string>, confidence double, support double")
    if not rows:
        return empty
    items = F.concat("tokens", F.when(F.col("blocked"), F.array(F.lit(BLOCK))).otherwise(F.array().cast("array<string>")))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, LEAST_URLS / rows)), minConfidence=min_confidence).fit(urls.select(items.alias("items")))
    found = model.associationRules.filter((F.element_at("consequent", 1) == BLOCK) & (F.col("lift") >= min_lift))
    for kind in needed:
        found = found.filter(holds(kind))
    found = written(found.select(F.sort_array("antecedent").alias("antecedent"), "confidence", "support"), "url-rules")
    # a part of a rule is met through one of its tokens, the one that the fewest rules hold
    held = found.select("antecedent", F.explode("antecedent").alias("t"))
    often = held.groupBy("t").agg(F.count("*").alias("n"))
    part = held.join(often, "t").groupBy(F.col("antecedent").alias("part")).agg(F.min(F.struct("n", "t"))["t"].alias("t"))
    nested = held.join(part, "t").filter((F.size("part") < F.size("antecedent")) & (F.size(F.array_except("part", "antecedent")) == 0))
    return found.join(nested.select("antecedent").distinct(), "antecedent", "left_anti")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, mined) for the distinct urls of (url, tokens) that hold all tokens of a rule; ``mined`` is the first such rule."""
    counts = urls.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    listed = rules.select("antecedent", F.explode("antecedent").alias("t")).join(counts, "t")
    index = listed.groupBy("antecedent").agg(F.min(F.struct("n", "t"))["t"].alias("t"))
    index = written(index, "url-index")
    small = F.broadcast if index.count() <= BROADCAST_RULES else (lambda x: x)
    hit = urls.select("url", "tokens", F.explode("tokens").alias("t")).join(small(index), "t").filter(F.size(F.array_except("antecedent", "tokens")) == 0)
    return hit.groupBy("url").agg(F.min(F.array_join("antecedent", " ")).alias("mined"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(page_id, host, path, rule, mined, verdict)."""
    rule, says = listed_rule(rules)
    parts = with_parts(pages).withColumns({"rule": rule, "says": says, "tokens": tokens()})
    mined = mine_rules(parts.filter("url is not null").select("tokens", F.coalesce(F.col("says") == "block", F.lit(False)).alias("blocked")), min_support, min_confidence)
    urls = parts.filter("rule is null and url is not null").select("url", "tokens")
    hit = match_rules(urls, mined).withColumnRenamed("url", "_url")
    out = parts.join(hit, F.col("rule").isNull() & (F.col("url") == F.col("_url")), "left")
    verdict = F.coalesce("says", F.when(F.col("mined").isNotNull(), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", "mined", verdict.alias("verdict"))
