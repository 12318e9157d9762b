"""URL filter by association rules: FP-growth mines token combinations that go with a label; fixed host and path rules come first."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules as (verdict, host with path prefix).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


@dataclass(frozen=True)
class Mining:
    """min_support is a share of the labelled urls, so the rules do not multiply with the data."""

    min_support: float = 0.01
    min_confidence: float = 0.9
    max_tokens: int = 3
    broadcast_rules: int = 20_000


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(host: Column, path: Column, rule: str) -> Column:
    at, slash, rest = rule.partition("/")
    return ((host == at) | host.endswith("." + at)) & path.startswith(slash + rest)


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for says, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        fits = _fits(host, path, r)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def url_tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens: h: labels of the host and their parts, p: parts of the path with numbers made alike, q: names of parameters."""
    labels = F.split(host, r"\.")
    parts = F.flatten(F.transform(labels, lambda x: F.split(x, "-")))
    steps = F.transform(F.split(path, "/"), lambda x: F.regexp_replace(x, "[0-9]+", "0"))
    params = F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)="), F.lit(1))
    tag = lambda kind, c: F.transform(F.filter(c, lambda x: F.length(x) > 0), lambda x: F.concat(F.lit(kind), x))
    return F.array_distinct(F.concat(tag("h:", labels), tag("h:", parts), tag("p:", steps), tag("q:", params)))


def _items(labelled: DataFrame, least: int) -> DataFrame:
    """(token, n, pure: its label where it has one only, item) of the tokens in at least `least` rows. Tokens that are in the same rows are one item, named by the first of them."""
    row = F.xxhash64("tokens", "label").cast("decimal(38,0)")
    each = labelled.select(F.explode("tokens").alias("token"), "label", row.alias("h")).groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("h"), F.min("label").alias("lo"), F.max("label").alias("hi")).where(F.col("n") >= least)
    first = each.groupBy("n", "h").agg(F.min("token").alias("item"))
    return each.join(first, ["n", "h"]).select("token", "n", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("pure"), "item")


def mine_rules(labelled: DataFrame, params: Mining = Mining()) -> DataFrame:
    """labelled: tokens array<string>, label string. Returns rules (rule_id, tokens, anchor, label, confidence, support).

    Tokens that are in exactly the same labelled rows are one item, named by the first of them. A rule whose tokens
    contain those of another rule with the same label and no lower confidence is pruned. What such a rule is certain to
    prune is not mined at all: sets with an item that has one label only (a rule by itself), or one that is in every
    row; so parts that long urls share don't multiply. The anchor is the rule's rarest token; the inverted index is keyed
    by it. No rules if no row has a label.
    """
    rows = labelled.where("label is not null and tokens is not null").select(F.array_distinct("tokens").alias("tokens"), "label")
    total = rows.count()
    items = checkpointed(_items(rows, max(1, math.ceil(params.min_support * total))))
    own = items.where("token = item")
    alone = own.where("pure is not null").select(F.array("item").alias("tokens"), F.col("pure").alias("label"), F.lit(1.0).alias("confidence"), (F.col("n") / max(1, total)).alias("support"))
    mined = [r.item for r in own.where(F.col("pure").isNull() & (F.col("n") < total)).select("item").collect()]  # each in min_support of the rows, so at most (tokens of a row) / min_support of them
    keep = F.array_intersect("tokens", F.array(*[F.lit(x) for x in mined]).cast("array<string>"))
    sets = checkpointed(rows.withColumn("keep", keep).where(F.size("keep") > 0).select(F.array_append("keep", F.concat(F.lit("label="), "label")).alias("items")))
    support = params.min_support * total / max(1, sets.count())
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, support), minConfidence=params.min_confidence).fit(sets)
    found = model.associationRules.where(F.col("consequent")[0].startswith("label=") & (F.size("antecedent") <= params.max_tokens)).where(~F.exists("antecedent", lambda x: x.startswith("label=")))
    found = found.select(F.array_sort("antecedent").alias("tokens"), F.substring(F.col("consequent")[0], 7, 1_000_000).alias("label"), "confidence", (F.col("support") * F.lit(sets.count() / max(1, total))).alias("support"))
    rules = checkpointed(alone.unionByName(found))
    inside = F.transform(F.sequence(F.lit(1), F.pow(F.lit(2), F.size("tokens")).cast("int") - 2), lambda m: F.filter("tokens", lambda x, i: F.floor(m / F.pow(F.lit(2), i)) % 2 == 1))
    narrower = rules.select("tokens", "label", F.col("confidence").alias("c"), F.explode(F.when(F.size("tokens") > 1, inside)).alias("part"))
    wide = narrower.join(rules.select(F.col("tokens").alias("part"), "label", "confidence"), ["part", "label"]).where("confidence >= c").select("tokens", "label").distinct()
    rules = rules.join(wide, ["tokens", "label"], "left_anti")
    anchors = rules.select("tokens", "label", F.explode("tokens").alias("token")).join(own.select("token", "n"), "token").groupBy("tokens", "label").agg(F.min(F.struct("n", "token"))["token"].alias("anchor"))
    return rules.join(anchors, ["tokens", "label"]).withColumn("rule_id", F.concat_ws("&", "tokens"))


def match_rules(urls: DataFrame, rules: DataFrame, params: Mining = Mining()) -> DataFrame:
    """urls: url, tokens (distinct urls). Returns url, mined (the label of the best rule), by_rule. Rules meet urls on the anchor token only."""
    if rules.count() <= params.broadcast_rules:
        rules = F.broadcast(rules)
    hit = urls.select("url", "tokens", F.explode("tokens").alias("anchor")).join(rules.select("anchor", F.col("tokens").alias("need"), "label", "confidence", "rule_id"), "anchor")
    hit = hit.where(F.size(F.array_except("need", "tokens")) == 0)
    best = F.min(F.struct((-F.col("confidence")).alias("c"), "rule_id", "label"))
    return hit.groupBy("url").agg(best.alias("b")).select("url", F.col("b.label").alias("mined"), F.col("b.rule_id").alias("by_rule"))


def judge_urls(pages: DataFrame, rules=RULES, params: Mining = Mining(), page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, by_rule.

    Fixed rules decide where one fits and label those urls; FP-growth mines label rules from them, which decide the
    rest; allow where none fits. Null urls and urls without :// have empty host and path and are allowed. Repeated rows
    and urls are judged alike; an empty table gives an empty result; other columns are ignored.
    """
    u = F.col("url")
    base = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")).withColumns({"host": url_host(u), "path": url_path(u)})
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": rule, "fixed": verdict})
    distinct = base.groupBy("url", "host", "path", "fixed").agg(F.count(F.lit(1)).alias("n")).withColumn("tokens", url_tokens(F.col("host"), F.col("path"), u))
    mined = mine_rules(distinct.select("tokens", F.col("fixed").alias("label")), params)
    open_urls = distinct.where("fixed is null and url is not null and host <> ''").select("url", "tokens")
    blocked = match_rules(open_urls, mined, params).where("mined = 'block'").select("url", "by_rule")
    return base.join(blocked, "url", "left").select("page_id", "host", "path", "rule", F.coalesce("fixed", F.when(F.col("by_rule").isNotNull(), "block"), F.lit("allow")).alias("verdict"), "by_rule")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))
