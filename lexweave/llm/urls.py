"""URL filters: fixed host rules first, then association rules that FP-growth mines from labelled URLs.

The labelled URLs are the pages that ``labels`` marks: quality 0 or toxic 1 is block, else allow. Their tokens (host
labels' parts, path segments, query keys) and the label form the transactions. Tokens that the same transactions hold are mined as one
class, so that what a site's URLs share costs nothing; of the sets that FP-growth finds, those that a smaller one inside occurs as often
as are left out. Rules ``classes -> label`` are pruned by support, confidence and lift, and found by an inverted index: each rule
lies under its rarest class only, so a frequent one (a host with a third of all pages) meets few rules; the other classes are verified
in the row. The most confident rule that fits decides (then support, then block, then the shorter rule, then its text); without one the page
is allowed.

Labels name what they mark by doc_id; that a page's page_id is such a doc_id is this operator's convention.

Defined cases: a null url, or one without ``://``, has an empty host and path and, without a query, no token, so it is
allowed unless a rule says otherwise; a very long url has a token for each of its different parts; no labels give no mined rule;
of several labels of an id one that blocks decides; repeated rows and null page_ids stay and count each; rules of one
confidence and support that differ in verdict block; an empty table gives no row; further columns of any name don't matter.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.6
MIN_LIFT = 1.2
#: Fixed values of the contract: (host, path, verdict).
HOST_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def host_of(url: Column) -> Column:
    after = F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    host = F.regexp_extract(F.coalesce(after, F.lit("")), r"(?s)^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    after = F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    return F.regexp_extract(F.coalesce(after, F.lit("")), r"(?s)^[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column) -> Column:
    """The longest rule (struct of rule and verdict) whose host is the url's or a parent of it and whose path begins the url's."""
    ordered = sorted(HOST_RULES, key=lambda r: (-len(r[0] + r[1]), r))
    choice = None
    for h, p, verdict in ordered:
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        choice = F.when(fits, found) if choice is None else choice.when(fits, found)
    return choice


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: ``h:`` parts of host labels, ``p:`` path segments (digits as 0), ``q:`` query keys."""
    labels = F.filter(F.split(host, r"[.\-]"), lambda x: x != "")
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    keys = F.filter(F.split(F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1), "&"), lambda x: x != "")
    return F.array_distinct(F.concat(
        F.transform(labels, lambda x: F.concat(F.lit("h:"), x)), F.transform(segments, lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, r"\d+", "0"))),
        F.transform(keys, lambda x: F.concat(F.lit("q:"), F.regexp_extract(x, r"^([^=]*)", 1))),
    ))


def judged(pages: DataFrame) -> DataFrame:
    url = F.col("url")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), url, host_of(url).alias("host"), path_of(url).alias("path"))
    return rows.withColumn("fixed", fixed_rule(F.col("host"), F.col("path"))).withColumn("tokens", tokens_of(url, F.col("host"), F.col("path")))


#: Names a row, since page_ids can be null or repeated.
ROW = "_url_row"


def mine(pages: DataFrame, labels: DataFrame, **pruning: float) -> DataFrame:
    """Rules (antecedent: names of classes, verdict, confidence, support) from the URLs that labels cover."""
    return _mine(judged(pages).withColumn(ROW, F.monotonically_increasing_id()), labels, **pruning)[0]


def _classes(baskets: DataFrame, least: Column) -> DataFrame:
    """(token, class): the tokens that ``least`` baskets or more hold; those that the same baskets hold are one class, named by its
    smallest token. Sets of baskets are told apart by their number and 128 bits of hashes of their rows."""
    held = baskets.select(ROW, F.explode("tokens").alias("token")).groupBy("token")
    counted = held.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(ROW)).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), ROW)).alias("b")).where(F.col("n") >= least)
    return counted.select("token", F.min("token").over(Window.partitionBy("n", "a", "b")).alias("class"))


def _generators(sets: DataFrame, n: int) -> DataFrame:
    """Of (items, freq) the sets that no smaller one inside them occurs as often as: each is compared with those of one item less."""
    sized = sets.select(F.array_sort("items").alias("items"), "freq")
    inner = sized.select("items", "freq", F.explode("items").alias("x")).select("items", "freq", F.array_except("items", F.array("x")).alias("part"))
    known = sized.select(F.col("items").alias("part"), F.col("freq").alias("often")).unionAll(sets.sparkSession.createDataFrame([([], n)], "part array<string>, often bigint"))
    return inner.join(known, "part").groupBy("items").agg(F.min(F.col("often") > F.col("freq")).alias("tells")).where("tells").select(F.col("items").alias("antecedent"))


def _mine(rows: DataFrame, labels: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT) -> tuple[DataFrame, DataFrame]:
    """The rules, and the classes of tokens that they are made of. Only the shortest antecedents of each set of baskets are kept: a page
    that a longer one fits is fitted by those, as surely."""
    label = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("page_id"))
    label = label.agg(F.max(F.when((F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1), 1).otherwise(0)).alias("bad"))
    baskets = materialise(rows.join(label, "page_id").select(ROW, "tokens", F.when(F.col("bad") == 1, "=block").otherwise("=allow").alias("mark")), "url-marked")
    n = baskets.count()
    classes = materialise(_classes(baskets, F.lit(math.ceil(min_support * n))), "url-classes")
    held = baskets.select(ROW, F.explode("tokens").alias("token")).join(classes, "token").groupBy(ROW).agg(F.collect_set("class").alias("classes"))
    items = baskets.join(held, ROW, "left").select(F.concat(F.coalesce("classes", F.array().cast("array<string>")), F.array("mark")).alias("items"))
    # mining counts and scans the baskets several times
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(materialise(items, "url-baskets"))
    unmarked = lambda items: ~F.exists(items, lambda x: x.startswith("="))
    generators = _generators(materialise(model.freqItemsets.where(unmarked("items")), "url-sets"), n)
    rules = model.associationRules.where(F.element_at("consequent", 1).startswith("=") & (F.col("lift") >= min_lift) & unmarked("antecedent"))
    rules = rules.select(F.array_sort("antecedent").alias("antecedent"), F.substring(F.element_at("consequent", 1), 2, 9).alias("verdict"), "confidence", "support")
    return rules.join(generators, "antecedent", "left_semi"), classes


def _index(rules: DataFrame, pages: DataFrame) -> DataFrame:
    """The rules, each under its rarest class, a row per rule; pages are (row, class, token)."""
    frequency = pages.groupBy("class").count()
    spread = rules.withColumn("rule", F.concat_ws("\t", "antecedent")).select("*", F.explode("antecedent").alias("class")).join(frequency, "class", "left")
    return spread.groupBy("rule", "verdict").agg(
        F.min_by("class", F.struct(F.coalesce("count", F.lit(0)), "class")).alias("class"), F.first("antecedent").alias("antecedent"), F.max("confidence").alias("confidence"), F.max("support").alias("support")
    )


def filter_urls(pages: DataFrame, labels: DataFrame, **pruning: float) -> DataFrame:
    """A row per page: page_id, host, path, rule (of the fixed rules, else null), verdict, mined_rule (else null). The pages' urls
    are cut once, into a narrow table; index and hits are written, so that small ones are broadcast and no page is shuffled."""
    rows = materialise(judged(pages).drop("url").withColumn(ROW, F.monotonically_increasing_id()), "url-pages")
    rules, classes = _mine(rows, labels, **pruning)
    rules = materialise(rules, "url-rules")
    open_ = rows.where("fixed is null").select(ROW, F.explode("tokens").alias("token")).join(classes, "token")
    # a page has a class if it has one of its tokens; the smallest stands for it in the rule's text
    met = materialise(open_.groupBy(ROW, "class").agg(F.min("token").alias("token")), "url-met")
    index = materialise(_index(rules, met), "url-index")
    own = met.groupBy(ROW).agg(F.map_from_entries(F.collect_list(F.struct("class", "token"))).alias("own"))
    hit = met.select(ROW, "class").join(index, "class").drop("class").join(own, ROW)
    hit = hit.where(F.size(F.array_except("antecedent", F.map_keys("own"))) == 0)
    text = F.concat_ws("\t", F.array_sort(F.transform("antecedent", lambda c: F.element_at("own", c))))
    best = hit.groupBy(ROW).agg(F.min(F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), F.when(F.col("verdict") == "block", 0).otherwise(1).alias("a"), F.size("antecedent").alias("n"), text.alias("r"), F.col("verdict").alias("v"))).alias("best"))
    best = materialise(best, "url-best")
    return rows.join(best, ROW, "left").select(
        "page_id", "host", "path", F.col("fixed.rule").alias("rule"), F.coalesce("fixed.verdict", "best.v", F.lit("allow")).alias("verdict"),
        F.when(F.col("fixed").isNull(), F.translate(F.col("best.r"), "\t", " ")).alias("mined_rule"),
    )
