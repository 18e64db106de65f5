"""URL filtering by a list of rules and, where no rule fits, by association rules mined with FP-growth; native to Spark SQL.

The listed rules are (host, path) pairs: a rule fits its host and all subdomains if the url's path starts with the rule's path, and
the longest rule that fits wins. They are literals of the plan, a fixed handful, and are tested without a join.

For every other url the verdict comes from mined rules. Labelled pages (``labels`` joined on page_id = doc_id; a page is unwanted if
its label says low quality or toxic) become transactions of the url's tokens plus the item ``!bad`` where unwanted. Spark's FP-growth
finds frequent token combinations, and association rules that end in ``!bad`` are kept if confidence, support and lift reach the
given values and chance doesn't explain them: an antecedent of n labelled pages, of which a share c is unwanted against a share p of
all, has a chance of at most e^(-n KL(c, p)) (Chernoff's bound), and over all the itemsets that were looked at ``risk`` such rules
may be expected. Without that test a single labelled page would make rules of all its tokens. The whole url is tokenised: all host labels, path segments, query keys and values, by place, and the words inside them
at any place. What is left out before mining can't change a verdict or its confidence: tokens that are in fewer unwanted pages than
the support asks for are in no rule; a token in all pages adds nothing to a rule (where a lift over 1 is asked for); and tokens that are
in just the same labelled pages stand for each other, so they are mined as one item, which a url has if it has any of them (the sets of
pages are compared by 128-bit hashes). The number of itemsets isn't bounded otherwise; it is that of the combinations with the support.

The rules are matched through an inverted index: each rule is filed under one token of its antecedent, the rarest; a url's distinct
tokens meet the index in a join, and the rest of the antecedent is then tested on the url's token array. The index is broadcast only
while it has fewer than ``broadcast_rules`` rows; beyond that it is a shuffled join, which adaptive execution splits where a token is hot.

Defined cases: a url that is null or has no ``://`` has empty host and path, no tokens and is allowed by default; null page ids
are returned as they are; without labels, or if nothing is unwanted, no rule is mined and the default is ``allow``; repeated rows
are each judged; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import UPPER, written

#: Verdict, host, path. The longest that fits wins.
LISTED = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
BAD = "!bad"
#: The table of items is broadcast below this number of rows.
BROADCAST_ITEMS = 100_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    pattern = r"(?s)://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(url, pattern, 1), UPPER, UPPER.lower()), F.regexp_extract(url, pattern, 2)


def listed(host: Column, path: Column) -> tuple[Column, Column]:
    """The longest listed rule that fits, as ``host/path`` text, and its verdict; null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(LISTED, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        rule, verdict = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: scheme, labels of the host from the right, path segments, file ending, query keys and values, the words of all these and of the fragment, depth, digits."""
    labels = F.reverse(F.split(host, r"\."))
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    fragment = F.regexp_extract(url, r"(?s)#(.*)", 1)
    pairs = F.filter(F.split(query, "[&;]"), lambda s: s != "")
    placed = lambda kind, array: F.transform(array, lambda s, i: F.concat(F.lit(kind), i.cast("string"), F.lit("="), s))
    words = F.filter(F.split(F.lower(F.concat_ws("/", host, path, query, fragment)), r"[^\p{L}\p{N}]+"), lambda s: s != "")
    found = [
        F.array(F.concat(F.lit("scheme="), F.substring_index(url, "://", 1))),
        placed("host", labels),
        placed("path", segments),
        F.array(F.concat(F.lit("ends="), F.nullif(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1), F.lit("")))),
        F.transform(pairs, lambda s: F.concat(F.lit("query="), F.substring_index(s, "=", 1))),
        F.transform(F.filter(pairs, lambda s: F.contains(s, F.lit("="))), lambda s: F.concat(F.lit("value="), s)),
        F.transform(words, lambda s: F.concat(F.lit("word="), s)),
        F.array(F.when(F.contains(url, F.lit("#")), F.lit("fragment"))),
        F.array(F.concat(F.lit("depth="), F.size(segments).cast("string"))),
        F.array(F.when(host.rlike("[0-9]"), F.lit("digits"))),
    ]
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.array_compact(F.concat(*found))))


def with_tokens(pages: DataFrame) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = listed(F.col("host"), F.col("path"))
    return rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("listed"), tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))


def alike(basket: DataFrame, least: int, universal: bool) -> DataFrame:
    """token, item: the tokens in ``least`` unwanted pages or more; tokens of the same pages have one item. Without those of all pages unless ``universal``."""
    seen = basket.select("row", "bad", F.explode("tokens").alias("token")).groupBy("token")
    counted = seen.agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("n_bad"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "row")).alias("y"))
    counted = written(counted.where(F.col("n_bad") >= least), "tokens")
    if not universal:
        counted = counted.where(F.col("n") < basket.count())
    return written(counted.select("token", F.min("token").over(Window.partitionBy("n", "x", "y")).alias("item")), "items")


def items_of(rows: DataFrame, items: DataFrame) -> DataFrame:
    """row, items (sorted): of the rows that have any."""
    small = items.limit(BROADCAST_ITEMS).count() < BROADCAST_ITEMS
    met = rows.select("row", F.explode("tokens").alias("token")).join(F.broadcast(items) if small else items, "token")
    return met.groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))


def mine(judged: DataFrame, labels: DataFrame, min_support: float = 0.002, min_confidence: float = 0.5, min_lift: float = 1.5, min_pages: int = 4, risk: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """antecedent, confidence: the association rules antecedent => unwanted that are worth keeping; and token, item: what the antecedents' items stand for."""
    marks = labels.where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)").groupBy(F.col("doc_id").alias("page_id"))
    marks = marks.agg(F.max((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("bad"))
    basket = written(judged.where(F.size("tokens") > 0).join(marks, "page_id").select("row", "bad", "tokens"), "baskets")
    total, unwanted = basket.agg(F.count(F.lit(1)), F.count_if("bad")).first()
    min_support = min(1.0, max(min_support, min_pages / max(1, total)))
    items = alike(basket, max(1, ceil(min_support * total)), min_lift <= 1)
    found = F.coalesce("items", F.array().cast("array<string>"))
    itemsets = basket.select("row", "bad").join(items_of(basket, items), "row", "left").select(F.when(F.col("bad"), F.array_append(found, F.lit(BAD))).otherwise(found).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(written(itemsets, "itemsets"))
    rules = model.associationRules.where((F.size("consequent") == 1) & (F.get("consequent", F.lit(0)) == BAD) & (F.col("lift") >= min_lift))
    share, c = unwanted / max(1, total), F.col("confidence")
    if not 0 < share < 1:
        return rules.select("antecedent", "confidence").limit(0), items
    tests = model.freqItemsets.count()
    gain = c * F.ln(c / share) + F.when(c < 1, (1 - c) * F.ln((1 - c) / (1 - share))).otherwise(0.0)
    proven = rules.where(F.col("support") * total / c * gain >= log(max(1, tests) / risk))
    return written(proven.select("antecedent", "confidence"), "rules"), items


def matched(judged: DataFrame, rules: DataFrame, broadcast_rules: int = 100_000) -> DataFrame:
    """page rows with the highest confidence of a mined rule that fits them; rows that none fits are absent."""
    rarity = judged.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    filed = rules.withColumn("rule_id", F.monotonically_increasing_id()).select("*", F.explode("antecedent").alias("token")).join(rarity, "token", "left")
    index = filed.groupBy("rule_id").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), F.col("token"))).alias("token"), F.first("antecedent").alias("antecedent"), F.first("confidence").alias("confidence"))
    index = written(index.drop("rule_id"), "rule-index")
    if index.limit(broadcast_rules).count() < broadcast_rules:
        index = F.broadcast(index)
    met = judged.select("page_key", "tokens", F.explode("tokens").alias("token")).join(index, "token").where(F.size(F.array_except("antecedent", "tokens")) == 0)
    return met.groupBy("page_key").agg(F.max("confidence").alias("confidence"))


def url_filter(pages: DataFrame, labels: DataFrame, **mining: float) -> DataFrame:
    """page_id, host, path, rule, verdict, confidence (of the mined rule, else null); one row per row of ``pages``."""
    judged = written(with_tokens(pages).withColumn("row", F.monotonically_increasing_id()), "urls")
    found, items = mine(judged, labels, **mining)
    if found.isEmpty():
        return judged.select("page_id", "host", "path", "rule", F.coalesce("listed", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("confidence"))
    # equal item arrays have equal verdicts: matched once for each distinct array
    keyed = written(items_of(judged.where("listed IS NULL"), items).withColumnRenamed("items", "page_key"), "page-items")
    hits = keyed.join(matched(keyed.select("page_key", F.col("page_key").alias("tokens")).distinct(), found), "page_key").select("row", "confidence")
    mined = F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return judged.join(hits, "row", "left").select("page_id", "host", "path", "rule", F.coalesce("listed", mined).alias("verdict"), "confidence")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
