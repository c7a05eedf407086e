"""URL filters by association rules.

URLs are sets of tokens (scheme, host and its suffixes, path words, query keys, extension). Spark's
FP-growth mines the token sets that occur with the unwanted label; rules ``tokens -> block`` are pruned by
confidence and support, and a rule goes when a rule of a part of its tokens is at least as confident.
An inverted index from token to rule then finds the rules of which a URL has all tokens.

Hand-made base rules (host and path prefix, longest wins) decide first. A null url, or one without
``://``, has empty host and path and no tokens: no rule matches it and it is allowed. Repeated rows get
the same verdict; an empty table, or labels without a single unwanted url, give no rules.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeqc.llm.common import column, inputs, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
UNWANTED = "label:block"

#: Verdict, host and path of the base rules.
BASE_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


@dataclass(frozen=True)
class MiningRules:
    """Shares are of all labelled urls; a rule has at most ``max_tokens`` tokens and ``min_count`` unwanted urls behind it."""

    min_support: float = 0.002
    min_count: int = 20
    min_confidence: float = 0.6
    max_tokens: int = 4


def host_and_path(url: Column) -> tuple[Column, Column]:
    start = F.locate("://", url)
    rest = F.when(start > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def split_urls(urls: DataFrame) -> DataFrame:
    """``url`` with host, path and its distinct tokens."""
    host, path = host_and_path(F.col("url"))
    parts = urls.withColumn("host", host).withColumn("path", path)
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    words = F.transform(F.filter(F.split("path", "[^A-Za-z0-9]+"), lambda w: w != ""), lambda w: F.concat(F.lit("path:"), F.when(w.rlike("^[0-9]+$"), "#").otherwise(F.lower(w))))
    query = F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda w: w != ""), lambda w: F.concat(F.lit("key:"), F.substring_index(w, "=", 1)))
    scheme = F.array(F.concat(F.lit("scheme:"), F.substring_index("url", "://", 1)))
    known = F.col("host") != ""
    tokens = F.when(known, F.array_distinct(F.concat(scheme, suffixes, words, keys))).otherwise(F.array().cast("array<string>"))
    return parts.withColumn("tokens", tokens)


def base_verdict(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = BASE_RULES) -> Column:
    """The longest base rule that fits, as a struct of rule and verdict, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, of, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(prefix)
        found = F.when(fits, F.struct(F.lit(of + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def mine_rules(labelled: DataFrame, mining: MiningRules = MiningRules(), url_col: str = "url", block_col: str = "block") -> DataFrame:
    """``rule, tokens, confidence, support`` from urls with a boolean label; rows without a label take no part."""
    rows = split_urls(inputs(labelled, url=url_col, block=block_col).where("block is not null")).where(F.size("tokens") > 0)
    baskets = written(rows.select(F.when(F.col("block"), F.array_append("tokens", F.lit(UNWANTED))).otherwise(F.col("tokens")).alias("items")))
    support = max(mining.min_support, mining.min_count / max(baskets.count(), 1))
    if support > 1:
        return baskets.sparkSession.createDataFrame([], "rule string, tokens array<string>, confidence double, support double")
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=mining.min_confidence).fit(baskets)
    found = model.associationRules.where((F.col("consequent")[0] == UNWANTED) & (F.size("antecedent") <= mining.max_tokens))
    found = written(found.select(F.array_join(F.array_sort("antecedent"), "\n").alias("rule"), F.col("antecedent").alias("tokens"), "confidence", "support"))
    items = found.select("rule", "confidence", F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
    part = items.select(F.col("rule").alias("part"), F.col("confidence").alias("part_confidence"), F.col("size").alias("part_size"), "token")
    covered = (
        items.join(part, "token").where("part_size < size and part_confidence >= confidence").groupBy("rule", "part", "part_size").count().where("count = part_size").select("rule").distinct()
    )
    return written(found.join(covered, "rule", "left_anti"))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", base: Sequence[tuple[str, str, str]] = BASE_RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, mined_rules, mined_confidence`` for each row."""
    rows = inputs(pages, page_id=id_col, url=url_col)
    index = rules.select(F.explode("tokens").alias("token"), F.col("rule").alias("mined"), F.size("tokens").alias("size"), "confidence")
    urls = split_urls(rows.select("url").where("url is not null").distinct())
    hits = urls.select("url", F.explode("tokens").alias("token")).join(index, "token").groupBy("url", "mined", "size", "confidence").count().where("count = size")
    best = hits.groupBy("url").agg(F.count("*").alias("mined_rules"), F.max("confidence").alias("mined_confidence"))
    host, path = host_and_path(F.col("url"))
    out = rows.join(best, "url", "left").withColumn("host", host).withColumn("path", path)
    out = out.withColumn("base", base_verdict(F.col("host"), F.col("path"), base))
    mined = F.when(F.col("mined_rules").isNotNull(), "block").otherwise("allow")
    return out.select(
        "page_id", "host", "path", F.col("base.rule").alias("rule"), F.coalesce("base.verdict", mined).alias("verdict"), F.coalesce("mined_rules", F.lit(0)).alias("mined_rules"), "mined_confidence"
    )


def number_in_path(url: Column) -> Column:
    """The first number that is a whole word of the path, which names the document of a page."""
    return F.regexp_extract(host_and_path(url)[1], r"/([0-9]{1,18})(?![0-9])", 1).try_cast("bigint")


def label_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``url, block``: a page is unwanted when its document is of low quality or toxic."""
    numbered = pages.select(column("url"), number_in_path(F.col("url")).alias("doc_id"))
    worst = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("block"))
    return numbered.join(worst, "doc_id").select("url", "block")
