"""Filtering of URLs by mined association rules, below explicit rules for hosts and paths.

Labelled URLs are sets of tokens (scheme, host labels, path segments, query keys) plus whether the
page is bad; FP-growth mines the combinations that are frequent, and those that imply "bad" with
enough confidence become rules. A rule is filed under its rarest token; a URL looks up the rules of
each of its tokens and fits those whose tokens it has all.

Everything is DataFrame work or Spark ML in the JVM.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voicelane.llm import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BAD = "label:bad"
#: A rule holds for at least this share of the labelled URLs and this number of them, and is right
#: about at least this share of the URLs with its tokens.
SUPPORT, SUPPORT_COUNT, CONFIDENCE = 0.002, 10, 0.7


def rest(url: Column) -> Column:
    """What follows the first ``://``; empty for null and where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(rest(url), r"^[^/?#]*([^?#]*)", 1)


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL; an unusable URL has none."""
    scheme = F.translate(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1), UPPER, LOWER)
    query = F.regexp_extract(rest(url), r"^[^?#]*\?([^#]*)", 1)

    def tagged(values: Column, tag: str) -> Column:
        return F.transform(F.filter(values, lambda v: v != ""), lambda v: F.concat(F.lit(tag), v))

    keys = F.transform(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1))
    every = F.concat(
        tagged(F.array(scheme), "scheme:"),
        tagged(F.split(host(url), r"\."), "host:"),
        tagged(F.split(path(url), "/"), "path:"),
        tagged(keys, "key:"),
    )
    return F.array_distinct(F.coalesce(every, F.array().cast("array<string>")))


def mined(
    labelled: DataFrame, support: float = SUPPORT, count: int = SUPPORT_COUNT, confidence: float = CONFIDENCE
) -> DataFrame:
    """Rules from ``labelled`` (``tokens``, ``bad`` boolean): ``antecedent``, ``confidence``,
    ``support``, and ``filed``, the token of the antecedent that is rarest among the rules.

    ``labelled`` is read more than once. Rows without label teach nothing. The number of frequent
    combinations depends on the support, not on the number of rows.
    """
    spark = labelled.sparkSession
    known = labelled.filter("bad IS NOT NULL")
    total = known.count()
    empty = "antecedent array<string>, confidence double, support double, filed string"
    if total < count:
        return spark.createDataFrame([], empty)
    items = known.select(
        F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens")).alias("items")
    )
    model = FPGrowth(itemsCol="items", minSupport=max(support, count / total), minConfidence=confidence).fit(items)
    rules = model.associationRules.filter(F.col("consequent")[0] == BAD)
    rules = common.written(rules.select("antecedent", "confidence", "support"), "rules")
    each = rules.select(F.explode("antecedent").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    rarest = rules.select("*", F.explode("antecedent").alias("token")).join(each, "token")
    rarest = rarest.groupBy("antecedent", "confidence", "support").agg(
        F.min(F.struct("n", "token")).getField("token").alias("filed")
    )
    return common.written(rarest, "rules")


def fitting(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of ``urls`` (``row``, ``tokens``) that a rule fits: ``row``, ``confidence`` of the best rule
    and ``rules``, how many fit."""
    asked = urls.select("row", "tokens", F.explode("tokens").alias("filed"))
    found = asked.join(rules, "filed").filter(F.size(F.array_except("antecedent", "tokens")) == 0)
    return found.groupBy("row").agg(F.max("confidence").alias("confidence"), F.count("*").alias("rules"))


def explicit(host_: Column, path_: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Verdict and rule (host and path) of the longest of the explicit rules that fit, or null."""
    verdict = rule = F.lit(None).cast("string")
    # From short to long, so the longest is asked first.
    for kind, own_host, own_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1], r[2])):
        fits = ((host_ == own_host) | host_.endswith("." + own_host)) & path_.startswith(own_path)
        verdict = F.when(fits, kind).otherwise(verdict)
        rule = F.when(fits, own_host + own_path).otherwise(rule)
    return verdict, rule


def judged(
    pages: DataFrame,
    labels: DataFrame,
    rules: list[tuple[str, str, str]],
    page_id: str = "page_id",
    url: str = "url",
    support: float = SUPPORT,
    count: int = SUPPORT_COUNT,
    confidence: float = CONFIDENCE,
) -> DataFrame:
    """One row per page: ``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``rules_fitting``.

    ``labels``: ``id`` of a page and ``bad``; pages without label only get verdicts. A page that no
    explicit rule fits is blocked if a mined rule fits it. Null or unusable URLs have an empty host
    and path, no tokens, and are allowed.
    """
    address = F.col(f"`{url}`")
    known = pages.select(
        F.col(f"`{page_id}`").alias("page_id"),
        host(address).alias("host"),
        path(address).alias("path"),
        tokens(address).alias("tokens"),
    )
    known = common.written(known.withColumn("row", F.monotonically_increasing_id()), "urls")
    seen = labels.groupBy(F.col("id").alias("page_id")).agg(F.max("bad").alias("bad"))
    taught = common.written(known.join(seen, "page_id").select("tokens", "bad"), "labelled-urls")
    found = fitting(known, mined(taught, support, count, confidence))
    verdict, rule = explicit(F.col("host"), F.col("path"), rules)
    fits = F.coalesce("rules", F.lit(0))
    return known.join(found, "row", "left").select(
        "page_id",
        F.coalesce("host", F.lit("")).alias("host"),
        F.coalesce("path", F.lit("")).alias("path"),
        rule.alias("rule"),
        F.coalesce(verdict, F.when(fits > 0, "block").otherwise("allow")).alias("verdict"),
        fits.alias("rules_fitting"),
    )
