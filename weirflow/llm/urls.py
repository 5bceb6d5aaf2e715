"""URL filters: fixed host/path rules first, mined association rules for the rest.

FP-growth mines combinations of URL tokens (host labels, path segments, query
keys) together with the label; rules that imply a blocked page are pruned by
support and confidence. Tokens that stand in exactly the same labelled URLs, such
as those of one template, are one class: a rule with two members of a class
needs no more than the same rule with one of them, and matches no more URLs. So
rules are mined over classes, of which a URL has those of its tokens; a template
of thirty tokens gives one class instead of 2**30 combinations.

A rule is indexed under the rarest class of its combination, so a URL meets only
rules that share that class and then checks the others. All of it is DataFrame
and Spark ML work in the JVM.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm.common import materialise, spread_join

#: (rule, verdict): a host with its subdomains, and the beginning of the path.
RULES = (
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
)
#: Share of labelled pages that hold a mined combination with its label, and its confidence.
SUPPORT, CONFIDENCE = 0.002, 0.8
_BLOCKED = "label=block"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(
        F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, decision in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        its_host, _, its_path = text.partition("/")
        fits = ((host == its_host) | host.endswith("." + its_host)) & path.startswith("/" + its_path)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL, each with the part it stands in."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    parts = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), F.lower(x)))
    question = F.coalesce(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(""))
    keys = F.transform(
        F.split(question, "&"), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1))
    )
    return F.array_distinct(F.filter(F.concat(labels, parts, keys), lambda x: F.length(x) > 2))


def classes(labelled: DataFrame, support: float = SUPPORT) -> DataFrame:
    """``(token, class)``: frequent tokens of ``labelled(tokens)``, those of the same rows under the least of their names.

    A token is frequent in ``support`` of the rows or more, so there are at most
    as many as the mean number of tokens in a row divided by ``support``.
    """
    rows = materialise(labelled.select("tokens").withColumn("row", F.monotonically_increasing_id()), "labelled")
    least = max(1, math.ceil(support * rows.count()))
    seen = rows.select("row", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("row")).alias("a"),
        F.bit_xor(F.xxhash64("row", F.lit(7))).alias("b"),
    )
    frequent = materialise(seen.where(F.col("n") >= least), "tokens")
    same = ["n", "a", "b"]
    return frequent.join(frequent.groupBy(*same).agg(F.min("token").alias("class")), same).select("token", "class")


def _of_classes(rows: DataFrame, known: DataFrame, keep: list[str]) -> DataFrame:
    """``rows(keep, tokens)`` with the classes of their tokens as ``tokens``; rows without any are left out."""
    return (
        rows.select(*keep, F.explode("tokens").alias("token"))
        .join(F.broadcast(known), "token")
        .groupBy(*keep)
        .agg(F.collect_set("class").alias("tokens"))
    )


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """``(rule_id, token, needs, confidence)`` from rows ``(tokens, blocked)``.

    ``token`` is the rarest of the combination ``needs``. No rows, or none that
    is blocked, give no rules.
    """
    spark = labelled.sparkSession
    items = labelled.where(F.size("tokens") > 0).select(
        F.when(F.col("blocked"), F.concat("tokens", F.array(F.lit(_BLOCKED)))).otherwise(F.col("tokens")).alias("items")
    )
    none = "rule_id string, token string, needs array<string>, confidence double"
    if not items.where(F.array_contains("items", _BLOCKED)).limit(1).count():
        return spark.createDataFrame([], none)
    # A combination with its label cannot be more frequent than the label's own pages.
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items)
    rules = model.associationRules.where(
        F.array_contains("consequent", _BLOCKED) & (F.size("antecedent") > 0)
    ).select(F.array_sort("antecedent").alias("needs"), "confidence")
    rules = rules.select(F.array_join("needs", " ").alias("rule_id"), "needs", "confidence")
    frequency = model.freqItemsets.where(F.size("items") == 1).select(
        F.col("items")[0].alias("token"), F.col("freq")
    )
    return (
        rules.select("*", F.explode("needs").alias("token"))
        .join(frequency, "token")
        .groupBy("rule_id", "needs", "confidence")
        .agg(F.min(F.struct("freq", "token")).alias("rarest"))
        .select("rule_id", F.col("rarest.token").alias("token"), "needs", "confidence")
    )


#: Rules up to which they are handed to all tasks; more of them are dealt by token.
_FEW = 20_000


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct ``url`` of ``urls(url, tokens)`` that hold all tokens of some rule."""
    rules = materialise(rules.select("token", "needs"), "rules")
    places = urls.select("url", "tokens", F.explode("tokens").alias("token"))
    if rules.count() <= _FEW:
        met = places.join(F.broadcast(rules), "token")
    else:  # a frequent token's URLs are dealt over several tasks
        groups = places.groupBy("token").agg(F.count("*").alias("n")).join(
            rules.groupBy("token").agg(F.collect_list("needs").alias("all")), "token"
        )
        dealt = spread_join(places, materialise(groups, "places"), ["token"], ["url"])
        met = dealt.select("url", "tokens", F.explode("all").alias("needs"))
    return met.where(F.size(F.array_except("needs", "tokens")) == 0).select("url").distinct()


def judge(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """Verdict on every row of ``pages(page_id, url)``.

    Args:
        labels: ``doc_id, quality, toxic``; a page with the id of a labelled
            document teaches: blocked if any of its labels is toxic or of no
            quality. Null labels count as fine; rows without an id are left out.

    Returns ``page_id, host, path, rule, verdict`` (allow or block), a row for
    each row of ``pages``, repeated ones too. A null url has an empty host and path
    and is allowed. Rules of equal length exclude each other. Tables without rows
    give none, or no mined rule; other columns are ignored.
    """
    host, path = split_url(F.col("url"))
    base = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"))
    base = base.withColumns({"host": host, "path": path})
    known = (
        labels.where("doc_id is not null")
        .groupBy(F.col("doc_id").alias("page_id"))
        .agg(F.max(F.expr("coalesce(toxic = 1, false) or coalesce(quality = 0, false)")).alias("blocked"))
    )
    found = tokens(F.col("url"), F.col("host"), F.col("path"))
    labelled = base.join(known, "page_id").select("page_id", "url", found.alias("tokens"), "blocked").where(F.size("tokens") > 0)
    labelled = materialise(labelled.withColumn("row", F.monotonically_increasing_id()), "labelled")
    groups = materialise(classes(labelled), "classes")
    mined = mine(labelled.select("row", "blocked").join(_of_classes(labelled, groups, ["row"]), "row", "left").select(F.coalesce("tokens", F.array(F.lit(""))).alias("tokens"), "blocked"))
    # Only rows that no fixed rule settles need the mined ones, each URL once.
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    open_urls = base.where(rule.isNull() & F.col("url").isNotNull()).select("url", "host", "path").distinct()
    open_urls = _of_classes(open_urls.select("url", found.alias("tokens")), groups, ["url"])
    bad = matched(open_urls, mined).withColumn("bad", F.lit(True))
    return base.join(bad, "url", "left").select(
        "page_id",
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("bad"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(
        spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    )
