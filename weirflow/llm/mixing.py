"""Mixing sources to target weights with soft membership.

A classifier learned from the labelled table gives each document a posterior
over domains. Document rates r >= 0 are fitted so that the expected tokens of
each domain, sum of r * tokens * posterior, match the targets: least squares by
projected gradient with momentum, which starts anew where it leads uphill. A step
needs the few domain totals only, one aggregate over all documents; the rates
themselves never leave their rows. Steps are scaled by a document's tokens, so
documents of equal posteriors get equal rates.
"""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm.common import forget, materialise

#: Domains of the labelled table, in the order of their class numbers.
DOMAINS = ("good", "poor", "toxic")
#: Target weights: shares of the mixed corpus's expected tokens.
TARGETS = {"good": 0.9, "poor": 0.09, "toxic": 0.01}
#: Labelled documents of a domain that are expected in the training sample.
TRAIN_DOCS = 3000
#: Words that are features: the most frequent of those in so many sample documents.
FEATURES, MIN_DOCS = 1 << 13, 5.0
#: The fit ends when no domain is off by more than this share of all target tokens.
TOLERANCE = 1e-4
#: Steps at most, and those within which the misfit must shrink by a hundredth, else the targets are out of reach.
STEPS, PATIENCE = 150, 20
#: Steps after which rates are written down, so that expressions stay short.
_WRITE_EVERY = 6


def domain_labels(labels: DataFrame) -> DataFrame:
    """``doc_id, domain`` (class number): toxic first, then by quality; null labels count as 0 and 1.

    Repeated rows of a document: toxic if any is, poor if any is of no quality.
    """
    merged = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"),
        F.min(F.coalesce("quality", F.lit(1))).alias("quality"),
    )
    domain = F.when(F.col("toxic") == 1, 2.0).when(F.col("quality") == 0, 1.0).otherwise(0.0)
    return merged.select(F.col("doc_id").cast("long").alias("doc_id"), domain.alias("domain"))


def train(docs: DataFrame, labels: DataFrame, per_domain: int = TRAIN_DOCS) -> PipelineModel | None:
    """Logistic regression on frequent words; None if fewer than two domains are labelled.

    The sample is bounded: of each domain as many documents as are expected to
    be ``per_domain`` by the hash of their id (all, if there are fewer).
    """
    known = domain_labels(labels)
    counts = {r["domain"]: r["count"] for r in known.groupBy("domain").count().collect()}
    if len(counts) < 2:
        return None
    bound = F.lit(0)
    for domain, n in counts.items():
        bound = F.when(F.col("domain") == domain, int(min(1.0, per_domain / n) * (1 << 30)) + 1).otherwise(bound)
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < bound)
    # At most about per_domain rows of each domain, whatever the corpus: they can be broadcast.
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sample = materialise(texts.join(F.broadcast(chosen), "doc_id"), "labelled")
    if sample.select("domain").distinct().count() < 2:
        return None
    stages = [
        RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[\s\p{Punct}]+", toLowercase=False),
        CountVectorizer(inputCol="words", outputCol="features", vocabSize=FEATURES, minDF=MIN_DOCS, binary=True),
        LogisticRegression(
            labelCol="domain", family="multinomial", regParam=0.0003, maxIter=60, standardization=False
        ),
    ]
    return Pipeline(stages=stages).fit(sample)


def memberships(docs: DataFrame, model: PipelineModel | None) -> DataFrame:
    """``doc_id, text_id, tokens, p`` of each row: a hash of the text, words between white space, the posterior over domains.

    A null text has no tokens. Without a model every document is of the first domain.
    """
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.col("text").cast("string")).alias("text_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    tokens = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
    base = base.withColumn("tokens", tokens)
    if model is None:
        certain = [1.0] + [0.0] * (len(DOMAINS) - 1)
        return base.select("doc_id", "text_id", "tokens", F.array(*map(F.lit, certain)).alias("p"))
    p = vector_to_array("probability")
    classes = model.stages[-1].numClasses
    every = F.array(*(p[i] if i < classes else F.lit(0.0) for i in range(len(DOMAINS))))
    return model.transform(base).select("doc_id", "text_id", "tokens", every.alias("p"))


def fit_rates(members: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """``members(doc_id, text_id, tokens, p)`` with ``rate``: expected domain tokens in proportion to ``targets``.

    The mixed corpus is as large as it can be with no domain needing more tokens
    than there are. Documents without tokens keep the rate 1. ``residual`` is the
    greatest share of all target tokens by which a domain misses its target: next
    to nothing, or what no nonnegative rates can mend, as where posteriors are all
    alike.
    """
    total = sum(targets.values())
    if total <= 0:
        raise ValueError("a target weight must be positive")
    share = [targets.get(d, 0.0) / total for d in DOMAINS]
    members = materialise(
        members.select("doc_id", "text_id", "tokens", "p", F.lit(1.0).alias("rate"), F.lit(1.0).alias("ahead")), "members"
    )
    kept = ["doc_id", "text_id", "tokens", "p"]

    def totals(at: str, *more) -> list[float]:
        """Expected tokens of each domain at the rates in column ``at``, and sums of ``more``."""
        expected = (F.col(at) * F.col("tokens") * F.col("p")[i] for i in range(len(DOMAINS)))
        return [x or 0.0 for x in members.agg(*(F.sum(x).alias(f"t{i}") for i, x in enumerate((*expected, *more)))).first()]

    have = at_ahead = totals("rate")
    wanted = min((h / s for h, s in zip(have, share, strict=True) if s > 0), default=0.0)
    target = [wanted * s for s in share]
    # Residuals are weighed by the domains' own tokens, which makes the problem well conditioned.
    weight = [1.0 / h if h > 0 else 0.0 for h in have]
    misfit = [max((abs(h - t) for h, t in zip(have, target, strict=True)), default=0.0) / wanted if wanted > 0 else 0.0]
    momentum, written = 1.0, members
    for step in range(1, STEPS + 1):
        if misfit[-1] <= TOLERANCE or (len(misfit) > PATIENCE and min(misfit[-PATIENCE:]) > 0.99 * min(misfit[:-PATIENCE])):
            break
        gradient = _weighed(F.col("p"), [w * (h - t) for w, h, t in zip(weight, at_ahead, target, strict=True)])
        members = members.withColumn("next", F.greatest(F.lit(0.0), F.col("ahead") - gradient))
        *now, uphill = totals("next", F.col("tokens") * (F.col("ahead") - F.col("next")) * (F.col("next") - F.col("rate")))
        momentum = 1.0 if uphill > 0 else momentum
        grown = (1 + math.sqrt(1 + 4 * momentum * momentum)) / 2
        push, momentum = (momentum - 1) / grown, grown
        # Totals are linear in the rates, so those at the next point need no aggregate.
        at_ahead = [n + push * (n - h) for n, h in zip(now, have, strict=True)]
        pushed = F.col("next") + _weighed(F.array(F.col("next") - F.col("rate")), [push])
        members = members.select(*kept, F.col("next").alias("rate"), pushed.alias("ahead"))
        have = now
        misfit.append(max(abs(h - t) for h, t in zip(have, target, strict=True)) / wanted)
        if step % _WRITE_EVERY == 0:
            before, members = written, materialise(members, "members")
            forget(before)
            written = members
    fitted = F.when(F.col("tokens") > 0, F.col("rate")).otherwise(F.lit(1.0))
    shares = (F.col("p")[i].alias(f"p{i}") for i in range(len(DOMAINS)))
    return members.select("doc_id", "text_id", "tokens", *shares, fitted.alias("rate"), F.lit(misfit[-1]).alias("residual"))


def _weighed(values: Column, weights: list[float]) -> Column:
    """Sum of ``values`` times ``weights``, the numbers of a step.

    A literal array is handed to the generated code instead of standing in it, so
    all steps share their code and the driver does not compile and keep each.
    """
    products = F.zip_with(values, F.array(*map(F.lit, weights)), lambda x, w: x * w)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """``doc_id, text_id, tokens, p_<domain>..., rate, residual`` for each row of ``docs``.

    ``text_id`` is a hash of the text, see :func:`fit_rates` for the others. Rows
    that share an id, or have none, each get a rate of their own text; equal rows
    get equal rates. A table without rows gives none, one without labels of two
    domains has documents of the first domain only. Other columns are ignored.
    """
    fitted = fit_rates(memberships(docs, train(docs, labels)), targets)
    return fitted.withColumnsRenamed({f"p{i}": f"p_{d}" for i, d in enumerate(DOMAINS)})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
