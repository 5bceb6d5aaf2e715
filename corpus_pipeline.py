"""A training corpus from ``documents``: five operators, one after the other.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before
kept; all but the last return the columns of ``documents``. :func:`run` writes
each stage's result as Parquet and reads it again for the next.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm import decontaminate, langid, line_dedup, minhash, mixing
from weirflow.llm.common import fresh, materialise, trim

#: Documents are near-duplicates from this similarity of their word shingles on, in percent.
NEAR = 80
#: Documents whose language is less certain than this are rejected.
LEAST_SCORE = 0.5
#: Documents more likely toxic than this are left out.
MOST_TOXIC = 0.5


def trimmed(stage):
    """A stage that leaves the driver no memory freed before it, or by its own jobs, for the next to add to."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        trim(spark)
        out = stage(spark, docs, sf_dir)
        trim(spark)
        return out

    return run


@trimmed
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go; a missing ``lang`` is filled in.

    A null or empty text has none. Repeated rows are judged alike.
    """
    model = langid.train(docs)
    own = fresh(docs.columns)
    marked = langid.identify(docs.select(F.struct(*docs.columns).alias(f"{own}row"), "text"), model)
    sure = marked.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    row = F.col(f"{own}row")
    columns = {"lang": F.coalesce(row["lang"], F.col("lang_pred"))}
    return sure.select(*(columns.get(c, row[c]).alias(c) for c in docs.columns))


@trimmed
def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go, and documents of which nothing is left.

    Rows without a doc_id or text stay as they are.
    """
    own = fresh(docs.columns)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select(F.struct(F.lit(0).alias(f"{own}none"), *others).alias(f"{own}row"), "doc_id", "text")
    out = line_dedup.remove_repeated_lines(rows)
    nothing = (F.col("n_removed") > 0) & (F.trim(F.regexp_replace("kept", r"\s+", " ")) == "")
    row = F.col(f"{own}row")
    length = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(row["n_chars"])
    columns = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": length}
    left = out.where(~F.coalesce(nothing, F.lit(False)))
    return left.select(*(columns.get(c, row[c]).alias(c) for c in docs.columns))


@trimmed
def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id.

    Rows without a doc_id stay; so do all rows of the document that stays.
    """
    gone = minhash.near_duplicates(docs, NEAR).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


@trimmed
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; from the others benchmark passages are cut out.

    A null text holds none and stays.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    own = fresh(docs.columns)
    rows = docs.select(F.struct(*docs.columns).alias(f"{own}row"), "doc_id", "text")
    found = decontaminate.find_leaks(rows, benchmark, carry=(f"{own}row",))
    row = F.col(f"{own}row")
    text = F.coalesce("cleaned", row["text"])
    columns = {"text": text, "n_chars": F.when(F.col("n_hit") > 0, F.length(text).cast("long")).otherwise(row["n_chars"])}
    left = found.where(~F.expr(decontaminate.CONTAMINATED))
    return left.select(*(columns.get(c, row[c]).alias(c) for c in docs.columns))


@trimmed
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the rate at which the mixture takes them; toxic ones go.

    Rates scale with the corpus's scarcest domain, so a document's own posterior
    decides whether it stays. Each row is judged by its own text, whether it has an
    id or not; a null text is not toxic.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    own = fresh(docs.columns)
    rates = mixing.mix(docs, labels).dropDuplicates(["doc_id", "text_id"]).select(
        *(F.col(c).alias(own + c) for c in ("doc_id", "text_id", "p_toxic", "rate"))
    )
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(f"{own}doc_id")) & F.xxhash64(F.col("text").cast("string")).eqNullSafe(F.col(f"{own}text_id"))
    mixed = docs.drop("rate").join(rates.hint("shuffle_hash"), same, "left")
    toxic = F.coalesce(F.col(f"{own}p_toxic"), F.lit(0.0)) > MOST_TOXIC
    kept = [c for c in docs.columns if c != "rate"]
    return mixed.where(~toxic).select(*kept, F.coalesce(F.col(f"{own}rate"), F.lit(1.0)).alias("rate"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_deduplication),
    ("minhash_near_dedup", near_deduplication),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", source_mixing),
]

#: Learned models and hashes decide; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over ``documents`` in ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
