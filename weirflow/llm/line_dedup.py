"""Line dedup: later copies of repeated line runs are deleted.

A corpus is a set of sequences of line ids, and a suffix is a document from one
of its lines on. Prefix doubling ranks the suffixes by their first line, then by
their first 2, 4, ... lines: the rank of twice as many is the place of the pair
of ranks in the sorted list of distinct pairs. Suffixes whose run occurs once
leave. Suffixes that are equal in their first ``d`` lines are an interval of
the suffix array whose common prefix has ``d`` lines or more; two ranks that
overlap name it for a ``d`` between powers of two. All but the interval's
earliest suffix are later copies.

An interval decides at the depth where its run first has the minimum of
characters, seen from the run's first line and, mirrored, from its last one.
Every part of a repeated run is repeated, so a maximal run with the minimum is
the union of such runs: from each of its lines on the shortest one to the
right, or to the left at its end. All occurrences of a run have the same depth.
Overlapping and touching copies are joined to maximal runs before deletion.

Only DataFrame operations are used. Plans are as large after many rounds as
after one, and there are as many rounds as the longest decisive run has bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirflow.llm.common import Growing, forget, fresh, materialise, spread_join

#: Characters a repeated run must have; shorter runs stay.
MIN_CHARS = 20

_DOC = ("doc", "text_id")


def _ranked(rows: DataFrame, by: list[str], rank: str) -> DataFrame:
    """Repeated values of ``by``, with their ordinals as ``rank``, their number and earliest place.

    Ordinals follow the sort order; they have gaps where partitions meet.
    """
    groups = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min(F.struct(*_DOC, "pos")).alias("first"))
    ranks = groups.where("n > 1").orderBy(*by).withColumn(rank, F.monotonically_increasing_id())
    return materialise(ranks, "ranks")


def _suffixes(docs: DataFrame) -> DataFrame:
    """``(doc, text_id, pos, chars, rank, later)`` of all repeated lines of ``docs(doc, text_id, text)``."""
    lines = docs.select(*_DOC, F.posexplode(F.split("text", "\n")).alias("pos", "line")).select(
        *_DOC,
        "pos",
        F.length("line").cast("long").alias("chars"),
        F.xxhash64("line").alias("a"),
        F.xxhash64(F.lit(7), "line").alias("b"),
    )
    ranks = _ranked(lines, ["a", "b"], "rank")
    first = F.struct(*_DOC, "pos") != F.col("first")
    return materialise(
        spread_join(lines, ranks, ["a", "b"], [*_DOC, "pos"]).select(*_DOC, "pos", "chars", "rank", first.alias("later")),
        "suffixes",
    )


def _decisive(suffixes: DataFrame, min_chars: int) -> DataFrame:
    """Suffixes near runs of several lines that decide.

    ``ahead`` is the length of the shortest run with ``min_chars`` characters that
    begins at the line, ``behind`` of the one that ends there, null without such
    a run of repeated lines; ``top`` is the greatest of them in the block.
    """
    order = Window.partitionBy(*_DOC).orderBy("pos")
    once = suffixes.withColumn("before", F.lag("pos").over(order)).where("before is null or before != pos")
    blocks = once.withColumn("block", F.col("pos") - F.row_number().over(order))
    block = Window.partitionBy(*_DOC, "block")
    counted = blocks.withColumn("end", F.sum("chars").over(block.orderBy("pos")))
    counted = counted.withColumn("begin", F.col("end") - F.col("chars"))
    whole = {"total": F.max("end"), "low": F.min("pos"), "high": F.max("pos")}
    counted = counted.withColumns({name: f.over(block) for name, f in whole.items()})
    left = F.max("pos").over(block.orderBy("end").rangeBetween(Window.unboundedPreceding, -min_chars))
    right = F.min("pos").over(block.orderBy(F.desc("begin")).rangeBetween(Window.unboundedPreceding, -min_chars))
    sized = counted.withColumn("left", left).withColumn("right", right).select(
        *_DOC,
        "block",
        "pos",
        "rank",
        F.when(F.col("total") - F.col("begin") >= min_chars, F.coalesce("right", F.col("high") + 1) - F.col("pos")).alias("ahead"),
        F.when(F.col("end") >= min_chars, F.col("pos") - F.coalesce("left", F.col("low") - 1)).alias("behind"),
    )
    return sized.withColumn("top", F.max(F.greatest("ahead", "behind")).over(block)).where("top > 1").drop("block")


def _doubled(level: DataFrame, size: int) -> DataFrame:
    """Ranks of runs of ``2 * size`` lines from those of ``size`` lines."""
    beyond = Window.partitionBy(*_DOC).orderBy("pos").rangeBetween(size, size)
    pairs = (
        level.where(f"top >= {2 * size}")
        .withColumn("second", F.first("rank").over(beyond))
        .where("second is not null")
        .select(*_DOC, "pos", "top", F.col("rank").alias("half"), "second")
    )
    pairs = materialise(pairs, "pairs")
    ranks = _ranked(pairs, ["half", "second"], "rank")
    level = materialise(
        spread_join(pairs, ranks, ["half", "second"], [*_DOC, "pos"]).select(*_DOC, "pos", "top", "rank"), "level"
    )
    forget(pairs)
    forget(ranks)
    return level


def _copies(asked: DataFrame, level: DataFrame, size: int) -> DataFrame:
    """Runs of ``asked`` of ``size`` to ``2 * size - 1`` lines that are not their interval's first."""
    here = asked.where(f"n_lines >= {size} and n_lines < {2 * size}").withColumn("last", F.expr(f"pos + n_lines - {size}"))
    named = here.join(level.select(*_DOC, "pos", F.col("rank").alias("a")), [*_DOC, "pos"]).join(
        level.select(*_DOC, F.col("pos").alias("last"), F.col("rank").alias("b")), [*_DOC, "last"]
    )
    named = materialise(named.select(*_DOC, "pos", "n_lines", "a", "b"), "named")
    name = ["n_lines", "a", "b"]
    groups = named.groupBy(*name).agg(F.count("*").alias("n"), F.min(F.struct(*_DOC, "pos")).alias("first"))
    groups = materialise(groups.where("n > 1"), "intervals")
    return spread_join(named, groups, name, [*_DOC, "pos"]).where(F.struct(*_DOC, "pos") != F.col("first"))


def repeated_runs(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(doc, text_id, pos, end)``: maximal runs of lines that are covered by later copies.

    ``docs(doc, text_id, text)``: without nulls; equal rows count as one.
    """
    if min_chars < 1:
        raise ValueError("a repeated run must have a character at least")
    suffixes = _suffixes(docs)
    found = Growing(docs.sparkSession, "doc long, text_id long, pos int, n_lines int", "copies")
    found.add(suffixes.where(f"later and chars >= {min_chars}").withColumn("n_lines", F.lit(1)))
    level = materialise(_decisive(suffixes, min_chars), "decisive")
    runs = F.array(
        F.struct("pos", F.col("ahead").alias("n_lines")),
        F.struct((F.col("pos") - F.col("behind") + 1).alias("pos"), F.col("behind").alias("n_lines")),
    )
    asked = level.select(*_DOC, F.explode(runs).alias("r")).select(*_DOC, "r.*").where("n_lines > 1")
    longest = level.agg(F.max("top")).first()[0] or 0
    size = 1
    while 2 * size <= longest:
        level = _doubled(level, size)
        size *= 2
        found.add(_copies(asked, level, size))
    ahead = Window.partitionBy(*_DOC).orderBy("pos", "n_lines")
    reach = F.max(F.col("pos") + F.col("n_lines")).over(ahead.rowsBetween(Window.unboundedPreceding, -1))
    return (
        found.read()
        .withColumn("opens", F.when(reach >= F.col("pos"), 0).otherwise(1))
        .withColumn("run", F.sum("opens").over(ahead.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*_DOC, "run")
        .agg(F.min("pos").alias("pos"), F.max(F.col("pos") + F.col("n_lines")).alias("end"))
        .drop("run")
    )


def remove_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with ``kept`` (the text without later copies) and ``n_lines``, ``n_removed``.

    Lines stand between line feeds. A run of lines, of any number, that also
    starts earlier (smaller doc_id, or same document before) is deleted if its
    lines have ``min_chars`` characters together. Runs never cross documents and
    are judged on the input.

    A null text stays null and has no lines; an empty text has one empty line. A
    row without a doc_id keeps its text and is no copy's original. Equal rows of a
    document count as one and are returned alike; rows of one doc_id with
    different texts are documents of their own, in the order of a hash of the
    text. A table without rows gives none. A text may have any number of lines;
    those of one document are sorted in one task. The other columns of ``docs``
    are kept, unless they are named as the three new ones, which replace them.
    """
    own = fresh(docs.columns)
    base = docs.drop("kept", "n_lines", "n_removed")
    text = F.col("text").cast("string")
    known = docs.where("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("long").alias("doc"), F.xxhash64(text).alias("text_id"), text.alias("text")
    )
    runs = (
        repeated_runs(known, min_chars)
        .groupBy(*_DOC)
        .agg(F.collect_list(F.struct("pos", "end")).alias("runs"))
        .withColumnsRenamed({c: own + c for c in (*_DOC, "runs")})
        .hint("shuffle_hash")
    )
    marked = base.withColumn(f"{own}id", F.col("doc_id").cast("long")).withColumn(f"{own}hash", F.xxhash64(text))
    same = (F.col(f"{own}id") == F.col(f"{own}doc")) & (F.col(f"{own}hash") == F.col(f"{own}text_id"))
    joined = marked.join(runs, same, "left").withColumn(f"{own}lines", F.split(text, "\n"))
    gone = F.flatten(F.transform(f"{own}runs", lambda r: F.sequence(r["pos"], r["end"] - 1)))
    joined = joined.withColumn(f"{own}gone", F.coalesce(gone, F.expr("cast(array() as array<int>)")))
    every = F.sequence(F.lit(0), F.size(f"{own}lines") - 1)
    left = F.transform(F.array_except(every, f"{own}gone"), lambda i: F.element_at(f"{own}lines", i + 1))
    count = lambda column: F.when(F.col("text").isNull(), 0).otherwise(F.size(own + column)).cast("long")
    return joined.select(
        *(base[c] for c in base.columns),
        F.when(F.size(f"{own}gone") == 0, text).otherwise(F.array_join(left, "\n")).alias("kept"),
        count("lines").alias("n_lines"),
        count("gone").alias("n_removed"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeated_lines(docs).select("doc_id", "n_lines", "n_removed", F.col("kept").alias("text"))


#: Runs of every length, each against all that start earlier. Runs of unique lines cannot repeat and are left out.
ORACLE = r"""
with l as (
  select doc_id, string_split(text, chr(10)) as l from documents
), line as (
  select doc_id, generate_subscripts(l, 1) as i, unnest(l) as x from l
), often as (
  select x from line group by x having count(*) > 1
), step as (
  select doc_id, i, x, i - row_number() over (partition by doc_id order by i) as part
  from line join often using (x)
), block as (
  select doc_id, part, min(i) as low, list(x order by i) as xs from step group by doc_id, part
), start as (
  select doc_id, part, low, xs, generate_subscripts(xs, 1) as s from block
), run as (
  select doc_id, low + s - 1 as i, n, md5(array_to_string(xs[s:s + n - 1], chr(10))) as k,
         len(array_to_string(xs[s:s + n - 1], '')) as chars
  from start, unnest(range(1, len(xs) - s + 2)) as t(n)
), later as (
  select *, row_number() over (partition by n, k order by doc_id, i) as r from run
), gone as (
  select distinct doc_id, unnest(range(i, i + n)) as i from later where r > 1 and chars >= 20
)
select line.doc_id, count(*) as n_lines, count(gone.i) as n_removed,
       coalesce(string_agg(x, chr(10) order by line.i) filter (where gone.i is null), '') as text
from line left join gone on gone.doc_id = line.doc_id and gone.i = line.i
group by line.doc_id
union all
select doc_id, 0, 0, null from documents where text is null
"""
