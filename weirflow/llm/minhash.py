"""MinHash near-dedup with tensored banding.

Two collections of half keys, each of ``ROWS`` minhashes, give the square of
their number of table keys by pairing: at 85 % 144 tables of 6 rows from 72
minhashes instead of 864. A half key that no other document has can make no
table key, so most documents emit none.

Equal shingle sets collapse to a class first. A document can link only if the
threshold's share of its shingles stand in other candidates; the others leave, which loses no link.
Within a table every document is held against the table's most central one only;
that and a distributed component search join almost everything. What is left in
different components of one table is pruned once more and compared where two
documents share one of their rarest shingles; prefixes that follow both sizes
hold one of every link.
Links are always confirmed on the full shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirflow.llm.common import lean, materialise, prepare, text_buffer
from weirflow.llm.components import components
from weirflow.llm.tokens import SPACED_LOWER, U, grams, mix, words

SHINGLE = 5
#: Links: 100 * intersection >= THRESHOLD * union.
THRESHOLD = 85
#: Minhashes of a half key.
ROWS = 3
#: At the threshold a pair shares no half key of one collection with at most this probability, no table with twice that.
MISS = 1.1e-5
#: Sizes within this factor share a level.
STEP = 1.03
#: Counts below 1 / (STEP - 1) have levels without a size; those stay empty.
_LEVEL = f"cast(floor(ln(n_shingles) / ln({STEP}D) + 1e-9) as int)"


def half_keys(threshold: int) -> int:
    """Half keys of a collection that keep to ``MISS``: 12 at 85 %, 16 at 80 %."""
    same = (threshold / 100) ** ROWS
    return math.ceil(math.log(MISS) / math.log(1 - same)) if same < 1 else 1


def _sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each row, sorted."""
    for low, high, hashes, _, _, first in words(data, offsets, SPACED_LOWER):
        g = grams(hashes, SHINGLE)
        for i in range(high - low):
            s, e = int(first[i]), int(first[i + 1])
            if e - s >= SHINGLE:
                yield np.unique(g[s : e - SHINGLE + 1])
            else:  # none, or the whole sequence as one
                yield grams(hashes[s:e], e - s) + U(e - s) if e > s else np.zeros(0, np.uint64)


def _halves(shingles: np.ndarray, seeds: np.ndarray, factors: np.ndarray) -> np.ndarray:
    least = np.full(len(seeds), U(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096, None]
        np.minimum(least, ((part ^ seeds) * factors).min(axis=0), out=least)
    keys = np.zeros(len(seeds) // ROWS, np.uint64)
    for j in range(ROWS):
        keys = mix(keys + least[j :: ROWS])
    return mix(keys + np.arange(len(keys), dtype=np.uint64))


def _sketch(count: int):
    """Sizes, hashes and ``2 * count`` half keys of the rows' shingle sets."""
    seeds = mix(np.arange(1, 2 * count * ROWS + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
    factors = mix(seeds + U(99)) | U(1)

    @lean
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            size, one, two, halves = [], [], [], []
            for s in _sets(data, offsets):
                size.append(len(s))
                one.append(int(mix(s + U(3)).sum(dtype=np.uint64)))
                two.append(int(mix(s ^ U(0xABCDEF0123456789)).sum(dtype=np.uint64)))
                halves.append(_halves(s, seeds, factors) if len(s) else np.zeros(2 * count, np.uint64))
            flat = np.concatenate(halves).view(np.int64) if halves else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(size, pa.int64()),
                    pa.array(np.array(one, np.uint64).view(np.int64)),
                    pa.array(np.array(two, np.uint64).view(np.int64)),
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(len(size) + 1, dtype=np.int32) * 2 * count), pa.array(flat)
                    ),
                ],
                ["doc_id", "n_shingles", "one", "two", "halves"],
            )

    return sketch


@lean
def _emit_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        data, offsets = text_buffer(batch.column("text"))
        sets = list(_sets(data, offsets))
        if sets:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(ids, [len(s) for s in sets])),
                    pa.array(np.concatenate(sets).view(np.int64)),
                ],
                ["doc_id", "shingle"],
            )


def _similar(threshold: int):
    """Confirms pairs on full sets; the last left or right set is kept for the next row."""

    @lean
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, tuple[int, np.ndarray]] = {}
        for batch in batches:
            good, share = [], []
            for a, b, left, right in zip(
                *(batch.column(c).to_pylist() for c in ("a", "b", "left", "right")), strict=True
            ):
                sets = []
                for side, key, text in (("a", a, left), ("b", b, right)):
                    if kept.get(side, (None,))[0] != key:
                        kept[side] = (key, next(_sets(*text_buffer(pa.array([text], pa.string())))))
                    sets.append(kept[side][1])
                common = len(np.intersect1d(*sets, assume_unique=True))
                union = len(sets[0]) + len(sets[1]) - common
                good.append(100 * common >= threshold * union)
                share.append(common / union)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(share, pa.float64()), pa.array(good, pa.bool_())],
                ["a", "b", "share", "linked"],
            )

    return confirm


def _confirmed(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """``pairs(a, b)`` with their similarity and whether it reaches the threshold."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("right"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(
        _similar(threshold), "a long, b long, share double, linked boolean"
    )


def _tables(sketches: DataFrame, count: int) -> DataFrame:
    """``(doc_id, key)``: table keys that at least two classes have."""
    halves = sketches.select("doc_id", F.posexplode("halves").alias("place", "half"))
    shared = halves.groupBy("half").count().where("count > 1").select("half")
    live = halves.join(shared, "half").groupBy("doc_id").agg(
        F.collect_set(F.when(F.col("place") < count, F.col("half"))).alias("left"),
        F.collect_set(F.when(F.col("place") >= count, F.col("half"))).alias("right"),
    )
    keys = live.select(
        "doc_id",
        F.explode(F.expr("flatten(transform(left, x -> transform(right, y -> xxhash64(x, y))))")).alias("key"),
    )
    return keys


def _able(texts: DataFrame, members: DataFrame, sizes: DataFrame, threshold: int) -> DataFrame:
    """Members that can link with another one: enough of their shingles stand in others of them."""
    shingles = texts.join(members, "doc_id", "left_semi").mapInArrow(
        _emit_shingles, "doc_id long, shingle long"
    )
    common = shingles.groupBy("shingle").count().where("count > 1").select("shingle")
    return materialise(
        shingles.join(common, "shingle", "left_semi")
        .groupBy("doc_id")
        .count()
        .join(sizes, "doc_id")
        .where(f"100 * count >= {threshold} * n_shingles")
        .select("doc_id"),
        "able",
    )


def _prefixes(texts: DataFrame, members: DataFrame, sizes: DataFrame, threshold: int) -> DataFrame:
    """``(key, doc_id, component, level, other)``: shingles of which each link across components shares one.

    Only shingles that several components have can lie in such a link's
    intersection. A partner of size m shares at least ``threshold * (n + m) /
    (100 + threshold)`` shingles, so with its ``shared`` such shingles in a common
    order a document shares one of the first ``shared - least + 1``; here the
    rarest come first. Sizes are told apart by level (powers of ``STEP``): a
    document has one prefix for each level ``other`` that partners may have, and
    pairs meet where the level of each is the other's ``other``.
    """
    shingles = texts.join(members, "doc_id", "left_semi").mapInArrow(
        _emit_shingles, "doc_id long, shingle long"
    )
    owned = materialise(shingles.join(members, "doc_id"), "owned")
    common = (
        owned.groupBy("shingle")
        .agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low != high")
        .select("shingle", "n")
    )
    shared = materialise(owned.join(common, "shingle"), "shared")
    reach = math.ceil(math.log(100 / threshold) / math.log(STEP)) + 1
    asked = (
        shared.groupBy("doc_id")
        .agg(F.count("*").alias("shared"))
        .join(sizes, "doc_id")
        .withColumn("level", F.expr(_LEVEL))
        .withColumn("other", F.explode(F.expr(f"sequence(greatest(level - {reach}, 0), level + {reach})")))
        .withColumn("smallest", F.expr(f"cast(ceil(pow({STEP}D, other) - 1e-6) as long)"))
        .withColumn("least", F.expr(f"({threshold} * (n_shingles + smallest) + {99 + threshold}) div {100 + threshold}"))
        .selectExpr("doc_id", "level", "other", "shared - least + 1 as most")
        .where("most > 0")
    )
    asked = materialise(asked, "asked")
    answered = asked.selectExpr("level as other", "other as level").distinct()
    asked = asked.join(answered, ["level", "other"], "left_semi")
    longest = asked.groupBy("doc_id").agg(F.max("most").alias("longest"))
    held = Window.partitionBy("doc_id").orderBy("n", "shingle")
    ranked = (
        shared.join(longest, "doc_id")
        .withColumn("place", F.row_number().over(held))
        .where("place <= longest")
        .select("doc_id", "component", F.col("shingle").alias("key"), "place")
    )
    return (
        ranked.alias("r")
        .join(asked.alias("a"), F.expr("r.doc_id = a.doc_id and r.place <= a.most"))
        .selectExpr("key", "r.doc_id as doc_id", "component", "level", "other")
    )


def _mixed(rows: DataFrame, *by: str) -> DataFrame:
    """``rows(component, ...)`` of the groups by ``by`` that more than one component has."""
    several = (
        rows.groupBy(*by)
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low != high")
        .select(*by)
    )
    return rows.join(several, [*by])


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Groups of documents that links of near-equal shingle sets connect.

    A document's set holds its distinct 5-word shingles (A-Z lower-cased, words
    between white space); with fewer words the whole sequence is the one
    shingle; without words the set is empty and links with nothing.

    Returns ``doc_id, n_shingles, component_id, kept`` for each row. A null text is
    empty. A row without a doc_id links with nothing and is kept, its component
    is null. Repeated rows of a document are all returned alike. Other columns
    are ignored.
    """
    spark = prepare(docs.sparkSession)
    count = half_keys(threshold)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = materialise(
        base.mapInArrow(
            _sketch(count), "doc_id long, n_shingles long, one long, two long, halves array<long>"
        ),
        "sketches",
    )
    same = ["n_shingles", "one", "two"]
    filled = sketches.where("n_shingles > 0 and doc_id is not null")
    classes = materialise(
        filled.groupBy(*same).agg(F.min("doc_id").alias("doc_id"), F.first("halves").alias("halves")),
        "classes",
    )
    keys = materialise(_tables(classes, count), "keys")
    sizes = classes.select("doc_id", "n_shingles")
    shared = keys.groupBy("key").count().where("count > 1").select("key")
    met = materialise(keys.join(shared, "key").select("doc_id").distinct(), "met")
    held = base.where("doc_id is not null and text is not null").join(
        met.hint("shuffle_hash"), "doc_id", "left_semi"
    )
    if sketches.groupBy("doc_id").count().where("count > 1").limit(1).count():
        held = held.dropDuplicates(["doc_id"])  # repeated rows; else the texts need no sort
    texts = materialise(held, "texts")
    able = met
    for _ in range(2):
        able = _able(texts, able, sizes, threshold)
    keys = materialise(keys.join(able, "doc_id"), "keys")
    # The hub of a table is its most central document, the one whose tables hold most others.
    counts = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = materialise(keys.join(counts, "key"), "rows")
    central = rows.groupBy("doc_id").agg(F.sum("n").alias("score"))
    ranked = rows.join(central, "doc_id")
    hubs = ranked.groupBy("key").agg(
        F.max_by("doc_id", F.struct("score", -F.col("doc_id"))).alias("hub")
    )
    tables = materialise(rows.select("key", "doc_id").join(hubs, "key"), "tables")
    near = f"100 * least(na, nb) >= {threshold} * greatest(na, nb)"

    def sized(pairs: DataFrame) -> DataFrame:
        return (
            pairs.join(sizes.selectExpr("doc_id as a", "n_shingles as na"), "a")
            .join(sizes.selectExpr("doc_id as b", "n_shingles as nb"), "b")
            .where(near)
            .select("a", "b")
        )

    spokes = (
        tables.where("doc_id != hub")
        .selectExpr("least(hub, doc_id) as a", "greatest(hub, doc_id) as b")
        .distinct()
    )
    judged = materialise(_confirmed(sized(spokes), texts, threshold), "spokes")
    links = judged.where("linked").select("a", "b")
    found = materialise(components(links), "components")

    # Tables that still hold several components.
    named = tables.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").select(
        "key", "doc_id", F.coalesce("component", "doc_id").alias("component")
    )
    mixed = _mixed(named, "key").select("doc_id", "component").distinct()
    members = _able(texts, mixed.select("doc_id"), sizes, threshold)
    rare = _prefixes(texts, mixed.join(members, "doc_id"), sizes, threshold)
    rare = rare.withColumn("pair", F.expr("struct(least(level, other), greatest(level, other))"))
    rare = materialise(rare.withColumn("key", F.xxhash64("key", "pair")).drop("pair"), "rare")
    left = materialise(_mixed(rare, "key"), "left")
    tried = judged.select("a", "b")
    counts = left.groupBy("key", "component").count()
    main = counts.groupBy("key").agg(F.max_by("component", F.struct("count", "component")).alias("main"))
    left = materialise(left.join(main, "key"), "left")
    # Each pair of different components under a key has a side outside the key's main one.
    outer = left.where("component != main").selectExpr(
        "key", "doc_id as x", "component as cx", "main", "level as lx", "other as ox"
    )
    inner = left.selectExpr("key", "doc_id as y", "component as cy", "level as ox", "other as lx")
    pairs = (
        outer.join(inner, ["key", "lx", "ox"])
        .where("cx != cy and (cy = main or x < y)")
        .selectExpr("least(x, y) as a", "greatest(x, y) as b")
        .distinct()
        .join(tried, ["a", "b"], "left_anti")
    )
    more = materialise(_confirmed(sized(pairs), texts, threshold).where("linked").select("a", "b"), "more")
    if more.limit(1).count():
        found = components(links.union(more))
    final = classes.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").select(
        *same, F.coalesce("component", "doc_id").alias("component")
    )
    return sketches.join(final, same, "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        F.expr("doc_id is null or coalesce(component, doc_id) = doc_id").alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents
), s as (
  select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end) as g
  from w
), n as (
  select doc_id, count(*) as n from s group by doc_id
), class as (
  select doc_id, n, md5(string_agg(g, chr(10) order by g)) as k from s join n using (doc_id) group by doc_id, n
), rep as (
  select k, min(doc_id) as r from class group by k
), pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as c
  from (select s.* from s join rep on s.doc_id = rep.r) a
  join (select s.* from s join rep on s.doc_id = rep.r) b on a.g = b.g and a.doc_id < b.doc_id
  group by 1, 2
), links as (
  select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)
), edges as (
  select a, b from links union all select b, a from links
), reach as (
  select r as id, r as seen from rep union select reach.id, edges.b from reach join edges on edges.a = reach.seen
), comp as (
  select id, min(seen) as c from reach group by id
)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(comp.c, d.doc_id) as component_id,
       coalesce(comp.c, d.doc_id) = d.doc_id as kept
from documents d left join n using (doc_id) left join class using (doc_id)
left join rep on rep.k = class.k left join comp on comp.id = rep.r
"""
