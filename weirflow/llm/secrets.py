"""Secret scans by a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived
that every match satisfies (lower-cased, so letter case never loses a match).
Postings of the trigrams that occur in any query are intersected by document;
only candidates are verified with the expression. Rules without a mandatory
trigram scan every text. Everything runs as Spark expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_PARSER = re._parser  # type: ignore[attr-defined]


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a match must have ``least`` characters in group ``measured``."""

    kind: str
    pattern: str
    measured: int
    least: int
    any_case: bool = False


#: Base kinds, as the contract lists them.
BASE = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2, 6, any_case=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: Kinds that the method adds.
MORE = (
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
)
RULES = BASE + MORE
_MOST_STRINGS, _MOST_CLAUSES = 32, 64

#: A query is a set of clauses; a clause is a set of trigrams that all must occur.
Clauses = frozenset[frozenset[str]]
ANY: Clauses = frozenset([frozenset()])


def _both(a: Clauses, b: Clauses) -> Clauses:
    joined = frozenset(x | y for x in a for y in b)
    return joined if len(joined) <= _MOST_CLAUSES else min((a, b), key=lambda q: q == ANY)


def _of_strings(strings: set[str]) -> Clauses:
    return frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _analyse(tree) -> tuple[set[str] | None, Clauses]:
    """All strings a pattern matches, if they are few, and a query of its matches."""
    exact: set[str] | None = {""}
    query = ANY
    whole = True
    for op, value in tree:
        name = str(op)
        strings, own = None, ANY
        if name == "LITERAL":
            strings = {chr(value).lower()}
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in value):
            strings = {chr(v).lower() for _, v in value}
        elif name == "SUBPATTERN":
            strings, own = _analyse(value[-1])
        elif name == "BRANCH":
            parts = [_analyse(p) for p in value[1]]
            if all(s is not None for s, _ in parts):
                strings = set().union(*(s for s, _ in parts))
            own = frozenset().union(*(_both(_of_strings(s), q) if s else q for s, q in parts))
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = value
            some, inner_query = _analyse(inner)
            if some is not None and (low, high) == (0, 1):
                strings = some | {""}
            elif some is not None and low == high == 1:
                strings = some
            elif low > 0:
                own = _both(_of_strings(some), inner_query) if some else inner_query
        if strings is not None and exact is not None and len(strings) * len(exact) <= _MOST_STRINGS:
            exact = {a + b for a, b in product(exact, strings)}
            continue
        whole = False
        query = _both(query, _of_strings(exact))
        if strings is not None and len(strings) <= _MOST_STRINGS:
            exact = set(strings)
        else:
            query, exact = _both(query, own), {""}
    if whole:
        return exact, query
    return None, _both(query, _of_strings(exact))


def trigrams(rule: Rule) -> Clauses | None:
    """The rule's trigram query; None if some match needs no trigram."""
    strings, query = _analyse(_PARSER.parse(rule.pattern))
    if strings is not None:
        query = _both(query, _of_strings(strings))
    return None if frozenset() in query else query


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def candidates(docs: DataFrame, rules=RULES) -> DataFrame:
    """``(key, kinds)`` of ``docs(key, text)``: the rules whose trigram query a document meets."""
    spark = docs.sparkSession
    queries = {r.kind: trigrams(r) for r in rules}
    clauses = [
        (kind, number, gram, len(clause))
        for kind, query in queries.items()
        if query is not None
        for number, clause in enumerate(sorted(query, key=sorted))
        for gram in sorted(clause)
    ]
    grams = sorted({c[2] for c in clauses})
    if not grams:
        return spark.createDataFrame([], "key long, kinds array<string>")
    lowered = docs.where("text is not null").select("key", _lower(F.col("text")).alias("low"))
    postings = lowered.select(
        F.explode(F.array_compact(F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams)))).alias("gram"),
        "key",
    )
    # The queries are as many rows as the rules have trigrams: a fixed, small table.
    wanted = spark.createDataFrame(clauses, "kind string, clause int, gram string, size int")
    return (
        postings.join(F.broadcast(wanted), "gram")
        .groupBy("key", "kind", "clause", "size")
        .agg(F.count_distinct("gram").alias("met"))
        .where("met = size")
        .groupBy("key")
        .agg(F.collect_set("kind").alias("kinds"))
    )


def spans(text: Column, rule: Rule, order: int) -> Column:
    """Leftmost non-overlapping matches: array of (start, rank, kind, end) in code points.

    Each piece of text before a match is captured with it, so places are sums of
    lengths; ``\\G`` keeps the search from starting anew inside the rest.
    """
    flag = "(?i)" if rule.any_case else ""
    pattern = F.lit(rf"{flag}\G([\s\S]*?)({rule.pattern})")
    before = F.regexp_extract_all(text, pattern, F.lit(1))
    match = F.regexp_extract_all(text, pattern, F.lit(2))
    measured = F.regexp_extract_all(text, pattern, F.lit(2 + rule.measured))
    sizes = F.zip_with(before, match, lambda b, m: F.struct(F.length(b).alias("b"), F.length(m).alias("m")))
    sizes = F.zip_with(sizes, measured, lambda s, g: s.withField("g", F.length(g)))
    empty = "cast(array() as array<struct<start:bigint,rank:int,kind:string,end:bigint>>)"
    folded = F.aggregate(
        sizes,
        F.struct(F.lit(0).cast("bigint").alias("at"), F.expr(empty).alias("out")),
        lambda acc, s: F.struct(
            (acc["at"] + s["b"] + s["m"]).alias("at"),
            F.when(
                s["g"] >= rule.least,
                F.concat(
                    acc["out"],
                    F.array(
                        F.struct(
                            (acc["at"] + s["b"]).alias("start"),
                            F.lit(order).alias("rank"),
                            F.lit(rule.kind).alias("kind"),
                            (acc["at"] + s["b"] + s["m"]).alias("end"),
                        )
                    ),
                ),
            )
            .otherwise(acc["out"])
            .alias("out"),
        ),
    )
    return folded["out"]


def _worth(rule: Rule) -> str:
    """A quick pattern that every counted match of a rule holds."""
    if rule.kind == "hex":
        return rf"[0-9a-f]{{{rule.least}}}"
    return ("(?i)" if rule.any_case else "") + rule.pattern


def find_secrets(docs: DataFrame, rules=RULES) -> DataFrame:
    """``doc_id, found array<struct<start,rank,kind,end>>`` for each row of ``docs``.

    Spans are sorted by start, then by the order of the rules; places count code
    points, ends are exclusive. A null text is empty. Rows that share an id, or
    have none, are scanned each for themselves. A table without rows gives none,
    other columns are ignored.
    """
    # Rows without an id are known by their text; a clash only adds candidates, which are verified.
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")))
    base = docs.select("doc_id", F.col("text").cast("string").alias("text"), key.alias("key"))
    joined = base.join(candidates(base.select("key", "text"), rules).hint("shuffle_hash"), "key", "left")
    empty = F.expr("cast(array() as array<struct<start:bigint,rank:int,kind:string,end:bigint>>)")
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = []
    for order, rule in enumerate(rules):
        worth = text.rlike(_worth(rule))
        if trigrams(rule) is not None:
            worth = F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False)) & worth
        parts.append(F.when(worth, spans(text, rule, order)).otherwise(empty))
    return joined.select("doc_id", F.array_sort(F.concat(*parts)).alias("found"))


def _joined(found: Column) -> Column:
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("found", lambda s: s["rank"] < len(BASE))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(r.kind).alias(f"n_{r.kind}") for r in BASE),
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
    )
