"""Queries over expressions, envelopes, codecs and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirflow import errors
from weirflow.codecs import envelope
from weirflow.config.connectors import Registry
from weirflow.config.loader import Phase
from weirflow.functions import expressions as ex
from weirflow.functions import scalars
from weirflow.operators import handlers, records
from weirflow.queries.document import document, table
from weirflow.sources import envelopes

QUERIES: dict = {}
ORACLES: dict = {}


def _query(name: str, sql: str | None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


#: Every fifth event has no key, the next one an explicit null.
_PROPS = (
    "case when event_id % 5 = 0 then '{}' when event_id % 5 = 1 then '{\"k\": null}' "
    "when event_id % 5 = 2 then '{\"k\": false}' else props end"
)


def _slots(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("s0", F.parse_json(F.expr(_PROPS)))
    return events, ex.Slots([F.col("s0")])


@_query(
    "expr_path_strict",
    "select event_id, case when event_id % 5 = 0 then 'MissingPath' end as path_error, 'MissingSlot' as slot_error,"
    " case when event_id % 5 = 0 then 'MissingPath' else 'TypeMismatch' end as type_error from events",
)
def expr_path_strict(spark, sf_dir):
    events, slots = _slots(spark, sf_dir)
    return events.select(
        "event_id",
        ex.resolve(".[0].k", slots)[1].alias("path_error"),
        ex.resolve(".[3].k", slots)[1].alias("slot_error"),
        ex.resolve(".[0].k.deep", slots)[1].alias("type_error"),
    )


@_query(
    "expr_null_vs_missing",
    "select event_id % 5 as kind, count(*) as n, count(*) filter (where event_id % 5 = 0) as missing,"
    " count(*) filter (where event_id % 5 = 1) as nulls from events group by 1",
)
def expr_null_vs_missing(spark, sf_dir):
    events, slots = _slots(spark, sf_dir)
    value, _ = ex.resolve(".[0].k", slots)
    rows = events.select((F.col("event_id") % 5).alias("kind"), value.alias("v"))
    return rows.groupBy("kind").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("v").isNull()).alias("missing"),
        F.count_if(F.col("v").isNotNull() & F.is_variant_null("v")).alias("nulls"),
    )


@_query(
    "expr_default",
    "select event_id, case when event_id % 5 <= 2 then -1 else cast(json_extract_string(props, '$.k') as bigint) end as k from events",
)
def expr_default(spark, sf_dir):
    events, slots = _slots(spark, sf_dir)
    value, _ = ex.resolve(".[0].k // -1", slots)
    return events.select("event_id", F.try_variant_get(value, "$", "long").alias("k"))


@_query(
    "expr_projection",
    "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k,"
    " cast(json_extract_string(props, '$.k') as bigint) + 1 as next, cast(json_extract_string(props, '$.k') as bigint) > 50 as big from events",
)
def expr_projection(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("s0", F.parse_json("props"))
    value, _ = ex.resolve(".[0] | {k: .k, next: (.k + 1), tags: [.k, .k > 50]}", ex.Slots([F.col("s0")]))
    return events.select(
        "event_id",
        F.try_variant_get(value, "$.k", "long").alias("k"),
        F.try_variant_get(value, "$.next", "long").alias("next"),
        F.try_variant_get(value, "$.tags[1]", "boolean").alias("big"),
    )


@_query(
    "expr_conditional",
    "select event_id, case when event_id % 5 > 2 then 'some' else 'none' end as label, event_id % 5 <= 2 as negated from events",
)
def expr_conditional(spark, sf_dir):
    events, slots = _slots(spark, sf_dir)
    value, _ = ex.resolve('if (.[0] | .k) then "some" else "none" end', slots)
    negated, _ = ex.resolve(".[0].k | not", slots)
    return events.select("event_id", value.cast("string").alias("label"), F.try_variant_get(negated, "$", "boolean").alias("negated"))


def _items(spark, sf_dir):
    """``event_id, s0``: events with 0 to 3 items, their own id and neighbours."""
    events = table(spark, sf_dir, "events")
    items = F.when(F.col("event_id") % 4 == 0, F.expr("array()")).otherwise(F.expr("transform(sequence(1, cast(event_id % 4 as int)), i -> event_id * i)"))
    text = F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.lit(',"items":'), F.to_json(F.struct(items.cast("array<bigint>").alias("x"))).substr(F.lit(6), F.lit(100)))
    return events.select("event_id", F.parse_json(text).alias("s0"))


@_query(
    "expr_cardinality",
    "select event_id, case event_id % 4 when 0 then 'NoResults' when 1 then null else 'MultipleResults' end as error,"
    " case when event_id % 4 = 1 then event_id end as item, case when event_id % 4 = 3 then event_id * 6 else event_id * ((event_id % 4) * (event_id % 4 + 1)) // 2 end as total,"
    " event_id % 4 as n, case when event_id % 4 > 0 then 'MultipleResults' end as either_error from events",
)
def expr_cardinality(spark, sf_dir):
    rows = _items(spark, sf_dir)
    slots = ex.Slots([F.col("s0")])
    item, error = ex.resolve(".[0].items[]", slots)
    total, _ = ex.resolve("reduce .[0].items[] as $x (0; . + $x)", slots)
    count, _ = ex.resolve("[.[0].items[]] | length", slots)
    _, either = ex.resolve(".[0].id, .[0].items[]", slots)
    return rows.select(
        "event_id", error.alias("error"), F.try_variant_get(item, "$", "long").alias("item"), F.try_variant_get(total, "$", "long").alias("total"),
        F.try_variant_get(count, "$", "long").alias("n"), either.alias("either_error"),
    )


@_query(
    "expr_generators",
    "select event_id, '[' || case event_id % 4 when 0 then '' when 1 then (event_id + 1)::varchar when 2 then (event_id + 1) || ',' || (event_id * 2 + 1)"
    " else (event_id + 1) || ',' || (event_id * 2 + 1) || ',' || (event_id * 3 + 1) end || ']' as next, event_id * 10 as bound,"
    " case when event_id % 4 = 0 then 'none' else 'some' end as kind, '[' || event_id || ']' as caught from events",
)
def expr_generators(spark, sf_dir):
    slots = ex.Slots([F.col("s0")])
    value = lambda text: ex.resolve(text, slots)[0]
    return _items(spark, sf_dir).select(
        "event_id", F.to_json(value("[.[0].items[] | . + 1]")).alias("next"),
        F.try_variant_get(value(".[0] | .id as $n | $n * 10"), "$", "long").alias("bound"),
        value('if ([.[0].items[]] | length) == 0 then "none" else "some" end').cast("string").alias("kind"),
        F.to_json(value("[.[0].id, (.[0].id | .[]?)]")).alias("caught"),
    )


@_query(
    "expr_arithmetic",
    "select event_id, 9007199254740993 + event_id as exact, event_id - 1 as less, event_id % 7 as rest, event_type || '-x' as text, event_id as kept,"
    " '[' || event_id || ',1]' as joined, '{\"a\":1,\"b\":' || event_id || '}' as merged, 'Runtime' as wrong, event_id > 9 as longer, event_id = 9007199254740993 as same from events",
)
def expr_arithmetic(spark, sf_dir):
    kind = F.to_json(F.struct("event_id", "event_type"))
    rows = table(spark, sf_dir, "events").select("event_id", F.parse_json(kind).alias("s0"))
    slots = ex.Slots([F.col("s0")])
    value = lambda text: ex.resolve(text, slots)[0]
    return rows.select(
        "event_id", F.try_variant_get(value(".[0].event_id + 9007199254740993"), "$", "long").alias("exact"),
        F.try_variant_get(value(".[0].event_id-1"), "$", "long").alias("less"), F.try_variant_get(value(".[0].event_id % 7"), "$", "long").alias("rest"),
        value('.[0].event_type + "-x"').cast("string").alias("text"), F.try_variant_get(value("null + .[0].event_id"), "$", "long").alias("kept"),
        F.to_json(value("[.[0].event_id] + [1]")).alias("joined"), F.to_json(value('{a: 0, b: .[0].event_id} + {a: 1}')).alias("merged"),
        ex.resolve('.[0].event_id + "b"', slots)[1].alias("wrong"),
        F.try_variant_get(value("[.[0].event_id] > [9]"), "$", "boolean").alias("longer"),
        F.try_variant_get(value(".[0].event_id == 9007199254740993"), "$", "boolean").alias("same"),
    )


@_query(
    "expr_stringify",
    "select event_id, case event_id % 5 when 0 then '{}' when 1 then '' when 2 then 'false' else cast(json_extract_string(props, '$.k') as varchar) end as text from events",
)
def expr_stringify(spark, sf_dir):
    events, slots = _slots(spark, sf_dir)
    value = F.coalesce(F.try_variant_get("s0", "$.k", "variant"), F.col("s0"))
    return events.select("event_id", ex.stringify(value).alias("text"))


@_query(
    "expr_inline_template",
    "select c_custkey, 'To: ' || c_name || ' (' || n_name || ')' as text from customer join nation on c_nationkey = n_nationkey",
)
def expr_inline_template(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.withColumn("s0", F.to_variant_object(F.struct("c_name", "n_name")))
    value, _ = ex.string_template("To: .[0].c_name (.[0].n_name)", ex.Slots([F.col("s0")]))
    return rows.select("c_custkey", value.cast("string").alias("text"))


def _turns(spark, sf_dir):
    """``conv_id, v``: each conversation as one document with its turns in order, an empty object and a null."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("turns")
    )
    roles = F.to_json(F.transform("turns", lambda t: F.struct(t["role"].alias("role"))))
    return turns.select("conv_id", F.parse_json(F.concat(F.lit('{"turns":'), roles, F.lit(',"meta":{},"note":null}'))).alias("v"))


_TURNS = (
    "select conv_id, row_number() over (partition by conv_id order by turn, role) - 1 as i, '{\"role\":\"' || role || '\"}' as item, role from conversations"
)


@_query(
    "json_flatten",
    f"with t as ({_TURNS}), a as (select conv_id, '[' || string_agg(item, ',' order by i) || ']' as items from t group by 1)"
    " select conv_id, '.[0].turns[' || i || '].role' as path, '\"' || role || '\"' as node from t"
    " union all select conv_id, '.[0].turns[' || i || ']', item from t union all select conv_id, '.[0].turns', items from a"
    " union all select conv_id, '.[0].meta', '{}' from a union all select conv_id, '.[0].note', 'null' from a"
    " union all select conv_id, '.[0]', '{\"meta\":{},\"note\":null,\"turns\":' || items || '}' from a",
)
def json_flatten(spark, sf_dir):
    return records.flatten_json(_turns(spark, sf_dir), "v", ["conv_id"])


@_query(
    "json_flatten_deep",
    "with d as (select event_id, event_id % 12 as n from events)"
    " select event_id, '.[0]' || repeat('.a', i) as path, repeat('{\"a\":', (n - i)::integer) || event_id || repeat('}', (n - i)::integer) as node"
    " from (select event_id, n, unnest(range(0, (n + 1)::integer))::integer as i from d)",
)
def json_flatten_deep(spark, sf_dir):
    n = (F.col("event_id") % 12).cast("int")
    text = F.concat(F.repeat(F.lit('{"a":'), n), F.col("event_id").cast("string"), F.repeat(F.lit("}"), n))
    rows = table(spark, sf_dir, "events").select("event_id", F.parse_json(text).alias("v"))
    return records.flatten_json(rows, "v", ["event_id"])


@_query(
    "json_unflatten",
    f"with t as ({_TURNS}) select conv_id, '{{\"meta\":{{}},\"note\":null,\"turns\":[' || string_agg(item, ',' order by i) || ']}}' as value from t group by 1",
)
def json_unflatten(spark, sf_dir):
    nodes = records.flatten_json(_turns(spark, sf_dir), "v", ["conv_id"])
    return records.unflatten(nodes, ["conv_id"]).select("conv_id", F.to_json("value").alias("value"))


@_query(
    "headers_flatten",
    "with h as (select page_id, unnest(['x-tag', 'accept', 'x-tag', 'x-tag']) as name, unnest(['.0', '.0', '.1', '.2']) as k,"
    " unnest([page_id::varchar, 'json', 'b', 'c']) as value from pages)"
    " select page_id, '.[0].' || g || '.' || name || case when k = '.0' then '' else k end as path, value from h, (values ('headers'), ('header')) as t(g)",
)
def headers_flatten(spark, sf_dir):
    pair = lambda k, v: F.struct(F.lit(k).alias("name"), v.alias("value"))
    pairs = F.array(
        pair("X-Tag", F.col("page_id").cast("string")), pair(" Accept", F.lit("json")), pair("x-tag ", F.lit("b")), pair("X-TAG", F.lit("c"))
    )
    flat = table(spark, sf_dir, "pages").select("page_id", records.flatten_headers(pairs).alias("m"))
    return flat.select("page_id", F.explode("m").alias("path", "value"))


def _headers(distinct: bool):
    def run(spark, sf_dir):
        rows = table(spark, sf_dir, "events").groupBy("user_id").agg(
            F.array_sort(F.collect_list(F.struct("event_id", F.col("event_type").alias("value")))).alias("pairs")
        )
        pairs = F.transform("pairs", lambda p: F.struct(scalars.header_name(F.lit("X-Kind")).alias("key"), p["value"].alias("value")))
        return rows.select("user_id", F.array_join(scalars.merged_values(pairs, distinct)["x_kind"], ",").alias("merged"))

    return run


_query(
    "headers_merge_list",
    "select user_id, string_agg(event_type, ',' order by event_id) as merged from events group by 1",
)(_headers(False))
_query(
    "headers_merge_dedupe",
    "select user_id, string_agg(event_type, ',' order by first) as merged from (select user_id, event_type, min(event_id) as first from events group by 1, 2) group by 1",
)(_headers(True))


@_query(
    "query_string_parse",
    "select page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') as page, nullif(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1), '') as source from pages",
)
def query_string_parse(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("q", F.regexp_extract("url", r"\?([^#]*)", 1))
    merged = scalars.merged_values(scalars.query_pairs("q"))
    return pages.select("page_id", merged["page"][0].alias("page"), merged["utm_source"][0].alias("source"))


@_query(
    "path_normalise",
    "select p_partkey, '/' || trim(p_type) as path, '/' as root from part",
)
def path_normalise(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", scalars.normalise_path(F.concat(F.lit(" "), "p_type")).alias("path"), scalars.normalise_path(F.lit(" ")).alias("root")
    )


@_query(
    "label_bound",
    "select p_partkey, left(p_name || p_brand || p_type || p_name, 40) as label from part where strlen(p_name || p_brand || p_type || p_name) > 40"
    " union all select p_partkey, p_name || p_brand || p_type || p_name from part where strlen(p_name || p_brand || p_type || p_name) <= 40",
)
def label_bound(spark, sf_dir):
    full = F.concat("p_name", "p_brand", "p_type", "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", scalars.bound_label(full).alias("label"))


@_query(
    "endpoint_name_short",
    "select c_custkey, case when length(e) <= 36 then e else left(e, 31) || '-' || left(md5(e), 4) end as id"
    " from (select c_custkey, 'endpoint.' || c_name || c_mktsegment as e from customer)",
)
def endpoint_name_short(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.endpoint_id(F.concat("c_name", "c_mktsegment")).alias("id"))


@_query(
    "identifier_quote",
    "select s_suppkey, case when regexp_full_match(s_name, '[A-Za-z0-9_$]+') then '`db`.`' || s_name || '`' end as quoted from supplier",
)
def identifier_quote(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", scalars.quote_identifier(F.concat(F.lit("db."), "s_name")).alias("quoted"))


@_query(
    "recipients_split",
    "select c_custkey, trim(c_name) || '|desk@example.org' as people, cast(2 as bigint) as n from customer",
)
def recipients_split(spark, sf_dir):
    people = scalars.recipients(F.concat(F.col("c_name"), F.lit(" ,; desk@example.org;")))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.array_join(people, "|").alias("people"), F.size(people).cast("long").alias("n")
    )


@_query(
    "parse_binary",
    "select event_id, to_base64(encode(props)) as b64, props as text, cast(json_extract_string(props, '$.k') as bigint) as k from events",
)
def parse_binary(spark, sf_dir):
    view = scalars.bytes_view(F.col("props").cast("binary"))
    return table(spark, sf_dir, "events").select(
        "event_id", view["base64"].alias("b64"), view["text"].alias("text"), F.try_variant_get(view["json"], "$.k", "long").alias("k")
    )


@_query(
    "payload_envelope_json",
    "select event_id, 'json' as codec, 'application/json' as content_type, to_base64(encode(props)) as body, cast(strlen(props) as bigint) as length from events",
)
def payload_envelope_json(spark, sf_dir):
    e = envelope.encode(F.col("props"), "json")
    return table(spark, sf_dir, "events").select("event_id", e["codec"].alias("codec"), e["content_type"].alias("content_type"), e["binary"].alias("body"), e["length"].alias("length"))


def _encoded(codec: str, options: dict):
    def run(spark, sf_dir):
        rows = table(spark, sf_dir, "events").select(
            "event_id", F.to_json(F.struct(F.col("event_type").alias("topic"), (F.col("event_id") % 3).cast("int").alias("qos"))).alias("v")
        )
        e = envelope.encode(F.col("v"), codec, options)
        return rows.select("event_id", e["binary"].alias("body"), e["length"].alias("length"))

    return run


_FIELDS = {"topic": {"number": 1, "type": "string"}, "qos": {"number": 2, "type": "int64"}}
_SCHEMA = {"type": "record", "name": "Reading", "fields": [{"name": "topic", "type": "string"}, {"name": "qos", "type": "int"}]}
_query(
    "encode_protobuf",
    "select event_id, to_base64(b) as body, cast(octet_length(b) as bigint) as length from (select event_id, "
    "unhex('0a' || printf('%02x', strlen(event_type)) || hex(encode(event_type)) || case when event_id % 3 = 0 then '' else '10' || printf('%02x', event_id % 3) end) as b from events)",
)(_encoded("protobuf", {"fields": _FIELDS}))
_query(
    "encode_avro_registry",
    "select event_id, to_base64(b) as body, cast(octet_length(b) as bigint) as length from (select event_id, "
    "unhex('0000000007' || printf('%02x', 2 * strlen(event_type)) || hex(encode(event_type)) || printf('%02x', 2 * (event_id % 3))) as b from events)",
)(_encoded("avro", {"schema": _SCHEMA, "schema_id": 7}))
_query(
    "encode_cbor",
    "select event_id, to_base64(b) as body, cast(octet_length(b) as bigint) as length from (select event_id, "
    "unhex('a265746f706963' || printf('%02x', 96 + strlen(event_type)) || hex(encode(event_type)) || '63716f73' || printf('%02x', event_id % 3)) as b from events)",
)(_encoded("cbor", {}))


@_query(
    "payload_bytes",
    "select event_id, hex(case event_id % 4 when 0 then encode(event_type) when 1 then encode(event_type) when 3 then encode('{\"k\":1}') end) as body from events",
)
def payload_bytes(spark, sf_dir):
    packed = F.to_json(F.struct(F.lit("json").alias("codec"), F.base64(F.col("event_type").cast("binary")).alias("binary")))
    texts = F.array(packed, F.concat(F.lit('"'), "event_type", F.lit('"')), F.lit("null"), F.lit('{"k":1}'))
    v = F.parse_json(F.element_at(texts, (F.col("event_id") % 4 + 1).cast("int")))
    return table(spark, sf_dir, "events").select("event_id", F.hex(scalars.payload_bytes(v)).alias("body"))


@_query(
    "envelope_decode",
    "select event_id, case when event_id % 2 = 0 then props end as text from events",
)
def envelope_decode(spark, sf_dir):
    e = envelope.encode(F.col("props"), "json")
    v = F.to_variant_object(F.when(F.col("event_id") % 2 == 0, e).otherwise(e.withField("codec", F.lit("none"))))
    return table(spark, sf_dir, "events").select("event_id", envelope.decode(v).cast("string").alias("text"))


@_query(
    "qos_coerce",
    "select l_orderkey, l_linenumber, case when l_linenumber between 0 and 2 then l_linenumber end as qos from lineitem",
)
def qos_coerce(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scalars.qos(F.col("l_linenumber").cast("string")).alias("qos"))


@_query(
    "retain_coerce",
    "select event_id, case event_id % 10 when 0 then true when 1 then true when 2 then true when 3 then false when 4 then false"
    " when 6 then false when 7 then true when 8 then false when 9 then true end as retain from events",
)
def retain_coerce(spark, sf_dir):
    values = ('"Yes"', '"on"', '"1"', '"0"', '"off"', '"2.5"', "2.5", "7", "null", "true")
    texts = F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % 10 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", scalars.retain(F.parse_json(texts)).alias("retain"))


@_query(
    "mqtt_payload_bytes",
    "select event_id, hex(case event_id % 6 when 0 then encode('') when 1 then encode(event_type) when 2 then encode(event_type || '!')"
    " when 3 then unhex('00ff07') when 5 then encode('{\"k\":1}') end) as body from events",
)
def mqtt_payload_bytes(spark, sf_dir):
    kind = F.col("event_type")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    texts = F.array(
        F.lit("null"), quoted(F.base64(kind.cast("binary"))), quoted(F.concat(kind, F.lit("!"))), F.lit("[0,255,7]"), F.lit("[1,256]"), F.lit('{"k":1}')
    )
    v = F.parse_json(F.element_at(texts, (F.col("event_id") % 6 + 1).cast("int")))
    return table(spark, sf_dir, "events").select("event_id", F.hex(scalars.mqtt_bytes(v)).alias("body"))


@_query(
    "body_decode",
    "select event_id, case event_id % 4 when 0 then 'null' when 1 then props when 2 then '\"' || event_type || ' plain\"' else '\"/w==\"' end as body from events",
)
def body_decode(spark, sf_dir):
    kind = F.col("event_id") % 4
    raw = (
        F.when(kind == 0, F.lit(b"")).when(kind == 1, F.regexp_replace("props", " ", "").cast("binary"))
        .when(kind == 2, F.concat("event_type", F.lit(" plain")).cast("binary")).otherwise(F.lit(b"\xff"))
    )
    spaced = F.regexp_replace(F.to_json(scalars.decode_body(raw)), '^\\{"k":', '{"k": ')
    return table(spark, sf_dir, "events").select("event_id", spaced.alias("body"))


@_query(
    "timeout_parse",
    "select n_nationkey, cast(n_nationkey * 61000 as bigint) as ms, cast(n_nationkey as bigint) as plain, n_nationkey::bigint * 604800000 as weeks,"
    " n_nationkey::bigint * 3600000 + 5 as mixed, n_nationkey::bigint * 2630016000 as months, cast(null as bigint) as wrong from nation",
)
def timeout_parse(spark, sf_dir):
    n = F.col("n_nationkey").cast("string")
    text = lambda *parts: scalars.timeout_ms(F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)))
    return table(spark, sf_dir, "nation").select(
        "n_nationkey", text(n, "m ", n, "s").alias("ms"), text(n).alias("plain"), text(n, " weeks").alias("weeks"),
        text(" ", n, "hours 5msec ").alias("mixed"), text(n, "months").alias("months"), text(n, " fortnights").alias("wrong"),
    )


@_query(
    "failure_reason_classify",
    "select event_id, case event_type when 'click' then 'timeout' when 'view' then 'protocol' when 'error' then 'panic' else 'unknown' end as reason from events",
)
def failure_reason_classify(spark, sf_dir):
    type_is = lambda name: F.col("event_type") == name
    kind = F.when(type_is("view"), "http_status").when(type_is("error"), "join").when(type_is("signup"), "io").otherwise("message")
    message = F.when(type_is("click"), "request Timed Out").when(type_is("signup"), "timeout").otherwise("bad protocol status, panicked")
    return table(spark, sf_dir, "events").select("event_id", scalars.failure_reason(kind, message).alias("reason"))


@_query(
    "rpc_split",
    "select n_nationkey, case when n_nationkey % 2 = 0 then n_name end as service, case when n_nationkey % 2 = 0 then 'Get' end as method from nation",
)
def rpc_split(spark, sf_dir):
    text = F.when(F.col("n_nationkey") % 2 == 0, F.concat("n_name", F.lit("/Get"))).otherwise(F.concat("n_name", F.lit("/ ")))
    parts = scalars.rpc_parts(text)
    return table(spark, sf_dir, "nation").select("n_nationkey", parts["service"].alias("service"), parts["method"].alias("method"))


@_query(
    "names_and_logs",
    "select p_partkey, regexp_replace(p_type || ' #1', '[^A-Za-z0-9._-]', '_', 'g') as file, '\"' || p_type || ' #1\"' as field, 'http://h.example/' || p_partkey as url,"
    " 'http://h.example/a/' || p_partkey || '?q=1' as joined, 'http://h.example/c' as climbed, 'https://o.example/x' as absolute from part",
)
def names_and_logs(spark, sf_dir):
    text = F.concat("p_type", F.lit(" #1"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", scalars.file_name(text).alias("file"), scalars.log_value(text).alias("field"),
        scalars.resolve_url(F.lit("http://h.example/a/"), F.concat(F.lit("/"), "p_partkey")).alias("url"),
        scalars.resolve_url(F.lit("http://h.example/a/b?z"), F.concat("p_partkey", F.lit("?q=1"))).alias("joined"),
        scalars.resolve_url(F.lit("http://h.example/a/b/d"), F.lit("../../c")).alias("climbed"),
        scalars.resolve_url(F.lit("http://h.example"), F.lit("https://o.example/x")).alias("absolute"),
    )


@_query(
    "envelope_http",
    "select page_id, 'GET' as method, coalesce(nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), ''), '') as page, 't-' || page_id as trace, 'a' as first_tag from pages",
)
def envelope_http(spark, sf_dir):
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    headers = F.array(
        pair("Trace-Id", F.concat(F.lit("t-"), "page_id")), pair("X-Tag", F.lit("a")), pair("x-tag", F.lit("b"))
    )
    v = envelopes.http(
        F.lit("GET"), F.lit("/p"), headers, F.regexp_extract("url", r"\?([^#]*)", 1), F.lit("{}"), F.lit("2024-01-01T00:00:00Z")
    )
    rows = table(spark, sf_dir, "pages").withColumn("v", v)
    return rows.select(
        "page_id", F.try_variant_get("v", "$.request.method", "string").alias("method"),
        F.coalesce(F.try_variant_get("v", "$.query.page", "string"), F.lit("")).alias("page"),
        F.try_variant_get("v", "$.headers.trace_id", "string").alias("trace"),
        F.try_variant_get("v", "$.header.x_tag[0]", "string").alias("first_tag"),
    )


@_query(
    "envelope_kafka",
    "select event_id, user_id % 4 as part, cast(json_extract_string(props, '$.k') as bigint) as k, to_base64(encode(cast(user_id as varchar))) as key64, event_type as kind from events",
)
def envelope_kafka(spark, sf_dir):
    value = F.concat(F.lit('{"body":'), "props", F.lit("}"))
    headers = F.array(*(F.struct(F.lit("Kind").alias("key"), F.col("event_type").cast("binary").alias("value")) for _ in range(2)))
    v = envelopes.kafka(
        F.lit("events"), F.col("user_id") % 4, F.col("event_id"), F.unix_millis(F.col("ts").cast("timestamp")),
        F.col("user_id").cast("string").cast("binary"), value.cast("binary"), headers,
    )
    rows = table(spark, sf_dir, "events").withColumn("v", v)
    return rows.select(
        "event_id", F.try_variant_get("v", "$.partition", "long").alias("part"), F.try_variant_get("v", "$.body.k", "long").alias("k"),
        F.try_variant_get("v", "$.key.base64", "string").alias("key64"), F.try_variant_get("v", "$.headers.kind", "string").alias("kind"),
    )


@_query(
    "envelope_brokers",
    "select event_id, 'alerts.' || event_type as routing_key, cast(json_extract_string(props, '$.k') as bigint) as body_k, props as mqtt_text, event_type as channel, cast(event_id as bigint) as stamp from events",
)
def envelope_brokers(spark, sf_dir):
    raw = F.col("props").cast("binary")
    rows = table(spark, sf_dir, "events").withColumns({
        "rabbit": envelopes.rabbitmq(raw, F.lit("alerts"), F.concat(F.lit("alerts."), "event_type"), F.col("event_id"), F.lit(False), F.lit(0)),
        "mqtt": envelopes.mqtt(F.col("event_type"), raw, F.lit(1), F.lit(True), F.lit(9)),
        "pubsub": envelopes.redis_pubsub(F.col("event_type"), raw, F.lit(0)),
        "stream": envelopes.redis_stream(
            F.lit("s"), F.lit("1-0"),
            F.create_map(F.lit("payload"), raw, F.lit("timestamp"), F.col("event_id").cast("string").cast("binary"), F.lit("a"), raw), F.lit(0),
        ),
    })
    return rows.select(
        "event_id", F.try_variant_get("rabbit", "$.routing_key", "string").alias("routing_key"),
        F.try_variant_get("rabbit", "$.body.json.k", "long").alias("body_k"), F.try_variant_get("mqtt", "$.payload.text", "string").alias("mqtt_text"),
        F.try_variant_get("pubsub", "$.channel", "string").alias("channel"), F.try_variant_get("stream", "$.metadata.timestamp", "long").alias("stamp"),
    )


@_query(
    "envelope_mongo_cdc",
    "select o_orderkey, 'insert' as operation, 'orders' as coll, o_orderstatus as status, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') as wall from orders",
)
def envelope_mongo_cdc(spark, sf_dir):
    v = envelopes.mongodb(
        F.lit("insert"), F.lit("shop"), F.lit("orders"), F.col("o_orderkey"), F.to_json(F.struct("o_orderstatus")), F.col("o_orderdate")
    )
    rows = table(spark, sf_dir, "orders").withColumn("v", v)
    return rows.select(
        "o_orderkey", F.try_variant_get("v", "$.operationType", "string").alias("operation"), F.try_variant_get("v", "$.ns.coll", "string").alias("coll"),
        F.try_variant_get("v", "$.fullDocument.o_orderstatus", "string").alias("status"), F.try_variant_get("v", "$.metadata.wallTime", "string").alias("wall"),
    )


@_query(
    "packet_ids",
    "select event_id, cast((row_number() over (partition by event_type order by event_id) - 1 + 65530) % 65535 + 1 as integer) as packet from events",
)
def packet_ids(spark, sf_dir):
    rows = records.number_in_order(table(spark, sf_dir, "events"), "event_type", "event_id", "n")
    return rows.select("event_id", scalars.packet_id(F.col("n") + 65530).alias("packet"))


@_query(
    "retry_after_hint",
    "select n_nationkey, cast(greatest(1, ceil(least(n_nationkey * 700, 5000, 30000) / 1000.0)) as bigint) as seconds, 1::bigint as unset,"
    " cast(greatest(1, ceil(least(n_nationkey * 700, case when n_nationkey % 2 = 0 then 2100 else 1e9 end) / 1000.0)) as bigint) as half from nation",
)
def retry_after_hint(spark, sf_dir):
    base, none = F.col("n_nationkey") * 700, F.lit(None).cast("long")
    most = F.when(F.col("n_nationkey") % 2 == 0, 2100)
    return table(spark, sf_dir, "nation").select(
        "n_nationkey", scalars.retry_after(base, F.lit(5000), F.lit(30000)).alias("seconds"),
        scalars.retry_after(none, F.lit(5000), none).alias("unset"), scalars.retry_after(base, most, none).alias("half"),
    )


@_query(
    "backoff_curves",
    "select n_nationkey, cast(least(50 * pow(2, least(n_nationkey, 16)), 5000) as bigint) as delivery, cast(greatest(50, least(round(200 * pow(2.0, n_nationkey)), 5000)) as bigint) as poll,"
    " cast(least(250 * pow(2, least(n_nationkey, 8)), 60000) as bigint) as warmup, n_nationkey * 50.0::double as low, n_nationkey * 75.0::double as middle, n_nationkey * 100.0::double as high from nation",
)
def backoff_curves(spark, sf_dir):
    k, delay = F.col("n_nationkey") + 1, F.col("n_nationkey") * 100
    low, high = scalars.jitter_bounds(delay, "equal")
    return table(spark, sf_dir, "nation").select(
        "n_nationkey", scalars.delivery_backoff(k, F.lit(50), F.lit(5000)).alias("delivery"), scalars.trigger_backoff(k).alias("poll"),
        scalars.delivery_backoff(k, F.lit(250), F.lit(60000), doublings=8).alias("warmup"),
        low.alias("low"), scalars.jittered(delay, "equal", F.lit(0.5)).alias("middle"), high.alias("high"),
    )


@_query(
    "error_codes",
    "select event_id, case event_id % 6 when 0 then 'MISSING_KEY' when 1 then 'LIMITS_ENFORCED' when 2 then 'BUDGET_EXHAUSTED' when 3 then 'INTERNAL' when 4 then 'CONNECTOR_FAILURE' end as code,"
    " cast(case event_id % 6 when 0 then 400 when 1 then 429 when 2 then 503 when 3 then 500 when 4 then 502 else 202 end as integer) as status from events",
)
def error_codes(spark, sf_dir):
    kinds = F.array(*map(F.lit, ("MissingPath", "RouteBackpressure", "RetryBudgetExhausted", "Serialization", "ActionFailed", None)))
    code = errors.canonical_code(F.element_at(kinds, (F.col("event_id") % 6 + 1).cast("int")))
    rows = table(spark, sf_dir, "events").select("event_id", code.alias("code"))
    return rows.withColumn("status", scalars.http_status("code"))


@_query(
    "request_admittance",
    "select page_id, case page_id % 5 when 0 then 'ROUTE_UNKNOWN' when 1 then 'METHOD_MISMATCH' when 2 then 'MISSING_KEY' when 3 then 'PAYLOAD_TOO_LARGE' end as refused from pages",
)
def request_admittance(spark, sf_dir):
    kind = F.col("page_id") % 5
    path, method = F.when(kind == 0, "/elsewhere").otherwise(" parcels"), F.when(kind == 1, "GET").otherwise("post")
    body = F.when(kind == 2, "{broken").when(kind == 3, F.repeat(F.lit("1"), 101)).otherwise('{"a":1}')
    refused = envelopes.http_error(method, path, body, F.lit("application/json"), "POST", "/parcels", most_bytes=100)
    return table(spark, sf_dir, "pages").select("page_id", refused.alias("refused"))


@_query(
    "phase_records",
    "select event_id, case when event_id % 3 <> 0 then 'p' || user_id end as phase, case when event_id % 3 = 1 then cast(json_extract_string(props, '$.k') as bigint) end as k,"
    " case when event_id % 3 <> 1 then 'InvalidInput' end as error from events",
)
def phase_records(spark, sf_dir):
    kind = F.col("event_id") % 3
    named = F.concat(F.lit('{"phase_id":"p'), F.col("user_id").cast("string"), F.lit('"'))
    text = F.when(kind == 0, "no json").when(kind == 1, F.concat(named, F.lit(',"payload":'), "props", F.lit("}"))).otherwise(F.concat(named, F.lit("}")))
    record = envelopes.phase_record(text.cast("binary"))
    rows = table(spark, sf_dir, "events").select("event_id", record.alias("r"))
    return rows.select("event_id", F.col("r.phase_id").alias("phase"), F.try_variant_get("r.payload", "$.k", "long").alias("k"), F.col("r.error").alias("error"))


def _handled(spark, sf_dir, kind, options, connector):
    rows = table(spark, sf_dir, "events").select("event_id", F.parse_json(F.to_json(F.struct("event_id", "event_type", "user_id"))).alias("s0"))
    planned = handlers.handle(Phase("own", kind, options, connector), ex.Slots([F.col("s0")], F.col("event_id")), Registry(document().connectors))
    return rows.select("event_id", planned.slot.alias("slot"), planned.error.alias("error"))


@_query(
    "handler_kafka_mqtt",
    "select event_id, 'lane.' || event_type as topic, cast(user_id as varchar) as key, 2 as brokers, '1' as acks, 'scales/' || event_type as mqtt_topic,"
    " 'mqtt://scale.example' as url, cast(((event_id - 1) % 65535 + 65535) % 65535 + 1 as integer) as packet, false as has_status from events",
)
def handler_kafka_mqtt(spark, sf_dir):
    kafka = _handled(spark, sf_dir, "kafka_producer", {"topic": "lane. .[0].event_type", "key": "$.[0].user_id", "acks": "1", "header": {"x": "y"}}, "belt")
    mqtt = _handled(spark, sf_dir, "mqtt", {"topic": "scales/ .[0].event_type", "qos": 2}, "scale").withColumnRenamed("slot", "m").drop("error")
    get = F.try_variant_get
    return kafka.join(mqtt, "event_id").select(
        "event_id", F.replace(get("slot", "$.topic", "string"), F.lit(" "), F.lit("")).alias("topic"), get("slot", "$.key", "string").alias("key"),
        F.size(get("slot", "$.brokers", "array<string>")).alias("brokers"), get("slot", "$.acks", "string").alias("acks"),
        F.replace(get("m", "$.topic", "string"), F.lit(" "), F.lit("")).alias("mqtt_topic"), get("m", "$.url", "string").alias("url"),
        get("m", "$.packet_id", "int").alias("packet"), get("m", "$.status", "variant").isNotNull().alias("has_status"),
    )


@_query(
    "handler_postgres_http",
    "select event_id, 'weights' as schema, user_id as parameter, 'http://customs.example/api/look/' || event_id as url, 'parcels' as desk from events",
)
def handler_postgres_http(spark, sf_dir):
    insert = _handled(spark, sf_dir, "postgres_idempotent_insert", {"sql": "insert into w values (:u)", "values": {"u": ".[0].user_id"}}, "ledger")
    call = _handled(spark, sf_dir, "http_client", {"path": "look/ .[0].event_id", "header": {"x-own": "1"}}, "customs").withColumnRenamed("slot", "c").drop("error")
    get = F.try_variant_get
    return insert.join(call, "event_id").select(
        "event_id", get("slot", "$.schema", "string").alias("schema"), get("slot", "$.parameters.u", "long").alias("parameter"),
        F.replace(get("c", "$.url", "string"), F.lit(" "), F.lit("")).alias("url"), get("c", "$.header.x-desk", "string").alias("desk"),
    )


def _echo(requests):
    """A transport without a network: every third parcel is refused."""
    out = []
    for r in requests:
        number = int(r["url"].rsplit("/", 1)[1])
        out.append({"status": 503 if number % 3 == 0 else 200, "header": {"etag": [str(number)]}, "body": {"twice": 2 * number}})
    return out


@_query(
    "handler_http_call",
    "select event_id, case when event_id % 3 <> 0 then 200 end as status, case when event_id % 3 <> 0 then event_id * 2 end as twice,"
    " case when event_id % 3 = 0 then 'Transport' end as error from events",
)
def handler_http_call(spark, sf_dir):
    url = F.concat(F.lit("http://customs.example/look/"), F.col("event_id").cast("string"))
    request = F.to_variant_object(F.struct(F.lit("GET").alias("method"), url.alias("url")))
    called = handlers.http_call(table(spark, sf_dir, "events").select("event_id", request.alias("request")), "request", _echo)
    return called.select(
        "event_id", F.try_variant_get("response", "$.status", "int").alias("status"),
        F.try_variant_get("response", "$.body.twice", "long").alias("twice"), "error",
    )
