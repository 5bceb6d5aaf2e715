"""Queries over keyed effects, delivery and health."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirflow.functions import scalars
from weirflow.operators import delivery, health, records
from weirflow.queries.document import document, table

QUERIES: dict = {}
ORACLES: dict = {}


def _query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


@_query(
    "upsert_last_wins",
    "select o_custkey, o_orderkey, o_orderstatus from orders qualify row_number() over (partition by o_custkey order by o_orderkey desc) = 1",
)
def upsert_last_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return records.upsert_last(rows, ["o_custkey"], ["o_orderkey"])


@_query(
    "first_seen_insert",
    "select event_id, user_id, r = 1 as inserted, cast(case when r = 1 then 1 else 0 end as integer) as count from (select *, row_number() over (partition by user_id order by event_id) as r from events)",
)
def first_seen_insert(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id")
    return records.first_seen(rows, ["user_id"], ["event_id"]).select("event_id", "user_id", "inserted", "count")


@_query(
    "upsert_nested_doc_update",
    "select c_custkey, c_name, o as last_order from customer left join (select o_custkey, max(o_orderkey) as o from orders group by 1) on c_custkey = o_custkey",
)
def upsert_nested_doc_update(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("last_order"))
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.lit(None).cast("long").alias("last_order"))
    return records.update_rows(base, orders, ["c_custkey"]).select("c_custkey", "c_name", "last_order")


@_query(
    "doc_insert_replace_delete",
    "select o_orderkey, case when o_orderkey % 5 = 0 then 'R' else o_orderstatus end as o_orderstatus from orders where o_orderkey % 7 <> 0"
    " union all select -o_orderkey, 'N' from orders where o_orderkey % 11 = 0",
)
def doc_insert_replace_delete(spark, sf_dir):
    base = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    changed = base.where("o_orderkey % 5 = 0").withColumn("o_orderstatus", F.lit("R"))
    unknown = base.where("o_orderkey % 5 = 0").select((F.col("o_orderkey") * 1000000007).alias("o_orderkey"), F.lit("X").alias("o_orderstatus"))
    out = records.replace_rows(base, changed.union(unknown), ["o_orderkey"])
    out = records.delete_rows(out, base.where("o_orderkey % 7 = 0"), ["o_orderkey"])
    return records.insert_rows(out, base.where("o_orderkey % 11 = 0").select((-F.col("o_orderkey")).alias("o_orderkey"), F.lit("N").alias("o_orderstatus")))


@_query(
    "doc_pipeline_group_sort_limit",
    "select l_suppkey as supplier, count(*) as n, max(l_quantity) as most from lineitem where l_quantity >= 10 group by 1 order by n desc, supplier limit 5",
)
def doc_pipeline_group_sort_limit(spark, sf_dir):
    return records.pipeline(
        table(spark, sf_dir, "lineitem"),
        [
            {"$match": {"l_quantity": {"$gte": 10}}},
            {"$group": {"_id": {"supplier": "$l_suppkey"}, "n": {"$count": {}}, "most": {"$max": "$l_quantity"}}},
            {"$sort": {"n": -1, "supplier": 1}},
            {"$limit": 5},
        ],
    )


@_query(
    "kv_set_ttl",
    "select user_id as key, event_type as value from events qualify row_number() over (partition by user_id order by event_id desc) = 1 and event_id % 3 <> 0",
)
def kv_set_ttl(spark, sf_dir):
    writes = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("seq"),
        F.when(F.col("event_id") % 3 == 0, 100).when(F.col("event_id") % 3 == 1, 300).alias("expires"),
    )
    return records.key_values(writes, F.lit(200)).select("key", "value")


@_query(
    "kv_hset",
    "select user_id as key, event_type as field, arg_max(event_id, event_id) as value from events group by 1, 2",
)
def kv_hset(spark, sf_dir):
    writes = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("key"), F.col("event_type").alias("field"), F.col("event_id").alias("value"), F.col("event_id").alias("seq")
    )
    return records.hash_fields(writes)


_CHILDREN = (
    "select o_orderkey as event, c, case when (o_orderkey * c) % 9 = 8 then 'timeout' when (o_orderkey + c) % 4 = 0 and c = 2 then 'skipped'"
    " when (o_orderkey + c) % 4 = 0 then 'failed' else 'success' end as status from orders, (values (0), (1), (2)) as t(c)"
)


def _children(spark, sf_dir):
    """Three children of each order; the last one is optional, so its failure is skipped."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("c"))
    late, failed = (F.col("event") * F.col("c")) % 9 == 8, (F.col("event") + F.col("c")) % 4 == 0
    return rows.withColumn("status", delivery.child_status(failed, late, F.col("c") == 2))


_query("fanout_children", f"select event, cast(c as integer) as c, status from ({_CHILDREN})")(_children)


@_query(
    "fanout_quorum_all_any",
    f"select event, count(*) filter (where status = 'success') as successes, count(*) filter (where status = 'success') >= 2 as quorum,"
    f" count(*) filter (where status = 'success') >= count(*) filter (where status <> 'skipped') as every,"
    f" count(*) filter (where status = 'success') >= least(1, count(*) filter (where status <> 'skipped')) as some from ({_CHILDREN}) group by event",
)
def fanout_quorum_all_any(spark, sf_dir):
    return delivery.tally(_children(spark, sf_dir)).select("event", "successes", "quorum", "every", "some")


def _actions(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("connector"), (F.col("event_id") % 4 == 0).alias("failed"))


@_query(
    "fallback_dead_letter",
    "select event_id, event_type as connector, case when event_id % 4 <> 0 then 'primary' when event_type in ('click', 'view') then 'replaced' else 'dead_letter' end as delivery from events"
    " union all select event_id, 'spare_' || event_type, 'fallback' from events where event_id % 4 = 0 and event_type in ('click', 'view')",
)
def fallback_dead_letter(spark, sf_dir):
    spare = spark.createDataFrame([("click", "spare_click"), ("view", "spare_view")], "connector string, fallback string")
    return delivery.with_fallback(_actions(spark, sf_dir), spare).select("event_id", "connector", "delivery")


@_query(
    "ordered_dispatch_abort",
    "select l_orderkey, l_linenumber, case when f is null or l_linenumber < f then 'sent' when l_linenumber = f then 'failed' else 'aborted' end as outcome"
    " from (select *, min(case when l_returnflag = 'R' then l_linenumber end) over (partition by l_orderkey) as f from lineitem)",
)
def ordered_dispatch_abort(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").alias("failed"))
    return delivery.ordered_dispatch(rows, "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "outcome")


@_query(
    "retry_schedule",
    "with p as (select s_suppkey as id, case when s_suppkey % 7 <> 0 then s_suppkey % 6 end as retries, case when s_suppkey % 4 <> 0 then 40 + s_suppkey % 3 * 10 end as pmin,"
    " case when s_suppkey % 4 <> 0 then 600 end as pmax, 5 as attempts, case when s_suppkey % 5 <> 0 then 500 end as elapsed,"
    " case when s_suppkey % 3 <> 0 then 50 end as bbase, case when s_suppkey % 2 = 0 then 400 end as bmax from supplier),"
    " q as (select id, elapsed, least(coalesce(retries + 1, attempts), attempts) as n, greatest(coalesce(pmin, bbase, 0), coalesce(bbase, 0)) as base,"
    " case when pmax is not null and bmax is not null then least(pmax, bmax) else coalesce(pmax, bmax) end as most from p),"
    " a as (select id, elapsed, attempt, cast(case when attempt = 1 then 0 else least(base * pow(2, attempt - 2), greatest(coalesce(most, base), base)) end as bigint) as delay_ms"
    " from q, unnest(range(1, n + 1)) as t(attempt)), s as ("
    " select *, cast(sum(delay_ms) over (partition by id order by attempt) as bigint) as start_ms from a)"
    " select id, cast(attempt as integer) as attempt, delay_ms, start_ms from s"
    " where attempt = 1 or elapsed is null or (start_ms - delay_ms < elapsed and elapsed - (start_ms - delay_ms) >= delay_ms)",
)
def retry_schedule(spark, sf_dir):
    key = F.col("s_suppkey")
    plans = table(spark, sf_dir, "supplier").select(
        key.alias("id"), F.when(key % 7 != 0, key % 6).alias("retries"), F.when(key % 4 != 0, 40 + key % 3 * 10).alias("backoff_min"),
        F.when(key % 4 != 0, 600).alias("backoff_max"), F.lit(5).alias("max_attempts"), F.when(key % 5 != 0, 500).alias("max_elapsed"),
        F.when(key % 3 != 0, 50).alias("base_backoff"), F.when(key % 2 == 0, 400).alias("max_backoff"),
    )
    return delivery.retry_schedule(plans)


@_query(
    "retry_budget_merge",
    "select n_regionkey as scope, min(case when n_nationkey % 3 <> 0 then n_nationkey end) as max_attempts, min(n_nationkey * 100) as max_elapsed, max(n_nationkey) as base_backoff, min(n_nationkey + 7) as max_backoff,"
    " case max(n_nationkey % 3) when 2 then 'full' when 1 then 'equal' else 'none' end as jitter from nation group by 1",
)
def retry_budget_merge(spark, sf_dir):
    kinds = F.element_at(F.array(F.lit("none"), F.lit("equal"), F.lit("full")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    budgets = table(spark, sf_dir, "nation").select(
        F.col("n_regionkey").alias("scope"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_nationkey")).alias("max_attempts"),
        (F.col("n_nationkey") * 100).alias("max_elapsed"), F.col("n_nationkey").alias("base_backoff"), (F.col("n_nationkey") + 7).alias("max_backoff"),
        kinds.alias("jitter"),
    )
    return health.merged_budgets(budgets, "scope")


def _attempts(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("route"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), F.col("event_id").alias("seq")
    )


@_query(
    "retry_budget_windows",
    "with recursive a as (select event_type as route, event_id as seq, epoch_us(ts) // 1000 as t, row_number() over (partition by event_type order by epoch_us(ts) // 1000, event_id) as n from events),"
    " f as (select route, seq, t, n, t as began, 1::bigint as used from a where n = 1"
    " union all select a.route, a.seq, a.t, a.n, case when a.t - f.began > 3600000 then a.t else f.began end, case when a.t - f.began > 3600000 then 1 else f.used + 1 end"
    " from f join a on a.route = f.route and a.n = f.n + 1)"
    " select route, seq, used, used > 5 as exhausted from f",
)
def retry_budget_windows(spark, sf_dir):
    return health.budget_windows(_attempts(spark, sf_dir), 5, 3_600_000)


@_query(
    "breaker_failure_ratio",
    "select event_id, round(avg(case when value > 50 then 1.0::double else 0.0::double end) over (partition by event_type order by epoch_us(ts) range between 3600000000 preceding and current row), 6) as failure_ratio from events",
)
def breaker_failure_ratio(spark, sf_dir):
    failed = F.coalesce(F.col("value") > 50, F.lit(False))
    out = health.failure_ratio(table(spark, sf_dir, "events"), "event_type", "ts", failed, 3600)
    # SQL rounds the multiplied double; F.round takes its decimal text, which differs where the seventh place is a lone 5
    rounded = F.floor(F.col("failure_ratio") * 1e6 + 0.5) / 1e6
    return out.select("event_id", rounded.alias("failure_ratio"))


_BREAKER = """
with recursive o as (
  select event_type as endpoint, epoch_us(ts) // 1000 as at_ms, event_id as seq, event_id % 3 <> 0 as ok,
         row_number() over (partition by event_type order by epoch_us(ts) // 1000, event_id) as n from events
), f as (
  select endpoint, 0::bigint as n, 'HEALTHY' as state, 0::bigint as until, 1000::bigint as backoff,
         []::struct(t bigint, ok boolean)[] as log, 0::bigint as at_ms, 0::bigint as seq, true as ok
  from (select distinct endpoint from o)
  union all
  select endpoint, n, next, case when trips then at_ms + backoff else until end,
         case when trips then least(backoff * 2, 60000) when was = 'CB_HALF_OPEN' and next = 'HEALTHY' then 1000 else backoff end,
         case when next = 'HEALTHY' and was <> 'HEALTHY' then [] else seen end, at_ms, seq, ok
  from (
    select *, case when was = 'CB_OPEN' then was when ok then 'HEALTHY' when trips then 'CB_OPEN' else 'UNHEALTHY' end as next
    from (
      select *, not ok and (was = 'CB_HALF_OPEN' or (was <> 'CB_OPEN'
               and len(list_filter(seen, lambda x: not x.ok)) >= 0.4 * len(seen))) as trips
      from (
        select f.endpoint, o.n, f.until, f.backoff, o.at_ms, o.seq, o.ok,
               case when f.state = 'CB_OPEN' and o.at_ms >= f.until then 'CB_HALF_OPEN' else f.state end as was,
               list_append(list_filter(f.log, lambda x: o.at_ms - x.t <= 21600000), {'t': o.at_ms, 'ok': o.ok}) as seen
        from f join o on o.endpoint = f.endpoint and o.n = f.n + 1
      )
    )
  )
)
select endpoint, at_ms, seq, ok, state from f where n > 0
"""


@_query("breaker_state_sequence", _BREAKER)
def breaker_state_sequence(spark, sf_dir):
    rows = _attempts(spark, sf_dir).withColumnRenamed("route", "endpoint").withColumn("ok", F.col("seq") % 3 != 0)
    return health.breaker_states(rows, 0.4, 21_600_000, 1_000, 60_000)


_RANKS = "case s_suppkey % 9 when 0 then 4 when 1 then 3 when 2 then 1 when 3 then 2 else 0 end"


def _endpoints(spark, sf_dir):
    n = F.col("s_suppkey") % 9
    state = F.when(n == 0, "CB_OPEN").when(n == 1, "UNHEALTHY").when(n == 2, "CB_HALF_OPEN").when(n == 3, "WARMING_UP").otherwise("HEALTHY")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("route"), state.alias("state"))


@_query(
    "readiness_endpoint_merge",
    f"select s_nationkey as endpoint, case max({_RANKS}) when 4 then 'CB_OPEN' when 3 then 'UNHEALTHY' when 2 then 'WARMING_UP' when 1 then 'CB_HALF_OPEN' else 'HEALTHY' end as state from supplier group by 1",
)
def readiness_endpoint_merge(spark, sf_dir):
    return health.worst_endpoint(_endpoints(spark, sf_dir).withColumnRenamed("route", "endpoint"), "endpoint")


_ROUTES = (
    f"select s_nationkey as route, case when bool_or({_RANKS} = 2) then 'WARMING_UP' when bool_or({_RANKS} >= 3) and max(s_nationkey) % 2 = 0 then 'DEGRADED'"
    f" when bool_or({_RANKS} >= 3) then 'NOT_READY' when bool_or({_RANKS} = 1) then 'DEGRADED' else 'READY' end as state from supplier group by 1"
)


def _routes(spark, sf_dir):
    return health.route_states(_endpoints(spark, sf_dir), F.col("route") % 2 == 0)


_query("readiness_route_state", _ROUTES)(_routes)


def _app_state(states: str, first: str) -> str:
    """SQL of the application's state of the routes ``r(state, place)``; ``first`` chooses those that a threshold checks."""
    return (
        f"with r as ({states}) select count(*) as n, count(*) filter (where state in ('READY', 'DEGRADED')) as up,"
        " case when count(*) = 0 then 'READY' when count(*) filter (where state = 'DRAINING') > 0 then 'DRAINING'"
        f" when count(*) filter (where {first} and state not in ('READY', 'DEGRADED')) = 0"
        " then case when count(*) filter (where state = 'DEGRADED') > 0 then 'DEGRADED' else 'READY' end"
        " when count(*) filter (where state in ('READY', 'DEGRADED')) = 0 and count(*) filter (where state = 'WARMING_UP') > 0 then 'WARMING_UP'"
        " else 'NOT_READY' end as state from r"
    )


@_query(
    "readiness_app_state_topk",
    _app_state(f"select *, row_number() over (order by route) as place from ({_ROUTES})", "place <= 3"),
)
def readiness_app_state_topk(spark, sf_dir):
    routes = _routes(spark, sf_dir).withColumns({"priority": F.lit(1), "ordinal": F.col("route")})
    return health.app_state(routes, threshold=3)


#: One application for each nation: its customers are the routes, in states that the account decides.
_CUSTOMER_STATE = (
    "case when c_nationkey % 6 = 0 and c_custkey % 2 = 0 then 'WARMING_UP' when c_nationkey % 6 = 1 and c_custkey % 5 = 0 then 'DRAINING'"
    " when c_nationkey % 6 in (2, 3) and c_custkey % 3 = 0 then 'DEGRADED' when c_nationkey % 6 in (0, 3, 4) then 'NOT_READY' else 'READY' end"
)


def _app_query(nation: int, threshold: int | None) -> None:
    name = f"readiness_app_state_{nation}" + ("_all" if threshold is None else "")
    rows = f"select {_CUSTOMER_STATE} as state, row_number() over (order by c_custkey % 4, c_custkey) as place from customer where c_nationkey = {nation}"

    def run(spark, sf_dir):
        routes = table(spark, sf_dir, "customer").where(F.col("c_nationkey") == nation)
        routes = routes.selectExpr("c_custkey as route", f"{_CUSTOMER_STATE} as state", "c_custkey % 4 as priority", "c_custkey as ordinal")
        return health.app_state(routes, threshold)

    _query(name, _app_state(rows, "true" if threshold is None else f"place <= {threshold}"))(run)


for _nation in range(6):
    _app_query(_nation, None)
    _app_query(_nation, 1)


_ROUTE_STATE = "case event_id * 7 % 11 when 0 then 'WARMING_UP' when 1 then 'DEGRADED' when 2 then 'DRAINING' when 3 then 'NOT_READY' when 4 then 'WARMING_UP' when 5 then 'DEGRADED' else 'READY' end"


@_query(
    "transitions_legal",
    f"with s as (select user_id, event_id, {_ROUTE_STATE} as state from events),"
    " t as (select *, lag(state) over (partition by user_id order by event_id) as previous from s)"
    " select user_id, event_id, previous, state, case previous when 'WARMING_UP' then state in ('READY', 'NOT_READY', 'DRAINING')"
    " when 'READY' then state in ('NOT_READY', 'DEGRADED', 'DRAINING') when 'NOT_READY' then state in ('READY', 'DEGRADED', 'DRAINING')"
    " when 'DEGRADED' then state in ('READY', 'NOT_READY', 'DRAINING') else false end as legal from t where previous is not null and previous <> state",
)
def transitions_legal(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("user_id", "event_id", F.expr(_ROUTE_STATE).alias("state"))
    return health.moves_legal(log, "user_id", ["event_id"]).select("user_id", "event_id", "previous", "state", "legal")


@_query(
    "dependency_inference",
    "select l_orderkey as route, array_to_string(list_sort(list_distinct(list(l_suppkey))), ',') as connectors from lineitem group by 1",
)
def dependency_inference(spark, sf_dir):
    phases = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("route"), F.col("l_suppkey").alias("connector"))
    return health.dependencies(phases).select("route", F.array_join("connectors", ",").alias("connectors"))


@_query(
    "requires_expansion",
    "select distinct s_nationkey as route, s_suppkey as connector from supplier union select s_nationkey, s_suppkey + 1000 from supplier where s_suppkey % 2 = 0",
)
def requires_expansion(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier")
    edges = suppliers.select(F.col("s_nationkey").alias("route"), F.col("s_suppkey").alias("connector"))
    requires = suppliers.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("connector"), (F.col("s_suppkey") + 1000).alias("required"))
    return health.expand_requires(edges, requires)


_SPANS = "select o_orderpriority as route, epoch(o_orderdate)::bigint as s, epoch(o_orderdate)::bigint + (o_orderkey % 30 + 1) * 86400 as e from orders"
_MOVES = f"""
with i as ({_SPANS}), m as (select route, s as t, 1 as up, 1 as step from i union all select route, e, 0, -1 from i),
g as (select route, t, cast(sum(up) as bigint) as arrivals, sum(step) as net from m group by 1, 2),
r as (select route, t, arrivals, cast(sum(net) over (partition by route order by t) as bigint) as inflight from g)
"""


def _spans(spark, sf_dir):
    start = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("route"), start.alias("start"), (start + (F.col("o_orderkey") % 30 + 1) * 86400).alias("end")
    )


@_query("admission_inflight", _MOVES + "select route, t as \"at\", arrivals, inflight from r where arrivals > 0")
def admission_inflight(spark, sf_dir):
    return health.in_flight(_spans(spark, sf_dir), "route")


def _admission(queue: int) -> str:
    """SQL of admissions with two places and a queue; a recursion over each route's arrivals."""
    return f"""
with recursive a as (
  select o_orderpriority as route, epoch(o_orderdate)::bigint as t, o_orderkey as seq, (o_orderkey % 30 + 1) * 864 as d,
         row_number() over (partition by o_orderpriority order by epoch(o_orderdate)::bigint, o_orderkey) as n from orders
), f as (
  select route, 0::bigint as n, 0::bigint as seq, 0::bigint as t, 'none' as outcome, cast(null as bigint) as begins, []::bigint[] as ends from (select distinct route from a)
  union all
  select route, n, seq, t, outcome, begins, case when outcome = 'rejected' then open else list_sort(list_append(open, begins + d)) end
  from (
    select *, case when len(open) < 2 then 'admitted' when len(open) < {2 + queue} then 'queued' else 'rejected' end as outcome,
           case when len(open) < 2 then t when len(open) < {2 + queue} then open[len(open) - 1] end as begins
    from (
      select a.route, a.n, a.seq, a.t, a.d, list_filter(f.ends, lambda e: e > a.t) as open from f join a on a.route = f.route and a.n = f.n + 1
    )
  )
)
"""


def _arrivals(spark, sf_dir):
    spans = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("route"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("at"),
        F.col("o_orderkey").alias("seq"), ((F.col("o_orderkey") % 30 + 1) * 864).alias("duration"),
    )
    return spans


@_query("admission_reject", _admission(0) + "select route, seq, outcome, begins from f where n > 0")
def admission_reject(spark, sf_dir):
    return health.admission(_arrivals(spark, sf_dir), 2).select("route", "seq", "outcome", "begins")


@_query(
    "admission_overflow",
    _admission(3) + "select route, seq, outcome, begins, greatest(len(ends) - 2, 0) as waiting from f where n > 0",
)
def admission_overflow(spark, sf_dir):
    return health.admission(_arrivals(spark, sf_dir), 2, 3)


@_query(
    "admission_counters",
    _admission(3) + "select route, count(*) filter (where outcome = 'rejected') as limited, max(greatest(len(ends) - 2, 0)) as queue_depth from f where n > 0 group by route",
)
def admission_counters(spark, sf_dir):
    return health.limit_counters(health.admission(_arrivals(spark, sf_dir), 2, 3))


#: The bounds that the histogram of the service publishes, in seconds.
_BOUNDS = ("0.01", "0.025", "0.05", "0.1", "0.25", "0.5", "1.0", "2.5", "5.0", "10.0")


@_query(
    "http_status_histogram",
    'select event_type, count(*) as count, round(sum(value / 10), 4) as "sum", '
    + ", ".join(f"count(*) filter (where value / 10 <= {b}) as le_{b.replace('.', '_')}" for b in _BOUNDS)
    + " from events group by 1",
)
def http_status_histogram(spark, sf_dir):
    out = health.request_histogram(table(spark, sf_dir, "events"), "event_type", F.col("value") / 10)
    return out.withColumn("sum", F.round("sum", 4))


@_query(
    "http_request_counts",
    "select event_type as route, case when event_id % 7 = 0 then 400 else 202 end as status, count(*) as n from events group by 1, 2",
)
def http_request_counts(spark, sf_dir):
    status = F.when(F.col("event_id") % 7 == 0, 400).otherwise(202)
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("route"), status.alias("status"))
    return health.outcome_counts(rows, ["route", "status"])


@_query(
    "connector_outcomes",
    "select event_type as connector, case when event_id % 4 = 0 then 'failure' else 'success' end as outcome,"
    " case when event_id % 12 = 0 then 'timeout' when event_id % 4 = 0 then 'unknown' else 'none' end as reason, count(*) as n from events group by 1, 2, 3",
)
def connector_outcomes(spark, sf_dir):
    message = F.when(F.col("event_id") % 3 == 0, "Request timed out").otherwise("connection refused")
    reason = F.when(F.col("failed"), scalars.failure_reason(F.lit("message"), message)).otherwise("none")
    outcome = F.when(F.col("failed"), "failure").otherwise("success")
    rows = _actions(spark, sf_dir).withColumns({"outcome": outcome, "reason": reason})
    return health.outcome_counts(rows, ["connector", "outcome", "reason"])


@_query(
    "metric_gauges",
    "select event_type as transport, user_id % 4 as client, arg_max(value, event_id) as value from events group by 1, 2",
)
def metric_gauges(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("transport"), (F.col("user_id") % 4).alias("client"), "value", "event_id"
    )
    return health.last_values(rows, ["transport", "client"], "value", "event_id")


@_query("state_gauges", f"select s_suppkey, {_RANKS} as gauge from supplier")
def state_gauges(spark, sf_dir):
    return health.state_gauge(_endpoints(spark, sf_dir), health.ENDPOINT_RANK).select("s_suppkey", "gauge")


@_query(
    "connector_inventory",
    "select * from (values ('http_server', 1::bigint), ('http_client', 1), ('kafka', 1), ('rabbitmq', 1), ('mqtt', 1), ('mariadb', 1), ('postgres', 1), ('mongodb', 1), ('redis', 1), ('smtp', 1), ('grpc', 1)) as t(kind, n)",
)
def connector_inventory(spark, sf_dir):
    rows = spark.createDataFrame([(c.kind,) for c in document().connectors.values()], "kind string")
    return rows.groupBy("kind").agg(F.count("*").alias("n"))


@_query(
    "route_requires",
    "select * from (values ('accept_parcel', 'belt'), ('announce_parcel', 'desk'), ('declare_parcel', 'customs'), ('file_parcel', 'board,folder,tariff'),"
    " ('inspect_parcel', 'customs,yard'), ('pack_parcel', ''), ('split_parcel', 'belt'), ('store_parcel', 'shelf'), ('watch_scale', 'ledger,scale')) as t(route, connectors)",
)
def route_requires(spark, sf_dir):
    routes = document().routes.values()
    return spark.createDataFrame([(r.name, ",".join(r.requires())) for r in routes], "route string, connectors string")


def _log(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.lit("events").alias("topic"), (F.col("user_id") % 8).alias("partition"), F.col("event_id").alias("offset"),
        (F.col("event_id") % 10 != 0).alias("ok"),
    )


@_query(
    "ack_offsets_committed",
    "select 'events' as topic, user_id % 8 as partition, max(case when event_id % 10 <> 0 then event_id end) as committed, count(*) as seen from events group by 2",
)
def ack_offsets_committed(spark, sf_dir):
    return delivery.committed_offsets(_log(spark, sf_dir))


@_query(
    "ack_gap_report",
    "select 'events' as topic, user_id % 8 as partition, event_id as offset from (select *, max(case when event_id % 10 <> 0 then event_id end) over (partition by user_id % 8) as c from events) where event_id % 10 = 0 and event_id < c",
)
def ack_gap_report(spark, sf_dir):
    return delivery.skipped_records(_log(spark, sf_dir))


@_query(
    "validation_unknown_refs",
    "select o_custkey as name, count(*) as n from orders where o_custkey not in (select c_custkey from customer where c_custkey % 3 <> 0) group by 1",
)
def validation_unknown_refs(spark, sf_dir):
    known = table(spark, sf_dir, "customer").where("c_custkey % 3 != 0").select(F.col("c_custkey").alias("name"))
    used = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("name"))
    return records.unknown_references(used, known, "name")


@_query(
    "endpoint_dependents",
    f"select s_suppkey as endpoint, n_name as route, {_RANKS} as gauge from supplier join nation on n_nationkey = s_nationkey",
)
def endpoint_dependents(spark, sf_dir):
    edges = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"))
    edges = edges.select(F.col("n_name").alias("route"), F.col("s_suppkey").alias("endpoint"))
    states = _endpoints(spark, sf_dir).withColumnRenamed("s_suppkey", "endpoint").select("endpoint", "state")
    return health.state_gauge(health.dependents(states, edges), health.ENDPOINT_RANK).select("endpoint", "route", "gauge")


@_query(
    "enrichment_lookup",
    "select event_id, user_id, c_name as name, case when c_custkey is null then 'MissingPath' end as error from events left join customer on c_custkey = user_id",
)
def enrichment_lookup(spark, sf_dir):
    facts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return records.enrich(table(spark, sf_dir, "events").select("event_id", "user_id"), facts, ["user_id"])
