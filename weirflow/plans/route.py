"""Routes compiled to one projection: slots, actions, response and error as columns.

A compiled route is a function of a DataFrame with the trigger envelope in the
VARIANT column ``s0``; it runs unchanged on batches and on streams. Each phase
adds a slot; an error stops a row's later phases and is carried as data.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.config.loader import Document, Phase, Route
from weirflow.errors import canonical_code
from weirflow.functions import expressions as ex
from weirflow.functions import scalars
from weirflow.operators.phases import Planned, plan_phase

ERROR = "struct<code:string,kind:string,phase:string>"
ACTION = "struct<idx:int,phase:string,kind:string,connector:string,target:string,payload:string,extra:string>"
# Where events carry their trace and record ids, in this order.
_TRACE = ("$.header.trace_id", "$.headers.trace_id", "$.body.trace.trace_id", "$['body.trace.trace_id']")
_RECORD = ("$.body.record.id", "$.body.summary.record_id", "$['body.record_id']")


@dataclass
class CompiledRoute:
    """A route's function; ``columns`` are what it adds to its input."""

    route: Route
    document: Document

    def __call__(self, events: DataFrame) -> DataFrame:
        """``events`` with ``s1..sn, actions, fallback_actions, response, trace_id, record_id, error``."""
        frame = events.withColumn("error", F.lit(None).cast(ERROR))
        slots = ["s0"]
        actions: list[Column] = []
        for phase in self.route.main_phases():
            frame, action = self._phase(frame, phase, slots, actions)
            actions += action
        context = slots[:]
        fallbacks: list[Column] = []
        for number, phase in enumerate(self.route.fallback_phases()):
            # each works on a copy of the final context; only the first one has a previous slot
            planned = plan_phase(phase, ex.Slots([F.col(s) for s in context]), with_previous=number == 0)
            fallbacks += self._actions(phase, planned, len(actions))
        frame = frame.withColumn("actions", self._array(actions))
        frame = frame.withColumn("fallback_actions", self._array(fallbacks))
        last = F.col(slots[-1])
        status = F.try_variant_get(last, "$.status", "int")
        kind = F.try_variant_get(last, "$.contentType", "string")
        response = F.struct(
            status.alias("status"),
            kind.alias("content_type"),
            F.to_json(F.try_variant_get(last, "$.body", "variant")).alias("body"),
        )
        good = F.col("error").isNull()
        first = lambda paths: F.coalesce(*(self._text(p) for p in paths))
        return frame.withColumns(
            {
                "response": F.when(good & status.isNotNull(), response),
                "trace_id": first(_TRACE),
                "record_id": first(_RECORD),
            }
        )

    @staticmethod
    def _text(path: str) -> Column:
        v = F.try_variant_get("s0", path, "variant")
        return F.when(F.schema_of_variant(v) == "STRING", v.cast("string"))

    @staticmethod
    def _array(actions: list[Column]) -> Column:
        every = F.array(*actions) if actions else F.expr("array()")
        emitted = F.filter(every.cast(f"array<{ACTION}>"), lambda a: a.isNotNull())
        numbered = F.transform(emitted, lambda a, i: a.withField("idx", a["idx"] + i))
        return F.when(F.col("error").isNull(), numbered)

    def _actions(self, phase: Phase, planned: Planned, at: int) -> list[Column]:
        """Action structs; ``idx`` is where the list begins, as places are counted once it is known which are emitted."""
        out = []
        for a in planned.actions:
            action = F.struct(
                F.lit(at).alias("idx"),
                F.lit(a.phase or phase.name).alias("phase"),
                F.lit(a.kind).alias("kind"),
                F.lit(a.connector).alias("connector"),
                a.target.cast("string").alias("target"),
                a.payload.alias("payload"),
                (F.lit("{}") if a.extra is None else a.extra).alias("extra"),
            )
            out.append(action if a.when is None else F.when(a.when, action))
        return out

    def _phase(self, frame: DataFrame, phase: Phase, slots: list[str], actions: list[Column]):
        sequence = F.col("packet_seq") if "packet_seq" in frame.columns else None
        planned = plan_phase(phase, ex.Slots([F.col(s) for s in slots], sequence))
        name = f"s{len(slots)}"
        # Two projections, in which each long expression stands once: what the phase gives, then what counts of it.
        frame = frame.withColumns({name: planned.slot, "__kind": planned.error})
        kind = F.col("__kind")
        fresh = F.struct(canonical_code(kind).alias("code"), kind.alias("kind"), F.lit(phase.name).alias("phase"))
        good = F.col("error").isNull() & kind.isNull()
        error = F.coalesce("error", F.when(kind.isNotNull(), fresh.cast(ERROR)))
        frame = frame.withColumns({name: F.when(good, F.col(name)), "error": error}).drop("__kind")
        slots.append(name)
        return frame, self._actions(phase, planned, 0)


def compile_route(document: Document, name: str) -> CompiledRoute:
    return CompiledRoute(document.routes[name], document)


def dispatchable(rows: DataFrame) -> DataFrame:
    """One row for each action: what the delivery layer takes."""
    keep = [c for c in rows.columns if c not in ("actions", "fallback_actions")]
    # An inner explode would let the optimiser filter on the whole list's expression once more.
    every = rows.select(*keep, F.explode_outer("actions").alias("action"))
    return every.where(F.col("action").isNotNull()).select(*keep, "action.*")


def response_status(rows: DataFrame) -> DataFrame:
    """``status`` of each event: the response's, else 202, else by its error code."""
    return rows.withColumn(
        "status",
        F.coalesce(F.col("response.status"), scalars.http_status(F.col("error.code"))),
    )
