"""Readings from a stream of scan events, and the same results in batch.

Events are (key, ts, event_id, kind, url, ...).  One key may hold a large share
of all events, so no window runs over a whole key: the batch plans look back or
ahead inside one key and hour, and carry values between hours over a table with
one row per key and hour.  Everything else is an aggregate with a partial step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosegauge.streaming.run import fold

URL, COMPLETE, RESULT, FAILED, CLOSED = "url", "complete", "result", "failed", "closed"
# The normal and the extended scan limit.
DEADLINE_SECONDS = 3
LONG_DEADLINE_SECONDS = 30


def carried(
    df: DataFrame,
    value: Column,
    name: str,
    *,
    key: str = "key",
    order: str = "ts",
    slot: str = "1 hour",
    ahead: bool = False,
) -> DataFrame:
    """Add the last non-null `value` strictly before each row of its key.

    With `ahead`, the next one strictly after.  Rows are split by key and time
    slot; a slot that has nothing to offer takes the value from the nearest
    slot that has, found on the much smaller table of slots.
    """
    tagged = df.withColumns({"_value": value, "_slot": F.window(F.col(order), slot)["start"]})
    sort = F.desc(order) if ahead else F.asc(order)
    sort_slot = F.desc("_slot") if ahead else F.asc("_slot")
    inside = Window.partitionBy(key, "_slot").orderBy(sort).rowsBetween(Window.unboundedPreceding, -1)
    latest = F.min_by if ahead else F.max_by
    slots = tagged.groupBy(key, "_slot").agg(
        latest(F.col("_value"), F.when(F.col("_value").isNotNull(), F.col(order))).alias("_of_slot")
    )
    across = Window.partitionBy(key).orderBy(sort_slot).rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("_carried", F.last("_of_slot", ignorenulls=True).over(across)).drop("_of_slot")
    near = tagged.withColumn("_near", F.last("_value", ignorenulls=True).over(inside))
    return (
        near.join(slots, [key, "_slot"], "left")
        .withColumn(name, F.coalesce("_near", "_carried"))
        .drop("_value", "_slot", "_near", "_carried")
    )


# --- repeats ---------------------------------------------------------------------
def phase() -> Column:
    """The address and the stage of a navigation; closing a key forgets it."""
    return F.when(F.col("kind").isin(URL, COMPLETE), F.concat_ws("|", "url", "kind")).when(
        F.col("kind") == CLOSED, F.lit("")
    )


def dedup_phases(events: DataFrame) -> DataFrame:
    """Navigation events that differ from the last one of their key."""
    relevant = events.filter(F.col("kind").isin(URL, COMPLETE, CLOSED)).withColumn("phase", phase())
    seen = carried(relevant, F.col("phase"), "last_phase")
    return seen.filter(
        (F.col("kind") != CLOSED) & ~F.col("phase").eqNullSafe(F.col("last_phase"))
    ).drop("last_phase")


# --- readings ----------------------------------------------------------------------
def latest_readings(events: DataFrame) -> DataFrame:
    """(key, band, slop, ts) of each key whose last outcome is a reading.

    A failed scan and a closed key clear the reading.  One aggregate, combined
    before the shuffle, so a hot key costs one row per task.
    """
    outcome = events.filter(F.col("kind").isin(RESULT, FAILED, CLOSED))
    last = outcome.groupBy("key").agg(
        F.max_by(F.struct("kind", "band", "slop", "ts"), F.struct("ts", "event_id")).alias("last")
    )
    return last.filter(F.col("last.kind") == RESULT).select("key", "last.band", "last.slop", "last.ts")


def supersede(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Results that answer the newest request of their key, at its address.

    Requests are (key, token, url), results (key, token, url, ...).  Both are
    reduced to one row per key before they meet.
    """
    newest = requests.groupBy("key").agg(F.max_by(F.struct("token", "url"), "token").alias("request"))
    fields = [c for c in results.columns if c != "key"]
    answer = results.groupBy("key").agg(F.max_by(F.struct(*fields), "token").alias("answer"))
    return (
        newest.join(answer, "key")
        .filter(
            (F.col("answer.token") == F.col("request.token")) & (F.col("answer.url") == F.col("request.url"))
        )
        .select("key", "answer.*")
    )


def limit_seconds(asked: Column, normal: float = DEADLINE_SECONDS, longest: float = LONG_DEADLINE_SECONDS) -> Column:
    """The limit of a request: the normal one unless it asks for its own, and never beyond the extended one."""
    return F.least(F.coalesce(F.when(asked > 0, asked), F.lit(normal)), F.lit(longest)).cast("double")


def first_ready(events: DataFrame, deadline_seconds: float | Column = DEADLINE_SECONDS) -> DataFrame:
    """For each request, the first later snapshot that can be scored in time.

    Events are requests (`kind` url) and snapshots with `ready`.  The next ready
    snapshot of the key is looked up, then held against the deadline; nothing
    after it counts.  The deadline may be a column of the requests, see
    `limit_seconds`.
    """
    ready = F.when(F.col("ready"), F.struct("ts", "event_id"))
    looked = carried(events, ready, "next_ready", ahead=True)
    in_time = F.coalesce(F.col("next_ready.ts") < F.col("ts") + _span(deadline_seconds), F.lit(False))
    return looked.filter(F.col("kind") == URL).select(
        "key",
        "event_id",
        "ts",
        F.when(in_time, F.col("next_ready.event_id")).alias("ready_id"),
        F.when(in_time, "ready").otherwise("timeout").alias("outcome"),
    )


def _span(seconds: float | Column) -> Column:
    return F.make_dt_interval(secs=seconds if isinstance(seconds, Column) else F.lit(seconds))


# --- the same on a stream -------------------------------------------------------------
def score_stream(documents: DataFrame, rules=None) -> DataFrame:
    """Scores of documents as they arrive; a narrow plan without state."""
    from prosegauge.plans.scoring import scan

    return scan(documents, rules)


def latest_outcomes_stream(events: DataFrame, lateness: str = "1 hour", slot: str = "1 day") -> DataFrame:
    """A running aggregate for update mode: the last outcome of each key and slot of time.

    The state of a slot is freed when the watermark has passed it, so what is held
    are the keys of the newest slots and never all keys there have been.  Closed
    and failed scans are outcomes other than a result; see `open_readings`.
    """
    last = F.max_by(F.struct("kind", "band", "slop", "ts", "event_id"), F.struct("ts", "event_id")).alias("last")
    outcome = events.filter(F.col("kind").isin(RESULT, FAILED, CLOSED)).withWatermark("ts", lateness)
    return outcome.groupBy(F.window("ts", slot), "key").agg(last).select("key", "last.*")


def open_readings(updates: DataFrame) -> DataFrame:
    """Readings from the updates a stream wrote: of each key the last one, unless a later outcome cleared it."""
    last = updates.groupBy("key").agg(F.max_by(F.struct("kind", "band", "slop", "ts"), F.struct("ts", "event_id")).alias("last"))
    return last.filter(F.col("last.kind") == RESULT).select("key", "last.band", "last.slop", "last.ts")


def newest_requests_stream(events: DataFrame, lateness: str = "1 hour", slot: str = "1 day") -> DataFrame:
    """A running aggregate for update mode: newest request and answer per key and slot of time.

    State is freed with its slot, as in `latest_outcomes_stream`; a request and its
    answer may lie in two slots, and `answered` brings them together.
    """
    is_request = F.col("kind").isin(URL, COMPLETE)
    answer = F.struct("token", "url", "slop")
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", slot), "key").agg(
        F.max_by(F.struct("token", "url"), F.when(is_request, F.col("token"))).alias("request"),
        F.max_by(answer, F.when(F.col("kind") == RESULT, F.col("token"))).alias("answer"),
    ).drop("window")


def answered(updates: DataFrame) -> DataFrame:
    """Answers to the newest request of their key, at its address, from the updates a stream wrote."""
    last = updates.groupBy("key").agg(
        F.max_by("request", "request.token").alias("request"), F.max_by("answer", "answer.token").alias("answer")
    )
    same = (F.col("request.token") == F.col("answer.token")) & (F.col("request.url") == F.col("answer.url"))
    return last.filter(same).select("key", "answer.token", "answer.slop")


def first_ready_stream(
    events: DataFrame,
    deadline_seconds: float | Column = DEADLINE_SECONDS,
    lateness: str = "1 minute",
    slot: str = "1 hour",
    longest_seconds: float | None = None,
) -> DataFrame:
    """Requests with their first ready snapshot or a timeout, as the watermark passes.

    An outer join of two streams bounded in time on both sides, so a request without
    a snapshot leaves it when its time is over; then an aggregate per request, written
    when its slot is over.  State is freed by the watermark and late rows are dropped.
    A deadline that is a column of the requests needs `longest_seconds`, the bound of
    what is kept.
    """
    marked = events.withWatermark("ts", lateness)
    requests = marked.filter(F.col("kind") == URL).select(
        "key", F.col("event_id").alias("request_id"), F.col("ts").alias("asked"), (F.col("ts") + _span(deadline_seconds)).alias("until")
    )
    snapshots = marked.filter("ready").select(
        F.col("key").alias("s_key"), F.col("event_id").alias("s_id"), F.col("ts").alias("s_ts")
    )
    longest = deadline_seconds if longest_seconds is None else longest_seconds
    joined = requests.join(
        snapshots,
        (F.col("key") == F.col("s_key"))
        & (F.col("s_ts") > F.col("asked"))
        & (F.col("s_ts") < F.col("asked") + _span(longest))
        & (F.col("s_ts") < F.col("until")),
        "leftOuter",
    )
    first = joined.groupBy(F.window("asked", slot), "key", "request_id").agg(F.min_by("s_id", "s_ts").alias("ready_id"))
    return first.select(
        "key",
        F.col("request_id").alias("event_id"),
        "ready_id",
        F.when(F.col("ready_id").isNull(), "timeout").otherwise("ready").alias("outcome"),
    )


def phase_changes(batch: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`dedup_phases` of a micro-batch, given the last phase of each key before it; its rows and the phases after it.

    The phases before are rows of their own in front of the batch, so a key that
    holds most rows is split by time as in the batch plan, and no row meets its
    key's state in one task.  A key that is closed leaves the state.
    """
    fields = ["key", "ts", "event_id", "phase"]
    rows = batch.filter(F.col("kind").isin(URL, COMPLETE, CLOSED)).withColumn("phase", phase())
    both = rows.withColumn("held", F.lit(False)).unionByName(before.withColumn("held", F.lit(True)), allowMissingColumns=True)
    seen = carried(both, F.col("phase"), "last_phase").filter(~F.col("held"))
    new = seen.filter((F.col("phase") != "") & ~F.col("phase").eqNullSafe(F.col("last_phase")))
    last = both.groupBy("key").agg(F.max_by(F.struct(*fields[1:]), F.struct("ts", "event_id")).alias("last"))
    return new.drop("last_phase", "held"), last.select("key", "last.*").filter("phase <> ''")


def dedup_phases_stream(events: DataFrame, name: str = "dedup", folder: str | None = None) -> DataFrame:
    """As `dedup_phases` on a stream run to the end of its input, with the last phase of each open key as state."""
    kind = events.schema["key"].dataType.simpleString()
    return fold(events, name, phase_changes, f"key {kind}, ts timestamp, event_id {events.schema['event_id'].dataType.simpleString()}, phase string", folder)
