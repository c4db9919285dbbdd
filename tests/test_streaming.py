"""Streams over several micro-batches against their batch twins."""

import os

import pytest
from pyspark.sql import functions as F

from prosegauge.catalog.event_queries import as_scan_events, requests_and_results
from prosegauge.streaming import events as E
from prosegauge.streaming.run import drain, fold, shared_folder

PARTS = 4


@pytest.fixture(scope="module")
def events(spark, sf_dir):
    return as_scan_events(spark.read.parquet(os.path.join(sf_dir, "events.parquet"))).cache()


@pytest.fixture(scope="module")
def folder(spark, events, tmp_path_factory):
    """The events in time order as several files, oldest first."""
    path = str(tmp_path_factory.mktemp("events"))
    for i in range(PARTS):
        part = events.filter(F.floor(F.col("event_id") * PARTS / 1000) == i)
        part.coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, events, folder):
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_dedup(spark, events, folder):
    got = E.dedup_phases_stream(stream(spark, events, folder))
    assert got.select("batch").distinct().count() > 1
    assert rows(got, "key", "event_id") == rows(E.dedup_phases(events), "key", "event_id")


def test_dedup_of_one_hot_key(spark, events, tmp_path):
    """One key holds all but a few rows; closing it forgets its phase."""
    hot = events.withColumn("key", F.when(F.col("event_id") % 10 == 0, F.col("key")).otherwise(F.lit(1).cast("long")))
    for i in range(PARTS):
        hot.filter(F.floor(F.col("event_id") * PARTS / 1000) == i).coalesce(1).write.mode("append").parquet(str(tmp_path))
    got = E.dedup_phases_stream(stream(spark, hot, str(tmp_path)))
    assert rows(got, "key", "event_id") == rows(E.dedup_phases(hot), "key", "event_id")


def test_dedup_goes_on_and_keeps_open_keys_only(spark, events, folder):
    where = shared_folder(spark, "dedup")
    got = E.dedup_phases_stream(stream(spark, events, folder), folder=where)
    again = E.dedup_phases_stream(stream(spark, events, folder), folder=where)  # nothing new: nothing more is written
    assert again.count() == got.count()
    numbers = [int(n) for n in os.listdir(f"{where}/state") if n.isdigit()]
    assert len(numbers) == 2  # older states are gone
    state = spark.read.parquet(f"{where}/state/{max(numbers)}")
    last = events.filter(F.col("kind").isin("url", "complete", "closed")).groupBy("key").agg(F.max_by("kind", "ts").alias("kind"))
    assert rows(state, "key") == rows(last.filter("kind <> 'closed'"), "key")


def test_a_batch_that_runs_twice_changes_nothing(spark, events, folder):
    """The step of a batch only depends on the batch and the state before it."""
    first = events.filter("event_id < 500")
    state = f"key long, ts timestamp, event_id {events.schema['event_id'].dataType.simpleString()}, phase string"
    none = spark.createDataFrame([], state)
    (once, after), (twice, after_too) = E.phase_changes(first, none), E.phase_changes(first, none)
    assert rows(once, "event_id") == rows(twice, "event_id") and rows(after, "key", "phase") == rows(after_too, "key", "phase")


def test_fold_reads_the_state_of_the_batch_before(spark, events, folder):
    def step(batch, before):
        n = batch.agg(F.count("*").alias("n")).unionByName(before).agg(F.sum("n").alias("n"))
        return n, n

    got = fold(stream(spark, events, folder), "count", step, "n long")
    assert sorted(r["n"] for r in got.collect())[-1] == events.count()


def state_rows(progress):
    return [sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in progress]


def test_latest(spark, events, folder):
    progress = []
    got = drain(E.latest_outcomes_stream(stream(spark, events, folder)), "l", "update", progress)
    assert rows(E.open_readings(got), "key", "band", "slop") == rows(E.latest_readings(events), "key", "band", "slop")
    # State is freed: it holds the slots that the watermark has not passed, not every key and day.
    newest = events.agg(F.max("ts")).first()[0]
    outcomes = events.filter(F.col("kind").isin("result", "failed", "closed"))
    slots = outcomes.select(F.window("ts", "1 day").alias("w"), "key").distinct()
    open_slots = slots.filter(F.col("w.end") > F.lit(newest) - F.expr("INTERVAL 1 HOUR")).count()
    assert open_slots < slots.count()
    assert state_rows(progress)[-1] == open_slots


def test_newest_request(spark, events):
    requests, results = requests_and_results(events)
    got = E.supersede(requests, results).collect()
    newest = {}
    for r in requests.collect():
        newest[r.key] = max(newest.get(r.key, (-1, "")), (r.token, r.url))
    expected = sorted((r.key, r.token) for r in results.collect() if newest[r.key] == (r.token, r.url))
    assert sorted((r.key, r.token) for r in got) == expected


def test_newest_request_stream(spark, events, folder):
    def both(of):
        requests, results = requests_and_results(of)
        return requests.withColumns({"slop": F.lit(None).cast("int"), "kind": F.lit("url")}).unionByName(results.withColumn("kind", F.lit("result")))

    progress = []
    got = E.answered(drain(E.newest_requests_stream(both(stream(spark, events, folder))), "n", "update", progress))
    assert rows(got, "key", "token", "slop") == rows(E.supersede(*requests_and_results(events)), "key", "token", "slop")
    assert state_rows(progress)[-1] < max(state_rows(progress))


@pytest.mark.parametrize(("limit", "longest"), [(1800, None), ("own", 18000)])
def test_first_ready(spark, events, folder, limit, longest):
    """Every request whose hour is over by the watermark is written once, and as in the batch plan."""
    limit = E.limit_seconds(F.expr("CASE event_id % 3 WHEN 0 THEN 9000 WHEN 1 THEN 90000 END"), 1800, 18000) if limit == "own" else limit
    bound = 1800 if longest is None else longest
    over = events.agg((F.max("ts") - F.expr(f"INTERVAL 1 MINUTE {bound} SECONDS")).alias("t")).first()["t"]
    batch = E.first_ready(events, limit).filter(F.window("ts", "1 hour")["end"] <= F.lit(over))
    progress = []
    got = drain(E.first_ready_stream(stream(spark, events, folder), limit, longest_seconds=longest), "f", "append", progress)
    assert {r["outcome"] for r in got.select("outcome").distinct().collect()} == {"ready", "timeout"}
    assert rows(got, "event_id", "key", "ready_id", "outcome") == rows(batch, "event_id", "key", "ready_id", "outcome")


def test_limits_are_bounded(spark):
    asked = spark.createDataFrame([(None,), (0.0,), (2.0,), (10.0,), (500.0,)], "s double")
    assert [r[0] for r in asked.select(E.limit_seconds(F.col("s"))).collect()] == [3, 3, 2, 10, 30]


def test_carried_values_cross_slots(spark):
    rows_ = [("k", i, v) for i, v in [(0, "a"), (1, None), (5000, None), (9000, "b"), (20000, None), (20001, "c")]]
    df = spark.createDataFrame(rows_, "key string, t int, v string").withColumn("ts", F.timestamp_seconds("t"))
    back = E.carried(df, F.col("v"), "p").orderBy("t").collect()
    assert [r.p for r in back] == [None, "a", "a", "a", "b", "b"]
    ahead = E.carried(df, F.col("v"), "p", ahead=True).orderBy("t").collect()
    assert [r.p for r in ahead] == ["b", "b", "b", "c", "c", None]


def test_a_table_of_part_files_is_streamed(spark, sf_dir, tmp_path):
    from prosegauge.streaming.run import drain, read_stream

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    assert drain(read_stream(spark, str(tmp_path), "events"), "parts", "append").count() == events.count()


def test_no_local_folder_on_a_cluster(spark):
    class Conf:
        get = staticmethod(lambda name, default=None: default)

    class Context:
        master = "spark://far:7077"

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session, "x")
