"""Queries over scan events, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegauge.catalog import sql as S
from prosegauge.catalog.fixtures import documents_of
from prosegauge.catalog.registry import query
from prosegauge.catalog.sql import Sql
from prosegauge.plans import report, scoring
from prosegauge.sources.tables import table
from prosegauge.streaming import events as E
from prosegauge.streaming.run import drain, read_stream

# How the rows of the events table stand for scan events.
KINDS = {"view": "url", "click": "complete", "purchase": "result", "error": "failed", "signup": "closed"}
READY_VALUE = 10.0
DEADLINE = 1800


def as_scan_events(events: DataFrame) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    slop = F.least(F.lit(100), F.floor(F.col("value")).cast("int"))
    return events.select(
        F.col("user_id").alias("key"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        F.col("event_id").alias("token"),
        F.try_element_at(kinds, "event_type").alias("kind"),
        # A handful of addresses, so that navigations repeat.
        F.concat(F.lit("http://site/"), F.get_json_object("props", "$.k").cast("int") % 2).alias("url"),
        slop.alias("slop"),
        scoring.band_of(F.lit(100) - slop).alias("band"),
        (F.col("value") > READY_VALUE).alias("ready"),
    )


SCAN_SQL = f"""SELECT user_id AS key, ts, event_id, CASE event_type {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in KINDS.items())} END AS kind,
  'http://site/' || CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 AS url, least(100, CAST(floor(value) AS INTEGER)) AS slop,
  value > {READY_VALUE} AS ready FROM events"""
BANDED = f"""SELECT *, CASE {' '.join(f"WHEN 100 - slop >= {lo} THEN '{b}'" for b, lo in scoring.config.BANDS)} END AS band FROM scan"""


def _sql(final: str):
    return lambda: f"WITH scan AS ({SCAN_SQL}), banded AS ({BANDED}) {final}"


def scan_events(spark, sf_dir):
    return as_scan_events(table(spark, sf_dir, "events"))


DEDUP = """SELECT key, event_id, phase FROM (SELECT *, lag(phase) OVER (PARTITION BY key ORDER BY ts) AS before FROM (
  SELECT *, CASE WHEN kind = 'closed' THEN '' ELSE url || '|' || kind END AS phase FROM scan WHERE kind IN ('url', 'complete', 'closed')))
  WHERE kind <> 'closed' AND phase IS DISTINCT FROM before"""


@query("dedup_phases", _sql(DEDUP))
def dedup_phases(spark, sf_dir):
    return E.dedup_phases(scan_events(spark, sf_dir)).select("key", "event_id", "phase")


@query("dedup_phases_stream", _sql(DEDUP))
def dedup_phases_stream(spark, sf_dir):
    return E.dedup_phases_stream(as_scan_events(read_stream(spark, sf_dir, "events"))).select("key", "event_id", "phase")


LATEST = """SELECT key, band, slop, event_id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC) AS k FROM banded
  WHERE kind IN ('result', 'failed', 'closed')) WHERE k = 1 AND kind = 'result'"""


@query("latest_readings", _sql(f"SELECT key, band, slop FROM ({LATEST})"))
def latest_readings(spark, sf_dir):
    return E.latest_readings(scan_events(spark, sf_dir)).select("key", "band", "slop")


@query("latest_readings_stream", _sql(f"SELECT key, band, slop FROM ({LATEST})"))
def latest_readings_stream(spark, sf_dir):
    stream = E.latest_outcomes_stream(as_scan_events(read_stream(spark, sf_dir, "events")))
    return E.open_readings(drain(stream, "latest", "update")).select("key", "band", "slop")


REQUESTS = "kind IN ('url', 'complete')"
NEWEST = f"""WITH scan AS ({SCAN_SQL}),
  requests AS (SELECT key, event_id AS token, url FROM scan WHERE {REQUESTS}),
  results AS (SELECT key, event_id AS token, 'http://site/' || (CAST(substring(url, 13) AS INTEGER) + CASE WHEN slop % 5 = 0 THEN 1 ELSE 0 END) AS url, slop
    FROM scan WHERE {REQUESTS} AND ready)
  SELECT r.key, r.token, r.slop FROM results r JOIN requests q ON q.key = r.key AND q.token = r.token AND q.url = r.url
  WHERE q.token = (SELECT max(token) FROM requests x WHERE x.key = r.key)"""


def requests_and_results(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests, and answers to those that are ready; some answer elsewhere."""
    asked = events.filter(F.col("kind").isin("url", "complete"))
    moved = F.concat(
        F.lit("http://site/"),
        F.substring("url", 13, 9).cast("int") + F.when(F.col("slop") % 5 == 0, 1).otherwise(0),
    )
    return asked.select("key", "token", "url", "ts"), asked.filter("ready").select(
        "key", "token", moved.alias("url"), "slop", "ts"
    )


@query("newest_request_wins", lambda: NEWEST)
def supersede(spark, sf_dir):
    requests, results = requests_and_results(scan_events(spark, sf_dir))
    return E.supersede(requests, results).select("key", "token", "slop")


@query("newest_request_wins_stream", lambda: NEWEST)
def supersede_stream(spark, sf_dir):
    requests, results = requests_and_results(as_scan_events(read_stream(spark, sf_dir, "events")))
    both = requests.withColumns({"slop": F.lit(None).cast("int"), "kind": F.lit("url")}).unionByName(
        results.withColumn("kind", F.lit("result"))
    )
    return E.answered(drain(E.newest_requests_stream(both), "newest", "update"))


def _first(limit: str, only: str = "TRUE") -> str:
    return f"""SELECT q.key, q.event_id, min_by(s.event_id, s.ts) AS ready_id, CASE WHEN count(s.event_id) > 0 THEN 'ready' ELSE 'timeout' END AS outcome
  FROM (SELECT *, {limit} AS seconds FROM scan) q LEFT JOIN scan s ON s.key = q.key AND s.ready AND s.ts > q.ts AND s.ts < q.ts + to_seconds(q.seconds)
  WHERE q.kind = 'url' AND {only} GROUP BY q.key, q.event_id"""


# What the watermark has passed at the end: slots that ended the longest limit and the lateness before the newest event.
CLOSED_SLOTS = "date_trunc('hour', q.ts) + INTERVAL 1 HOUR + INTERVAL {} SECONDS + INTERVAL 1 MINUTE <= (SELECT max(ts) FROM scan)"
#: The extended limit of the queries; some requests ask for more than may be granted.
LONG_DEADLINE = 10 * DEADLINE
ASKED_SQL = f"CASE event_id % 4 WHEN 0 THEN {LONG_DEADLINE} WHEN 1 THEN {2 * LONG_DEADLINE} WHEN 2 THEN 0 END"
LIMIT_SQL = f"CASE event_id % 4 WHEN 0 THEN {LONG_DEADLINE} WHEN 1 THEN {LONG_DEADLINE} ELSE {DEADLINE} END"


def asked_limit():
    """The limit of each request: some ask for the extended one, some for more, some for none."""
    asked = F.expr(ASKED_SQL)
    return E.limit_seconds(asked, DEADLINE, LONG_DEADLINE)


@query("first_ready", _sql(_first(str(DEADLINE))))
def first_ready(spark, sf_dir):
    return E.first_ready(scan_events(spark, sf_dir), DEADLINE).select("key", "event_id", "ready_id", "outcome")


@query("first_ready_own_limits", _sql(_first(LIMIT_SQL)))
def first_ready_own_limits(spark, sf_dir):
    return E.first_ready(scan_events(spark, sf_dir), asked_limit()).select("key", "event_id", "ready_id", "outcome")


@query("first_ready_stream", _sql(_first(str(DEADLINE), CLOSED_SLOTS.format(DEADLINE))))
def first_ready_stream(spark, sf_dir):
    """Ready and timed-out requests of every hour that the watermark has passed."""
    stream = E.first_ready_stream(as_scan_events(read_stream(spark, sf_dir, "events")), DEADLINE)
    return drain(stream, "ready", "append").drop("batch")


@query("first_ready_stream_own_limits", _sql(_first(LIMIT_SQL, CLOSED_SLOTS.format(LONG_DEADLINE))))
def first_ready_stream_own_limits(spark, sf_dir):
    events = as_scan_events(read_stream(spark, sf_dir, "events"))
    stream = E.first_ready_stream(events, asked_limit(), longest_seconds=LONG_DEADLINE)
    return drain(stream, "ready-own", "append").drop("batch")


@query(
    "settings_everywhere",
    _sql(
        f"""SELECT k.key, CAST(NULL AS VARCHAR) AS icon_band, coalesce(CAST(l.slop AS VARCHAR), '') AS badge_text
        FROM (SELECT DISTINCT key FROM scan) k LEFT JOIN ({LATEST}) l USING (key)"""
    ),
)
def settings_everywhere(spark, sf_dir):
    """Every key under new settings: badges on, tinted icons off."""
    events = scan_events(spark, sf_dir)
    keys = events.select("key").distinct()
    readings = E.latest_readings(events).select("key", "band", "slop")
    settings = report.Settings(tint_icon=False)
    return report.apply_everywhere(keys, readings, settings).select("key", "icon_band", "badge_text")


def _scan_sql() -> str:
    sql = Sql("SELECT doc_id, text, lang, source FROM documents")
    sql.scores()
    return sql.text(
        f"""SELECT doc_id, CASE WHEN {S.words('text')} = 0 THEN 'no_text' WHEN word_count < 10 THEN 'not_enough_text' ELSE 'ok' END AS status,
          CASE WHEN word_count >= 10 THEN score END AS score, CASE WHEN word_count >= 10 THEN band END AS band
        FROM scores JOIN docs USING (doc_id)"""
    )


@query("scan_documents", _scan_sql)
def scan_documents(spark, sf_dir):
    return scoring.scan(documents_of(spark, sf_dir)).select("doc_id", "status", "score", "band")


@query("score_stream", _scan_sql)
def score_stream(spark, sf_dir):
    """The same on a stream of document files."""
    docs = read_stream(spark, sf_dir, "documents").select("doc_id", "text")
    return drain(E.score_stream(docs), "scores", "append").select("doc_id", "status", "score", "band")
