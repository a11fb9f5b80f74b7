"""Streaming forms (rows ST1-ST3), each run to its end over a table and read back."""

import uuid

from pyspark.sql import functions as F

from checks import metrics as CM
from checks.registry import SCHEMAS, check, table
from opslens.operators import metrics as M
from opslens.session import shared_folder
from opslens.streaming import alarms as A
from opslens.streaming import report_stream as R


def stream(spark, folder, name):
    return spark.readStream.schema(SCHEMAS[name]).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def run_folder(spark):
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def finished(query):
    query.awaitTermination()


def landed_in_parts(spark, folder, start, by="event_id", parts=3):
    """Let the events land in ``parts`` ranges of ``by`` and run ``start(stream, folder)`` to its end after each."""
    at, events = run_folder(spark), table(spark, folder, "events")
    number = F.col(by) if by == "event_id" else F.unix_micros(F.col(by).cast("timestamp"))
    cuts = events.select(number.cast("double").alias("n")).approxQuantile("n", [i / parts for i in range(1, parts)], 0.01)
    place = sum(((number > cut).cast("int") for cut in cuts), F.lit(0))
    for part in range(parts):
        events.where(place == part).write.mode("append").parquet(f"{at}/landed")
        finished(start(spark.readStream.schema(SCHEMAS["events"]).parquet(f"{at}/landed"), at))
    return at


@check(f"SELECT repo, prs_submitted, lines_added, lines_deleted, bugs_closed, releases_done, coalesce(error, '') AS error FROM ({CM.REPO_SQL})")
def ingested_activity(spark, folder):
    out = run_folder(spark)
    landed = CM.activity_payloads(stream(spark, folder, "orders"))
    metrics = M.payload_metrics(landed, CM.ORDERS_AS_OF)
    finished(R.append_batches(metrics, f"{out}/activity", f"{out}/checkpoint"))
    table = spark.read.schema(metrics.schema).parquet(f"{out}/activity").select(*metrics.columns)
    return M.combined_pages(table).withColumn("error", F.coalesce("error", F.lit("")))


@check(f"SELECT * REPLACE (coalesce(error, '') AS error) FROM ({CM.REPO_SQL})")
def activity_in_increments(spark, folder):
    """Orders land in three parts, the oldest last; each run adds its part to the days, and the report reads a week of them."""
    at, orders = run_folder(spark), table(spark, folder, "orders")
    number = F.unix_date(F.col("o_orderdate").cast("date")).cast("double")
    cuts = orders.select(number.alias("n")).approxQuantile("n", [0.9, 0.4], 0.01)
    bounds = [float("inf"), *cuts, float("-inf")]
    schema = CM.activity_payloads(orders).schema
    for high, low in zip(bounds, bounds[1:], strict=False):
        part = orders.where((number <= high) & (number > low))
        CM.activity_payloads(part).write.mode("append").parquet(f"{at}/landed")
        finished(R.write_daily(spark.readStream.schema(schema).parquet(f"{at}/landed"), f"{at}/days", f"{at}/checkpoint"))
    return R.metrics_of_days(spark, f"{at}/days", CM.ORDERS_AS_OF).withColumn("error", F.coalesce("error", F.lit("")))


@check(
    """
    SELECT user_id, strftime(w, '%Y-%m-%d') AS window_start, count(*) AS events, count(*) FILTER (event_type = 'error') AS errors
    FROM (SELECT *, date_trunc('day', ts) - to_days(CAST(unnest(range(0, 7)) AS INTEGER)) AS w FROM events)
    WHERE w + INTERVAL 7 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY user_id, w
    """
)
def sliding_event_metrics(spark, folder):
    """Append form: the windows that the watermark, a day behind the newest event, has closed."""
    out = run_folder(spark)
    events = stream(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    counters = [F.count("*").alias("events"), F.count_if(F.col("event_type") == "error").alias("errors")]
    result = R.sliding_metrics(events, "ts", ["user_id"], counters)
    finished(R.append_batches(result, f"{out}/windows", f"{out}/checkpoint"))
    table = spark.read.schema(result.schema).parquet(f"{out}/windows")
    return table.select("user_id", F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "events", "errors")


@check(
    """
    SELECT user_id, 'tokens' AS budget, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS DOUBLE) AS total FROM events
    GROUP BY user_id HAVING sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) > 3000
    UNION ALL
    SELECT user_id, 'cost', CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) FROM events GROUP BY user_id HAVING sum(CAST(value AS DECIMAL(18,2))) > 1000
    """
)
def streamed_budget_alarms(spark, folder):
    """The caps over events that land in three parts, each taken in by a run of its own."""
    spent = {
        "tokens": (F.get_json_object("props", "$.k").cast("bigint"), 3000),
        "cost": (F.col("value").cast("decimal(18,2)"), 1000),
    }
    at = landed_in_parts(spark, folder, lambda events, at: R.write_updates(A.budget_alarms(events, ["user_id"], spent), f"{at}/alarms", f"{at}/checkpoint"))
    table = spark.read.schema("user_id bigint, budget string, total double, batch int").parquet(f"{at}/alarms")
    return R.newest_rows(table, ["user_id", "budget"])


@check(
    """
    WITH e AS (
      SELECT user_id, event_id, event_type,
             row_number() OVER (PARTITION BY user_id ORDER BY event_id)
             - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS island FROM events
    ), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, island ORDER BY event_id) AS nth FROM e)
    SELECT user_id, event_id, event_type FROM r WHERE nth = 3
    """
)
def streamed_repeat_alarms(spark, folder):
    """Runs of calls that begin in one part of the landed events and end in another count, too."""
    alarms = lambda events: A.repeat_alarms(events, "user_id", "event_id", "event_type")
    at = landed_in_parts(spark, folder, lambda events, at: R.append_batches(alarms(events), f"{at}/alarms", f"{at}/checkpoint"))
    table = spark.read.schema("session bigint, position bigint, call string").parquet(f"{at}/alarms")
    return table.select(F.col("session").alias("user_id"), F.col("position").alias("event_id"), F.col("call").alias("event_type"))


@check(
    """
    SELECT user_id, 'clock' AS budget, CASE WHEN b - a > 1814400000 THEN CAST(b - a AS DOUBLE) / 1000 ELSE 1814400.001 END AS total
    FROM (SELECT user_id, epoch_us(min(ts)) // 1000 AS a, epoch_us(max(ts)) // 1000 AS b, (SELECT epoch_us(max(ts)) // 1000 FROM events) AS now FROM events GROUP BY user_id)
    WHERE now - a > 1814400001
    """
)
def streamed_clock_alarms(spark, folder):
    """Users over three weeks after their first event: those whose events go on that long, and by timer those who fell silent."""
    spent = {"cost": (F.col("value"), float("inf"))}
    alarms = lambda events: A.budget_alarms(events, ["user_id"], spent, time="ts", max_seconds=21 * 86400)
    at = landed_in_parts(spark, folder, lambda events, at: R.write_updates(alarms(events), f"{at}/alarms", f"{at}/checkpoint"), by="ts")
    table = spark.read.schema("user_id bigint, budget string, total double, batch int").parquet(f"{at}/alarms")
    return R.newest_rows(table, ["user_id", "budget"])
