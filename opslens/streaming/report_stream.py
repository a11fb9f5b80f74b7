"""Incremental runs: take in what has landed since the last run, then report from tables."""

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from opslens import values as V
from opslens.operators.metrics import UNDATED, combined_days, combined_pages, daily_partials
from opslens.session import materialize, meet, scratch

MONTH = 7  # characters of a day that name its month; the undated ones are a month of their own


def append_batches(result: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append what a stream yields to a Parquet table, take in all that has landed, and stop.

    Every batch owns one folder and overwrites it, so a batch that is repeated after a failure leaves no duplicates.
    Works for new records, for windows that the watermark has closed (their state is dropped) and for alarms.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    query = result.writeStream.outputMode("append").foreachBatch(write)
    return query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_daily(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Keep the activity counters of a stream of payloads by day, take in all that has landed, and stop.

    A batch reads its own payloads and the months that they count for, late ones too, adds them up by day and writes those
    months anew under its own number: ``batch=N/month=M``. The newest folder of a month holds all of it. A repeated batch starts
    from the folders before it and overwrites its own.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with scratch(spark):
            fresh = materialize(daily_partials(batch), "fresh")
            merged = fresh
            if batch_id > 0:
                months = fresh.select(F.left("day", F.lit(MONTH)).alias("month")).distinct()
                before = _months(spark, table).where(F.col("batch") < batch_id).join(F.broadcast(months), "month", "left_semi")
                merged = combined_days(fresh.unionByName(newest_months(before).select(*fresh.columns)))
            placed = merged.withColumn("month", F.left("day", F.lit(MONTH))).repartition("month")
            placed.write.mode("overwrite").partitionBy("month").parquet(f"{table}/batch={batch_id}")

    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return query.trigger(availableNow=True).start()


def _months(spark: SparkSession, table: str) -> DataFrame:
    counters = ", ".join(f"{n} bigint" for n in V.ACTIVITY_FIELDS)
    return spark.read.schema(f"repo string, error string, day string, {counters}, batch int, month string").parquet(table)


def newest_months(table: DataFrame) -> DataFrame:
    """The rows of each month's newest batch. The versions are folder names, a row a month and batch."""
    last = table.groupBy("month").agg(F.max("batch").alias("batch"))
    return table.join(F.broadcast(last), ["month", "batch"]).drop("batch", "month")


def metrics_of_days(spark: SparkSession, table: str, as_of: str | datetime, days: int = V.WINDOW_DAYS) -> DataFrame:
    """:func:`repo_metrics` over all payloads that :func:`write_daily` has seen; only the months of the window are read.

    Days are the finest step, so ``as_of`` has to be a midnight.
    """
    end = datetime.fromisoformat(str(as_of).removesuffix("Z"))
    if end.time() != datetime.min.time():
        raise ValueError(f"not a midnight: {as_of}")
    first = str((end - timedelta(days=days)).date())
    kept = (F.col("month") >= first[:MONTH]) | (F.col("month") == UNDATED)
    inside = (F.col("day") >= first) | (F.col("day") == UNDATED)
    return combined_pages(newest_months(_months(spark, table).where(kept)).where(inside))


def sliding_metrics(
    stream: DataFrame,
    time: str,
    key: Sequence[str],
    counters: Sequence[Column],
    days: int = V.WINDOW_DAYS,
    late: str = "1 day",
) -> DataFrame:
    """Counters per key over ``days``-long windows that start every day; boundaries lie on whole days.

    ``counters`` are named counts and sums. They are kept per day, so a row enters one group, and a window adds up its
    days. In append mode the watermark closes days and windows, and their state is dropped.
    """
    daily = stream.withWatermark(time, late).groupBy(F.window(time, "1 day").alias("_day"), *key).agg(*counters)
    names = [c for c in daily.columns if c not in ("_day", *key)]
    window = F.window(F.window_time("_day"), f"{days} days", "1 day")
    grouped = daily.groupBy(window.alias("_w"), *key).agg(*[F.sum(n).alias(n) for n in names])
    return grouped.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *key, *names)


def write_updates(result: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Keep the changed rows of every batch of a streaming aggregate, each batch in a folder of its own.

    A repeated batch overwrites its folder, and no reader finds the table empty. :func:`newest_rows` reads it.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    query = result.writeStream.outputMode("update").foreachBatch(write)
    return query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_rows(table: DataFrame, key: Sequence[str]) -> DataFrame:
    """The last written row of each key of a table of updates."""
    last = table.groupBy(*key).agg(F.max("batch").alias("batch"))
    return meet(table, last, [*key, "batch"]).drop("batch")


def as_of_window(windows: DataFrame, as_of: str | datetime) -> DataFrame:
    """The window that ends at the day of ``as_of``."""
    return windows.where(F.col("window_end") == F.lit(str(as_of)[:10]).cast("timestamp"))
