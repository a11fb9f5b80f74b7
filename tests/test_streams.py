import json
from datetime import timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from opslens.operators import metrics as M
from opslens.sources import landing as L
from opslens.schemas import ACTIVITY
from opslens.streaming import alarms as A
from opslens.streaming import report_stream as R
from tests.test_report import AS_OF, MIXED, activity


def calls(spark, folder):
    return spark.readStream.schema("s string, i bigint, c string").option("maxFilesPerTrigger", 1).json(str(folder))


def write_file(folder, name, rows):
    (folder / name).write_text("\n".join(json.dumps(dict(zip(["s", "i", "c"], r))) for r in rows))


def test_repeat_alarms_keep_state_between_batches(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    run = lambda: R.append_batches(A.repeat_alarms(calls(spark, landing), "s", "i", "c"), out, check).awaitTermination()
    write_file(landing, "a.json", [("x", 2, "read"), ("x", 1, "read"), ("y", 1, "read"), (None, 1, "go"), (None, 2, "go")])
    run()
    write_file(landing, "b.json", [("x", 5, "edit"), ("x", 3, "read"), ("x", 4, "read"), ("x", 6, "edit"), ("x", 7, "edit"), ("y", 2, "edit"), (None, 3, "go")])
    run()
    write_file(landing, "c.json", [("x", 8, "edit"), ("x", 9, "go"), ("x", 1, "go"), ("y", 3, "edit"), ("y", 4, "edit")])
    run()
    got = spark.read.schema("session string, position bigint, call string").parquet(out).drop("batch").collect()
    assert sorted(map(str, got)) == sorted(map(str, [R_("x", 3, "read"), R_("x", 7, "edit"), R_("y", 4, "edit"), R_(None, 3, "go")]))


R_ = Row("session", "position", "call")


def timed(spark, folder):
    return spark.readStream.schema("s string, i bigint, c string, t timestamp").json(str(folder))


def write_timed(folder, name, rows):
    (folder / name).write_text("\n".join(json.dumps(dict(zip("sict", r))) for r in rows))


def state_rows(query):
    query.awaitTermination()
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress][-1]


def test_silent_sessions_leave_the_state(spark, tmp_path):
    """State follows the sessions that are alive; a session that was forgotten starts anew."""
    landing = tmp_path / "in"
    landing.mkdir()
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    alarms = lambda: A.repeat_alarms(timed(spark, landing), "s", "i", "c", times=2, time="t", idle=timedelta(hours=1))
    write_timed(landing, "a.json", [(f"s{i}", 1, "r", "2024-01-01T00:00:00Z") for i in range(50)])
    most = state_rows(R.append_batches(alarms(), out, check))
    write_timed(landing, "b.json", [("s1", 2, "r", "2024-01-01T00:30:00Z"), ("s2", 2, "q", "2024-01-01T00:59:59Z")])
    state_rows(R.append_batches(alarms(), out, check))
    write_timed(landing, "c.json", [("s3", 2, "r", "2024-01-01T03:00:00Z")])
    state_rows(R.append_batches(alarms(), out, check))
    write_timed(landing, "d.json", [("s1", 3, "r", "2024-01-01T03:30:00Z"), ("s1", 4, "r", "2024-01-01T03:31:00Z")])
    least = state_rows(R.append_batches(alarms(), out, check))
    got = spark.read.schema("session string, position bigint, call string").parquet(out).drop("batch").collect()
    assert sorted(tuple(r)[:2] for r in got) == [("s1", 2), ("s1", 4), ("s3", 2)]
    assert least < most / 5


def test_budget_alarms(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    spent = {"tokens": (F.col("i"), 10), "cost": (F.col("i").cast("decimal(10,2)"), 14.5)}
    run = lambda: R.write_updates(A.budget_alarms(calls(spark, landing), ["s"], spent), out, check).awaitTermination()
    write_file(landing, "a.json", [("x", 2, "r"), ("x", 9, "r"), ("y", 1, "r"), ("z", None, "r"), (None, 20, "r")])
    run()
    write_file(landing, "b.json", [("x", 4, "r"), ("y", 8, "r")])
    run()
    table = spark.read.schema("s string, budget string, total double, batch int").parquet(out)
    got = {tuple(r) for r in R.newest_rows(table, ["s", "budget"]).collect()}
    assert got == {("x", "tokens", 15.0), ("x", "cost", 15.0), (None, "tokens", 20.0), (None, "cost", 20.0)}
    assert table.where("s IS NULL").select("batch").distinct().count() == 1  # no rows, no work


def test_time_is_up_for_a_silent_session(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    out, check = str(tmp_path / "out"), str(tmp_path / "check")

    def run(name, rows):
        write_timed(landing, name, rows)
        alarms = A.budget_alarms(timed(spark, landing), ["s"], {"n": (F.col("i"), 100)}, time="t", max_seconds=60, idle=timedelta(hours=1))
        return state_rows(R.write_updates(alarms, out, check))

    most = run("a.json", [(f"k{i}", 1, "r", "2024-01-01T00:00:00Z") for i in range(40)] + [("x", 1, "r", "2024-01-01T00:00:00Z")])
    run("b.json", [("x", 1, "r", "2024-01-01T00:00:59Z"), ("y", 1, "r", "2024-01-01T00:00:30Z")])
    run("c.json", [("y", 1, "r", "2024-01-01T00:02:00Z")])
    table = spark.read.schema("s string, budget string, total double, batch int").parquet(out)
    assert {(r["s"], r["budget"], r["total"]) for r in table.where("s IN ('x', 'y')").collect()} == {("x", "clock", 60.001), ("y", "clock", 90.0)}
    run("d.json", [("y", 1, "r", "2024-01-01T05:00:00Z")])
    least = run("e.json", [("y", 200, "r", "2024-01-01T05:00:01Z")])
    assert least < most / 5


def test_ingest_takes_each_file_once(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    stream = lambda: spark.readStream.schema(ACTIVITY).json(str(landing))
    for name in ("a.json", "b.json"):
        (landing / name).write_text(json.dumps(activity("o/mixed", MIXED)))
        R.append_batches(stream(), out, check).awaitTermination()
    table = spark.read.schema(ACTIVITY).parquet(out)
    assert [tuple(r) for r in M.repo_metrics(table, AS_OF).collect()] == [("o/mixed", 6, 800, 140, 2, 0, None)]
    assert L.read_activity(spark, str(landing)).count() == 2


def test_days_add_up_to_the_report(spark, tmp_path):
    """Three increments, the last one late and repeated: the report over days equals the one over all files."""
    landing = tmp_path / "in"
    landing.mkdir()
    days, check = str(tmp_path / "days"), tmp_path / "check"
    as_of = AS_OF[:10] + "T00:00:00Z"
    run = lambda: R.write_daily(spark.readStream.schema(ACTIVITY).json(str(landing)), days, str(check)).awaitTermination()
    broken = activity("o/mixed", MIXED) | {"http_status": 500}
    parts = [[activity("o/mixed", MIXED), activity("o/none", {})], [broken, activity("p/q", MIXED)], [activity("o/mixed", MIXED)]]
    for n, rows in enumerate(parts):
        (landing / f"{n}.json").write_text("\n".join(map(json.dumps, rows)))
        run()
        got = sorted(map(str, R.metrics_of_days(spark, days, as_of).collect()))
        assert got == sorted(map(str, M.repo_metrics(L.read_activity(spark, str(landing)), as_of).collect()))
    for folder in ("commits/2", "commits/.2.crc"):
        (check / folder).unlink(missing_ok=True)
    run()
    assert sorted(map(str, R.metrics_of_days(spark, days, as_of).collect())) == got and len(got) == 3
    text = R.metrics_of_days(spark, days, as_of)._jdf.queryExecution().toString()
    assert "month" in text.split("PartitionFilters")[1][:200]
    with pytest.raises(ValueError):
        R.metrics_of_days(spark, days, AS_OF)


def test_closed_windows(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    out, check = str(tmp_path / "out"), str(tmp_path / "check")

    def result():
        stream = spark.readStream.schema("k string, ts timestamp").json(str(landing))
        return R.sliding_metrics(stream, "ts", ["k"], [F.count("*").alias("n")])

    days = ["2024-01-01", "2024-01-02", "2024-01-20"]
    for name, day in zip("abc", days):
        (landing / f"{name}.json").write_text(json.dumps({"k": "u", "ts": f"{day}T10:00:00Z"}))
        R.append_batches(result(), out, check).awaitTermination()
    got = spark.read.parquet(out)
    assert got.where("window_end <= '2024-01-09'").agg(F.sum("n")).first()[0] == 14
    # The window ending with 2024-01-08 holds both early events.
    last = R.as_of_window(got, "2024-01-08").collect()
    assert [r["n"] for r in last] == [2]
