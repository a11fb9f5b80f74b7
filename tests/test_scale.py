"""Plans and hot keys: one key holds a third of all rows, and no operator may gather it."""

import os

import pytest
from pyspark.sql import functions as F

from opslens.functions import text as T
from opslens.operators import classify as C
from opslens.operators import corpus as P
from opslens.operators import metrics as M
from opslens.operators import ordered as O
from opslens.operators import sessions as S
from opslens.session import materialize, scratch, shared_folder, sized

ROWS, STEP = 30_000, 1_000


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows belong to key 0, the rest to 1000 keys."""
    i = F.col("id")
    key = F.when(i % 3 == 0, 0).otherwise(1 + i % 1000)
    line = F.when(i % 997 == 5, "Error: x").when(i % 7 == 0, "venv/a").otherwise(F.concat(F.lit("line "), i % 5))
    return spark.range(ROWS).select(key.alias("k"), i.alias("i"), line.alias("line"))


def per_task_rows(df, *names):
    """Largest number of rows that share the given grouping columns."""
    return df.groupBy(*names).count().agg(F.max("count")).first()[0]


def test_chunks_bound_the_rows_of_a_hot_key(hot):
    tagged = hot.withColumn("c", O.position_chunk("i", STEP))
    assert per_task_rows(tagged, "k") >= ROWS // 3
    assert per_task_rows(tagged, "k", "c") <= STEP


@pytest.mark.parametrize("shape", ["dense", "burst", "sparse", "holes"])
def test_ranked_chunks(spark, hot, shape):
    """Full chunks in order, also where one second holds 95 % of the hot key, positions lie far apart or are NULL."""
    i = F.col("i")
    second = {
        "dense": i * 7,
        "burst": F.when(i % 60 == 0, i).otherwise(12_345),
        "sparse": i * 100_000,
        "holes": F.when(i % 10 == 0, F.lit(None)).otherwise(i),
    }[shape]
    key = F.when(i % 11 == 5, F.lit(None)).otherwise(F.col("k")) if shape == "holes" else F.col("k")
    rows = hot.select(key.alias("k"), F.timestamp_seconds(second.cast("long")).cast("timestamp_ntz").alias("at"), "i")
    got = O.ranked_chunks(rows, ["k"], ["at", "i"], max_rows=STEP)
    assert per_task_rows(got, "k", "chunk") <= STEP and got.count() == ROWS
    counts = {r["k"]: r for r in got.groupBy("k").agg(F.count("*").alias("n"), F.max("chunk").alias("c"), F.countDistinct("chunk").alias("d")).collect()}
    assert all(r["c"] == (r["n"] - 1) // STEP and r["d"] == r["c"] + 1 for r in counts.values())
    ends = got.where("k = 0").groupBy("chunk").agg(F.min(F.struct("at", "i")).alias("a"), F.max(F.struct("at", "i")).alias("b"))
    assert ends.alias("x").join(ends.alias("y"), F.expr("x.chunk < y.chunk AND NOT x.b < y.a")).isEmpty()
    assert got.select("k", "at", "i").exceptAll(rows).isEmpty()


def test_running_sums_equal_a_plain_window(spark, hot):
    got = O.running_sums(hot, ["k"], ["i"], O.position_chunk("i", STEP), {"n": F.lit(1), "s": F.col("i")})
    hot.createOrReplaceTempView("hot_rows")
    plain = spark.sql("SELECT k, i, count(*) OVER w AS n, sum(i) OVER w AS s FROM hot_rows WINDOW w AS (PARTITION BY k ORDER BY i)")
    assert got.select("k", "i", "n", "s").exceptAll(plain).isEmpty() and got.count() == ROWS


def test_ordered_operators_on_a_hot_key(spark, hot):
    line = F.col("line")
    kept = O.first_error_rows(hot, ["k"], ["i"], O.position_chunk("i", STEP), T.matches_trace(line), T.matches_call_site(line))
    pruned = O.prune_rows(hot, ["k"], ["i"], O.position_chunk("i", STEP), T.matches_error(line), T.matches_vendor(line))
    whole = hot.groupBy("k").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda r: r["line"]).alias("l"))
    expected = whole.select("k", F.explode(T.first_error_lines(F.col("l"))).alias("line"))
    assert kept.select("k", "line").exceptAll(expected.select(F.col("k"), "line")).isEmpty()
    assert kept.count() == expected.count()
    expected = whole.select("k", F.explode(T.prune_lines(F.col("l"))).alias("line"))
    assert pruned.count() == expected.count() and pruned.select("k", "line").exceptAll(expected).isEmpty()


def test_large_aggregates_are_hash_based(spark, hot):
    lines = hot.select(F.col("k").cast("string").alias("repo"), F.col("i").alias("prs_submitted"), F.lit(1).alias("lines_added"),
                       F.lit(1).alias("lines_deleted"), F.lit(1).alias("bugs_closed"), F.lit(1).alias("releases_done"), F.col("line").alias("error"))
    text = plan(M.combined_pages(lines))
    first = text[text.rindex("HashAggregate") :]
    assert "keys=[repo" in first.replace("key=", "keys=") and "partial_sum" in first
    manifest = hot.select(F.col("k").alias("project"), F.col("line").alias("path"))
    assert "SortAggregate" not in plan(C.classify_projects(manifest)) and "collect_set" not in plan(C.classify_projects(manifest))
    docs = hot.select(F.col("i").alias("path"), F.col("line").alias("content"))
    assert "SortAggregate" not in plan(P.line_redundancy(docs))
    messages = hot.select(F.col("k").alias("conv_id"), F.col("i").alias("turn"), F.lit("user").alias("role"), F.col("line").alias("text"))
    assert "SortAggregate" not in plan(S.session_totals(messages)) and "SortAggregate" not in plan(S.session_savings(messages))


@pytest.fixture
def eager_skew_splits(spark):
    """Small inputs count as skewed, and nothing is broadcast by estimate."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_hot_link_target_is_split(spark, hot, eager_skew_splits):
    sizes = spark.range(1001).select(F.col("id").cast("string").alias("doc"), F.lit(2).cast("bigint").alias("tokens"))
    links = hot.repartition(8).select((F.col("i") % 1001).cast("string").alias("doc"), F.col("k").cast("string").alias("target"))
    got = P.reference_payload(sizes, links)
    total = got.agg(F.sum("links"), F.sum("payload"))
    assert tuple(total.first()) == (ROWS, 2 * ROWS + 2 * 1001)
    got.collect()
    assert "skew=true" in plan(got)


def test_no_cartesian_products(spark, hot):
    stats = hot.agg(F.count("*").alias("n"))
    from opslens.operators.report import attach_sources

    text = plan(attach_sources(hot, stats))
    assert "Cartesian" not in text and "NestedLoop" not in text
    stacks = hot.select(F.col("i").alias("project"), F.lit("Frontend").alias("stack"))
    from opslens.sources.landing import registry_tools

    text = plan(C.forced_tools(stacks, registry_tools(F.lit('{"categories": {}}'))))
    assert "Join" not in text and "Exchange" not in text


def test_window_filters_reach_the_scan(spark, tmp_path):
    from opslens.functions.temporal import in_date_range, in_trailing_window

    path = str(tmp_path / "t")
    spark.sql("SELECT timestamp_ntz '2024-01-01' AS ts, 1 AS x, 'a' AS unused").write.parquet(path)
    rows = spark.read.schema("ts timestamp_ntz, x int, unused string").parquet(path)
    text = plan(rows.where(in_trailing_window(F.col("ts"), "2024-01-05")).select("x"))
    assert "GreaterThanOrEqual(ts," in text and "unused" not in text
    text = plan(rows.where(in_date_range(F.col("ts"), "2024-01-05")).select("x"))
    assert "GreaterThanOrEqual(ts," in text and "LessThan(ts," in text


def test_intermediate_tables(spark, tmp_path):
    folder = shared_folder(spark)
    assert folder.startswith(spark.conf.get("spark.checkpoint.dir").rstrip("/") + "/")
    kept = materialize(spark.range(5), "five")
    with scratch(spark):
        table = materialize(spark.range(7), "seven")
        assert table.count() == 7 and "Scan parquet" in plan(table)
        files = {f.removeprefix("file://") for f in table.inputFiles()}
        assert all(os.path.exists(f) for f in files)
    assert kept.count() == 5 and not any(os.path.exists(f) for f in files)


def test_every_column_counts_for_a_broadcast(spark):
    long = F.repeat(F.lit("x"), 1000)
    nested = spark.range(100).select("id", F.struct(F.array(long).alias("a")).alias("s"))
    binary = spark.range(100).select("id", long.cast("binary").alias("b"))
    mapped = spark.range(100).select("id", F.create_map(F.lit("k"), long).alias("m"))
    for df in (nested, binary, mapped):
        assert not sized(df, "wide", max_bytes=50_000)[1] and sized(df, "wide", max_bytes=500_000)[1]
    assert not sized(spark.range(11), "rows", limit=10)[1] and sized(spark.range(0), "none", limit=0)[1]


def test_log_is_read_once_for_its_order_and_once_for_its_rows(spark, tmp_path):
    """With long keys, what follows the stored rows does not go back to the source; without them, nothing is moved."""
    hot_path = str(tmp_path / "log")
    spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").alias("i"), F.lit("a").alias("c")).write.parquet(hot_path)
    placed = O.ranked_chunks(spark.read.parquet(hot_path), ["k"], ["i"], max_rows=50)
    for job in (O.repeated_calls(placed, ["k"], ["i"], F.col("chunk"), ["c"]), O.running_sums(placed, ["k"], ["i"], F.col("chunk"), {"s": F.col("i")})):
        assert hot_path not in plan(job) and job.count() > 0
    short = O.ranked_chunks(spark.read.parquet(hot_path), ["k"], ["i"], max_rows=500)
    assert "Exchange" not in plan(short) and per_task_rows(short, "k", "chunk") <= 500


def test_short_and_long_keys_give_the_same(spark, hot):
    """The plain windows for short keys and the chunked way agree, and the plain ones read the log once, after a count."""
    line, gaps = F.col("line"), F.when(F.col("i") % 13 == 0, F.lit(None)).otherwise(F.col("k"))
    path = shared_folder(spark) + "/short_log"
    hot.where("k < 40").withColumn("k", gaps).write.mode("overwrite").parquet(path)
    log = spark.read.parquet(path)
    jobs = {
        "errors": lambda rows: O.first_error_rows(rows, ["k"], ["i"], F.col("chunk"), T.matches_trace(line), line.startswith("venv")),
        "repeats": lambda rows: O.repeated_calls(rows, ["k"], ["i"], F.col("chunk"), ["line"], times=2),
        "sums": lambda rows: O.running_sums(rows, ["k"], ["i"], F.col("chunk"), {"s": F.col("i")}),
        "breach": lambda rows: O.first_breach(rows, ["k"], ["i"], F.col("chunk"), {"t": (F.col("i"), 30_000)}),
    }
    short, long = O.ranked_chunks(log, ["k"], ["i"], max_rows=10**6), O.ranked_chunks(log, ["k"], ["i"], max_rows=100)
    assert O.is_short(short, F.col("chunk")) and not O.is_short(long, F.col("chunk")) and not O.is_short(log, O.position_chunk("i"))
    for job in jobs.values():
        one, other = job(short).drop("chunk"), job(long).drop("chunk")
        assert one.count() > 0 and one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty()
        assert plan(one).count("Scan parquet") == 1 or plan(one).count("FileScan parquet") == 1


def test_windows_and_offsets_share_one_shuffle_of_the_rows(hot):
    """The running sum inside chunks and the join with the chunk table need the rows dealt by the same column."""
    text = plan(O.running_sums(hot.select("k", "i", "line"), ["k"], ["i"], O.position_chunk("i", STEP), {"s": F.col("i")}))
    rows = [line for line in text.splitlines() if "Exchange hashpartitioning(_group" in line]
    assert len(rows) in (1, 2)  # the rows once; the chunk table once, or broadcast


def test_top_rows_meet_in_two_stages(spark, hot):
    got = O.latest_rows(hot.repartition(12).withColumn("k", F.lit(1)), ["k"], [F.col("i").desc()], cap=5)
    assert sorted(r["i"] for r in got.collect()) == list(range(ROWS - 5, ROWS))
    assert "_salt" in plan(got)


def test_scratch_keeps_results(spark):
    from opslens.session import materialize, scratch

    with scratch(spark):
        with scratch(spark):
            inner, kept = materialize(spark.range(3), "inner"), materialize(spark.range(4), "kept", result=True)
        assert kept.count() == 4
        with pytest.raises(Exception):  # noqa: B017, PT011
            inner.count()
    with pytest.raises(Exception):  # noqa: B017, PT011
        kept.count()


def test_landed_lines_are_read_and_parsed_once(spark, tmp_path):
    from opslens.plans.weekly_report import weekly_report
    from opslens.sources import landing as L

    day = '"fetched_at": "2024-03-0%d", "body": {'
    body = '{"data": {"repository": {"issues": {"nodes": [{"closedAt": "2024-03-09T00:00:00Z"}]}}}}'
    lines = {
        "activity": [f'{{"repo": "o/r", "has_token": true, "http_status": 200, "body": {body}}}', '{"repo": "o/r", "has_token": true, "http_status": 500}'],
        "usage": [f'{{"provider": "openai", "has_key": true, "http_status": 200, {day % k}"tokens_in": {k}}}}}' for k in (2, 3, 1)],
        "costs": [f'{{"provider": "aws", "has_credentials": true, {day % k}}}}}' for k in (1, 2)],
    }
    for name, each in lines.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.json").write_text("\n".join(each) + "\n")
    activity, usage, costs = (f(spark, str(tmp_path / n)) for f, n in ((L.read_activity, "activity"), (L.read_usage, "usage"), (L.read_costs, "costs")))
    newest = M.latest_per_source(M.enabled_only(usage, ["openai", "gemini"]))
    optimized = newest._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("from_json") == 1 and optimized.count("Relation") == 1 and newest.first()["body"]["tokens_in"] == 3
    projects = L.projects(spark.createDataFrame([('{"p": {"repo": "o/r"}}',)], "config string"))
    report = weekly_report(projects, activity, usage, costs, as_of="2024-03-10T00:00:00Z")
    assert not [f for f in report.inputFiles() if "/activity/" in f]  # their sums are stored
    row = report.first()
    assert row["stats"]["github"]["bugs_closed"] == 1 and row["stats"]["openai"]["tokens_in"] == 3
    assert row["warnings"] == {"github": "API error: 500"}
