import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from opslens.functions import text as T
from opslens.operators import ordered as O
from opslens.operators import sessions as S

ROW = "doc string, pos bigint, line string"


def frame(spark, logs):
    rows = [(d, i * 3, line) for d, lines in logs.items() for i, line in enumerate(lines)]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, ROW)


def texts(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["doc"], r["pos"])):
        out.setdefault(r["doc"], []).append(r["line"])
    return out


LOGS = {
    "hit": ["a", "b", "Error: x"] + [f"l{i}" for i in range(150)],
    "call": ["a", "boom", "  at f", "Error: later"] + [f"l{i}" for i in range(150)],
    "call_on_top": ["at f"] + [f"l{i}" for i in range(150)],
    "none": [f"l{i}" for i in range(50)],
    "short": ["x", "y"],
    "same_line": ["q", "at f Error: both", "z"],
}


@pytest.mark.parametrize("limit", [0, 100_000])
@pytest.mark.parametrize("step", [1, 7, 60, 10_000])
def test_first_error_rows_match_whole_text_form(spark, step, limit):
    rows = frame(spark, LOGS)
    line = F.col("line")
    got = texts(
        O.first_error_rows(
            rows, ["doc"], ["pos"], O.position_chunk("pos", step), T.matches_trace(line), T.matches_call_site(line), broadcast_rows=limit
        )
    )
    whole = spark.createDataFrame([(d, "\n".join(v)) for d, v in LOGS.items()], "doc string, text string")
    expected = {r[0]: r[1] for r in whole.select("doc", T.first_error_lines(T.file_lines(F.col("text")))).collect()}
    assert got == expected
    assert len(got["hit"]) == 100 and got["call"][0] == "boom" and len(got["call_on_top"]) == 99 and len(got["none"]) == 40


@pytest.mark.parametrize("limit", [0, 100_000])
@pytest.mark.parametrize("step", [1, 5, 10_000])
def test_prune_rows(spark, step, limit):
    logs = {
        "a": ["line1", "node_modules/lib.js", "Error: boom", "venv/lib.py"],
        "b": ["line1", "node_modules/lib.js", "line2"],
        "c": ["CRITICAL", "venv/a.py Exception", "venv/b.py", "rest", "external/x"],
    }
    rows = frame(spark, logs)
    prune = lambda df: O.prune_rows(
        df, ["doc"], ["pos"], O.position_chunk("pos", step), T.matches_error(F.col("line")), T.matches_vendor(F.col("line")), limit
    )
    once = prune(rows)
    assert texts(once) == {
        "a": logs["a"][:3], "b": logs["b"], "c": ["CRITICAL", "venv/a.py Exception", "rest"],
    }
    assert texts(prune(once)) == texts(once)


CALLS = st.lists(st.tuples(st.sampled_from("kl"), st.sampled_from(["a", "b", None])), min_size=1, max_size=40)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(calls=CALLS, step=st.sampled_from([1, 3, 100]))
def test_repeated_calls(spark, calls, step):
    rows = spark.createDataFrame([(k, i, c) for i, (k, c) in enumerate(calls)], "k string, i bigint, call string")
    got = O.repeated_calls(rows, ["k"], ["i"], O.position_chunk("i", step), ["call"], times=3)
    found = sorted((r["k"], r["i"], r["call"] or "") for r in got.collect())
    expected = []
    for key in "kl":
        mine = [(i, c) for i, (k, c) in enumerate(calls) if k == key]
        expected += [(key, mine[j][0], mine[j][1] or "") for j in range(2, len(mine)) if len({c for _, c in mine[j - 2 : j + 1]}) == 1]
    assert found == sorted(expected)


def test_running_sums_and_numbers(spark):
    rows = spark.createDataFrame([("a", i, float(i)) for i in range(100)] + [("b", 5, None), ("b", 9, 2.0)], "k string, i bigint, v double")
    got = O.running_sums(rows, ["k"], ["i"], O.position_chunk("i", 7), {"s": F.col("v")}).collect()
    by = {(r["k"], r["i"]): r["s"] for r in got}
    assert all(by["a", i] == sum(range(i + 1)) for i in range(100)) and by["b", 5] is None and by["b", 9] == 2.0
    numbered = O.row_numbers(rows, ["k"], ["i"], O.position_chunk("i", 7)).collect()
    assert {(r["k"], r["i"]): r["row_no"] for r in numbered if r["k"] == "b"} == {("b", 5): 1, ("b", 9): 2}
    chunks = O.item_chunks(rows, ["k"], ["i"], O.position_chunk("i", 7)).groupBy("k", "chunk_no").count().collect()
    assert {(r["k"], r["chunk_no"]): r["count"] for r in chunks} == {("a", 1): 40, ("a", 2): 40, ("a", 3): 20, ("b", 1): 2}


def test_first_breach(spark):
    rows = spark.createDataFrame(
        [("s", i, 10, 0.5, f"2024-01-01 00:00:{i * 5:02d}") for i in range(6)], "s string, i bigint, t bigint, c double, at string"
    ).withColumn("at", F.col("at").cast("timestamp_ntz"))
    got = O.first_breach(
        rows, ["s"], ["i"], O.position_chunk("i", 2), {"tokens": (F.col("t"), 25), "cost": (F.col("c"), 99)}, F.col("at"), 12
    )
    assert {(r["budget"], r["i"], r["total"]) for r in got.collect()} == {("tokens", 2, 30.0), ("wall_clock", 3, 15.0)}


def test_latest_rows(spark):
    rows = spark.createDataFrame([("a", i) for i in range(30)] + [("b", 1)], "k string, i bigint")
    got = O.latest_rows(rows, ["k"], [F.col("i").desc()], cap=3)
    assert {tuple(r) for r in got.collect()} == {("a", 29), ("a", 28), ("a", 27), ("b", 1)}
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


MESSAGES = [
    ("s", 0, "system", "x" * 40), ("s", 1, "user", "y" * 8), ("s", 2, "assistant", "z" * 20), ("s", 3, "user", "u" * 4),
    ("s", 4, "assistant", "v" * 13), ("t", 0, "user", "abc"),
]


@pytest.mark.parametrize("step", [1, 2, 1000])
def test_session_costs(spark, step):
    rows = spark.createDataFrame(MESSAGES, "conv_id string, turn bigint, role string, text string")
    chunk = O.position_chunk("turn", step)
    running = {(r["conv_id"], r["turn"]): r["context_tokens"] for r in S.running_cost(rows, chunk=chunk).collect()}
    assert [running["s", i] for i in range(5)] == [10, 12, 17, 18, 21]
    isolated = {(r["conv_id"], r["turn"]): r["context_tokens"] for r in S.isolated_cost(rows, chunk=chunk).collect()}
    assert [isolated["s", i] for i in range(5)] == [10, 2, 7, 1, 4]
    total = {r["conv_id"]: r for r in S.session_totals(rows, chunk=chunk).collect()}
    assert (total["s"]["turns"], total["s"]["final_context"], total["s"]["billed"]) == (5, 21, 78)
    assert (total["s"]["system_tokens"], total["s"]["user_tokens"], total["s"]["assistant_tokens"]) == (10, 3, 8)
    saved = {r["conv_id"]: r for r in S.session_savings(rows, chunk=chunk).collect()}
    assert (saved["s"]["cumulative"], saved["s"]["isolated"]) == (78, 24)
    assert saved["s"]["savings_pct"] == pytest.approx((1 - 24 / 78) * 100) and saved["t"]["savings_pct"] is None
    assert all(r["cumulative"] >= r["isolated"] for r in saved.values())


def test_published_savings(spark):
    """Totals of a published four-task comparison: 55,075 tokens against 38,789 save 29.6 %."""
    row = spark.range(1).select(S.savings_pct(F.lit(55_075), F.lit(38_789)).alias("p"), S.savings_pct(F.lit(0), F.lit(1)).alias("z"))
    assert round(row.first()["p"], 1) == 29.6 and row.first()["z"] is None
