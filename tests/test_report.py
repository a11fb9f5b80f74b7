import json
from decimal import Decimal

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from opslens import schemas as S
from opslens.operators import metrics as M
from opslens.operators import report as R
from opslens.plans.weekly_report import weekly_report
from opslens.sources import landing as L

AS_OF = "2024-03-10T12:00:00Z"
NOW, OLD, EDGE = "2024-03-10T11:00:00Z", "2024-03-02T12:00:00Z", "2024-03-03T12:00:00Z"


def change(created, merged, added, deleted):
    return {"createdAt": created, "mergedAt": merged, "additions": added, "deletions": deleted}


def activity_body(prs=(), issues=(), releases=()):
    return {
        "data": {
            "repository": {
                "pullRequests": {"nodes": list(prs)},
                "issues": {"nodes": [{"closedAt": t} for t in issues]},
                "releases": {"nodes": [{"createdAt": t} for t in releases]},
            }
        }
    }


def landed(spark, folder, records, reader):
    path = folder / "landing.json"
    path.write_text("\n".join(json.dumps(r) for r in records))
    return reader(spark, str(path))


def activity(repo, body=None, status=200, token=True, exception=None):
    return {"repo": repo, "has_token": token, "http_status": status, "exception": exception, "body": body}


MIXED = activity_body(
    [change(OLD, NOW, 100, 50), change(NOW, None, 200, 10), change(NOW, NOW, 300, 20), change(NOW, None, 50, 5)], [NOW, OLD]
)


def test_payload_metrics(spark, tmp_path):
    full = activity_body([change(NOW, NOW, 100, 50), change(NOW, NOW, 200, 10)], [NOW] * 5, [NOW] * 2)
    edge = activity_body([change(EDGE, EDGE, None, 1)], [None], ["bad", EDGE])
    rows = landed(
        spark,
        tmp_path,
        [
            activity("o/mixed", MIXED),
            activity("o/full", full),
            activity("o/edge", edge),
            activity("o/token", MIXED, token=False),
            activity("", MIXED),
            activity("a/b/c", MIXED),
            activity("o/404", status=404),
            activity("o/down", status=None, exception="Connection error"),
            activity("o/query", {"errors": [{"message": "no scope"}]}),
            activity("o/gone", {"data": {"repository": None}}),
            activity("o/void", {"data": {"repository": {}}}),
        ],
        L.read_activity,
    )
    got = {r["repo"]: tuple(r)[1:] for r in M.payload_metrics(rows, AS_OF).collect()}
    zero = (0, 0, 0, 0, 0)
    assert got["o/mixed"] == (3, 400, 70, 1, 0, None)
    assert got["o/full"] == (2, 300, 60, 5, 2, None)
    assert got["o/edge"] == (1, 0, 1, 0, 1, None)
    assert got["o/token"] == (*zero, "Missing token or repo") and got[""] == (*zero, "Missing token or repo")
    assert got["a/b/c"] == (*zero, "Invalid repo format. Expected owner/repo")
    assert got["o/404"] == (*zero, "API error: 404")
    assert got["o/down"] == (*zero, "Connection error")
    assert got["o/query"] == (*zero, "GraphQL error: no scope")
    assert got["o/gone"] == (*zero, "Repository not found") and got["o/void"] == got["o/gone"]


def usage(provider, body=None, status=200, key=True, exception=None, at=NOW):
    return {"provider": provider, "has_key": key, "http_status": status, "exception": exception, "fetched_at": at, "body": body}


def cost(provider, amounts=None, given=True, exception=None, at=NOW):
    body = None if amounts is None else {"ResultsByTime": [{"Total": {"UnblendedCost": {"Amount": a}}} for a in amounts]}
    return {"provider": provider, "has_credentials": given, "exception": exception, "fetched_at": at, "body": body}


def test_usage_records(spark, tmp_path):
    rows = landed(
        spark,
        tmp_path,
        [
            usage("openai", {"tokens_in": 1000, "tokens_out": 500, "prompts": 10, "cost": 0.05, "model": "m"}),
            usage("anthropic", {"tokens_in": 1000}),
            usage("gemini", {"tokens_in": 1}, status=401),
            usage("openai", {}, key=False, at=OLD),
        ],
        L.read_usage,
    )
    got = {(r["provider"], r["fetched_at"]): r for r in M.usage_records(rows).collect()}
    first = got["openai", NOW]
    assert (first["model"], first["tokens_in"], first["tokens_out"], first["prompts"], first["cost"], first["error"]) == (
        "m", 1000, 500, 10, Decimal("0.05"), None,
    )
    part = got["anthropic", NOW]
    assert (part["model"], part["tokens_in"], part["tokens_out"], part["cost"]) == ("claude-3-opus", 1000, 0, 0)
    failed = got["gemini", NOW]
    assert (failed["model"], failed["tokens_in"], failed["error"]) == ("unknown", 0, "API error: 401")
    assert got["openai", OLD]["error"] == "Missing API key"
    latest = {r["provider"]: r["error"] for r in M.latest_per_source(M.usage_records(rows)).collect()}
    assert latest == {"openai": None, "anthropic": None, "gemini": "API error: 401"}


def test_cost_records(spark, tmp_path):
    rows = landed(
        spark,
        tmp_path,
        [cost("aws", ["10.00", "2.50"]), cost("gcp", ["1"]), cost("aws", None, exception="denied", at=OLD), cost("gcp", None, given=False, at=OLD)],
        L.read_costs,
    )
    got = {(r["provider"], r["fetched_at"]): (r["cost"], r["status"], r["error"]) for r in M.cost_records(rows).collect()}
    assert got == {
        ("aws", NOW): (Decimal("12.5"), "success", None),
        ("gcp", NOW): (0, "stubbed", None),
        ("aws", OLD): (0, "error", "denied"),
        ("gcp", OLD): (0, "error", "Missing GCP credentials"),
    }


CONFIG = '{"proj-1":{"slack_channel_id":"C1","repo":"o/mixed"},"proj-2":{"teams_url":"http://teams","repo":"o/404"},"proj-3":{"slack_channel_id":"C3","teams_url":"t3"}}'


def projects(spark, *configs):
    return L.projects(spark.createDataFrame([(c,) for c in configs], "config string"))


def test_projects(spark):
    got = projects(spark, CONFIG).collect()
    assert [(r["project"], r["has_repo"], r["repo"], r["teams_url"]) for r in got] == [
        ("proj-1", True, "o/mixed", None), ("proj-2", True, "o/404", "http://teams"), ("proj-3", False, None, "t3"),
    ]
    assert projects(spark, "{broken").collect() == []
    absent = projects(spark, None).collect()
    assert [(r["project"], r["has_repo"], r["repo"]) for r in absent] == [("default-proj", True, None)]


def build(spark, tmp_path, config=CONFIG, enabled=("github", "openai", "anthropic", "gemini", "aws", "gcp")):
    folders = [tmp_path / n for n in "auc"]
    for f in folders:
        f.mkdir()
    acts = landed(spark, folders[0], [activity("o/mixed", MIXED), activity("o/404", status=404)], L.read_activity)
    uses = landed(
        spark, folders[1], [usage("openai", {"tokens_in": 5, "cost": 0.05, "model": "m"}), usage("gemini", {}, status=401)], L.read_usage
    )
    bills = landed(spark, folders[2], [cost("aws", ["10.00", "2.50"]), cost("gcp", [])], L.read_costs)
    return weekly_report(projects(spark, config), acts, uses, bills, AS_OF, enabled=enabled)


def test_weekly_report(spark, tmp_path):
    report = build(spark, tmp_path)
    got = {r["project"]: r for r in report.collect()}
    assert got["proj-1"]["warnings"] == {"gemini": "API error: 401"}
    assert got["proj-2"]["warnings"] == {"github": "API error: 404", "gemini": "API error: 401"}
    assert tuple(got["proj-1"]["stats"]["github"]) == (3, 400, 70, 1, 0)
    assert tuple(got["proj-2"]["stats"]["github"]) == (0, 0, 0, 0, 0) and got["proj-3"]["stats"]["github"] is None
    assert got["proj-3"]["stats"]["openai"]["tokens_in"] == 5 and got["proj-3"]["stats"]["anthropic"] is None
    assert got["proj-3"]["stats"]["gemini"]["model"] == "unknown"
    assert got["proj-1"]["stats"]["aws"]["cost"] == Decimal("12.5") and got["proj-1"]["stats"]["gcp"]["status"] == "stubbed"

    blocks = {r["project"]: json.loads(r["payload"]) for r in R.message_payload(report).collect()}
    assert [b["type"] for b in blocks["proj-1"]["blocks"]] == ["header", "section", "section", "section", "context"]
    assert len(blocks["proj-3"]["blocks"]) == 4
    header = blocks["proj-1"]["blocks"][0]
    assert header == {"type": "header", "text": {"type": "plain_text", "text": "Project Report: proj-1", "emoji": True}}
    assert "• *Lines Added:* 400\n" in blocks["proj-1"]["blocks"][1]["text"]["text"]
    assert blocks["proj-1"]["blocks"][2]["text"]["text"].split("\n")[1:] == [
        "• *Openai*: model `m` | In: 5 | Out: 0 | Cost: $0.0500", "• *Gemini*: model `unknown` | In: 0 | Out: 0 | Cost: $0.0000",
    ]
    assert blocks["proj-1"]["blocks"][3]["text"]["text"].split("\n")[1:] == ["• *AWS:* $12.50", "• *GCP:* $0.00"]
    assert blocks["proj-2"]["blocks"][4]["elements"] == [
        {"type": "mrkdwn", "text": ":warning: _github: API error: 404\ngemini: API error: 401_"}
    ]

    routes = {(r["project"], r["sink"]): r for r in R.routed(report).collect()}
    assert set(routes) == {("proj-1", "slack"), ("proj-2", "teams"), ("proj-3", "slack"), ("proj-3", "teams")}
    raw = json.loads(routes["proj-2", "teams"]["payload"])
    assert raw["stats"]["aws"] == {"cost": 12.5, "status": "success"} and "anthropic" not in raw["stats"]
    assert json.loads(routes["proj-1", "slack"]["payload"])["channel"] == "C1"

    R.write_outbox(report, str(tmp_path / "outbox"))
    assert spark.read.json(str(tmp_path / "outbox")).groupBy("sink").count().count() == 2


def test_outbox_takes_a_run_once(spark, tmp_path):
    """Repeated, broken and aborted writes of a run; other runs stay."""
    from opslens.sources import outbox as X

    at = str(tmp_path / "outbox")
    record = lambda n: pa.RecordBatch.from_pylist([{"sink": s, "project": f"{s}{n}", "payload": None} for s in ("a/b", "c", None)])
    read = lambda: sorted((r["sink"] or "", r["project"]) for r in spark.read.schema("project string, sink string").json(at).collect())
    once = [("", "None1"), ("a/b", "a/b1"), ("c", "c1")]

    def write(n, run="one", overwrite=False, tasks=1):
        writer = X.OutboxWriter(f"file://{at}", run, "sink", overwrite)
        return writer, [writer.write(iter([record(n)])) for _ in range(tasks)]

    writer, messages = write(0)
    writer.abort(messages)
    assert not (tmp_path / "outbox" / "_runs" / "one").exists()
    write(0)  # a driver that died before the commit
    writer, messages = write(1, tasks=2)
    writer.commit([*messages[:1], None])  # the second task is one that Spark does not count
    assert read() == once
    for n in (1, 2):
        writer, messages = write(n)
        writer.commit(messages)
        assert read() == once
    writer, messages = write(3, "one-more")
    writer.commit(messages)
    assert len(read()) == 6
    (tmp_path / "outbox" / "_runs" / "one.done").unlink()  # the attempt broke off after it had moved its files
    writer, messages = write(1)
    writer.commit(messages)
    assert len(read()) == 6 and set(once) < set(read())
    writer, messages = write(1, "last", overwrite=True)
    writer.commit(messages)
    assert read() == once
    with pytest.raises(ValueError):
        X.OutboxWriter(at, "../up", "sink", False)


def test_outbox_of_a_report(spark, tmp_path):
    report = build(spark, tmp_path)
    at = str(tmp_path / "twice")
    for _ in range(2):
        R.write_outbox(report, at, run="2024-03-10")
    assert spark.read.json(at).count() == R.routed(report).count()
    R.write_outbox(report, at)
    assert spark.read.json(at).count() == 2 * R.routed(report).count()
    R.write_outbox(report, at, mode="overwrite")
    assert spark.read.json(at).count() == R.routed(report).count()


def test_finished_run_makes_no_report(spark, tmp_path, monkeypatch):
    report = spark.createDataFrame([("p", 1)], "project string, n int")
    made = []

    def routed(df):
        made.append(1)
        return df.select("project", F.lit("slack").alias("sink"), F.lit("C1").alias("destination"), F.lit("{}").alias("payload"))

    monkeypatch.setattr(R, "routed", routed)
    at = str(tmp_path / "finished")
    for run in ("one", "one", "two", "one"):
        R.write_outbox(report, at, run=run)
    assert len(made) == 2 and spark.read.json(at).count() == 2
    R.write_outbox(report, at, mode="overwrite", run="one")
    assert len(made) == 3 and spark.read.json(at).count() == 1


def test_source_gating(spark, tmp_path):
    got = {r["project"]: r for r in build(spark, tmp_path, enabled=("openai",)).collect()}
    stats = got["proj-1"]["stats"]
    assert stats["github"] is None and stats["openai"] is not None and stats["gemini"] is None and stats["aws"] is None
    assert got["proj-1"]["warnings"] is None


def test_default_project_reports_missing_repo(spark, tmp_path):
    got = build(spark, tmp_path, config=None).collect()
    assert got[0]["warnings"]["github"] == "Missing token or repo" and tuple(got[0]["stats"]["github"]) == (0,) * 5


def test_flat_counters(spark):
    rows = spark.createDataFrame(
        [("r", OLD, NOW, 100, 50), ("r", NOW, None, 200, 10), ("r", EDGE, NOW, None, 20), ("q", OLD, OLD, 9, 9)],
        "repo string, c string, m string, a bigint, d bigint",
    )
    from opslens.functions.temporal import parse_iso

    got = rows.groupBy("repo").agg(*M.change_counters(parse_iso(F.col("c")), parse_iso(F.col("m")), F.col("a"), F.col("d"), AS_OF))
    assert {tuple(r) for r in got.collect()} == {("r", 2, 100, 70), ("q", 0, 0, 0)}
    names = spark.createDataFrame([("r",), ("z",)], "repo string")
    full = M.zero_filled(names, got, ["repo"], ["prs_submitted", "lines_added", "lines_deleted"])
    assert {tuple(r) for r in full.collect()} == {("r", 2, 100, 70), ("z", 0, 0, 0)}
    issues = spark.createDataFrame(
        [("CLOSED", ["bug"], NOW), ("OPEN", ["bug"], NOW), ("CLOSED", ["x"], NOW), ("CLOSED", ["bug", "x"], OLD)], "s string, l array<string>, t string"
    )
    assert issues.agg(M.closed_bugs(F.col("s"), F.col("l"), parse_iso(F.col("t")), AS_OF)).first()[0] == 1
    assert S.ACTIVITY
