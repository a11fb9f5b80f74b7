"""From file to file: payloads and texts made from the tables are written, read by the library's readers and go through its public jobs."""

import uuid

from pyspark.sql import functions as F

from checks import metrics as CM
from checks.logs import NOISY_SQL, noisy
from checks.projects import report_messages
from checks.registry import SQL, check, table
from opslens import values as V
from opslens.functions.text import tokens_at_least_one
from opslens.operators import classify as C
from opslens.operators import metrics as M
from opslens.operators import report as R
from opslens.operators.closure import expand_includes
from opslens.plans import documents as D
from opslens.plans import logs as PL
from opslens.plans.weekly_report import message_outbox
from opslens.plans.weekly_report import weekly_report as weekly_job
from opslens.session import materialize, shared_folder
from opslens.sources import corpus as SC
from opslens.sources import landing as L


def place(spark):
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def written_report(spark, folder):
    """The job over landed files, whose bodies become JSON text when they are written; the configuration is a file too."""
    at = place(spark)
    CM.raw_activity(CM.activity_orders(spark, folder)).write.json(f"{at}/activity")
    CM.raw_usage(spark, folder).drop("event_id").write.partitionBy("provider").json(f"{at}/usage")
    CM.raw_costs(spark, folder).drop("o_orderkey").write.json(f"{at}/costs")
    CM.landed_configs(spark, folder).select("config").write.text(f"{at}/configs")
    projects = L.projects(spark.read.text(f"{at}/configs").toDF("config"))
    landed = [read(spark, f"{at}/{name}") for name, read in (("activity", L.read_activity), ("usage", L.read_usage), ("costs", L.read_costs))]
    return weekly_job(projects, *landed, as_of=CM.ORDERS_AS_OF), at


@check(SQL[report_messages.__name__])
def weekly_report_from_files(spark, folder):
    report, at = written_report(spark, folder)
    R.write_outbox(report, f"{at}/outbox")
    outbox = spark.read.schema("project string, destination string, payload string, sink string").json(f"{at}/outbox")
    return outbox.where("sink = 'slack'").drop("sink")


@check(SQL["report_routes"])
def weekly_outbox_routes(spark, folder):
    report, _ = written_report(spark, folder)
    return message_outbox(report).drop("payload")


@check(SQL["report_routes"])
def outbox_written_twice(spark, folder):
    """A run that is written a second time, and another one beside it, of which only the first is read."""
    report, at = written_report(spark, folder)
    report = materialize(report, "report")
    for run in ("2024-01", "2024-01", "2024-02", "2024-01"):
        R.write_outbox(report, f"{at}/outbox", run=run)
    schema = "project string, destination string, payload string, sink string"
    outbox = spark.read.schema(schema).json(f"{at}/outbox").where(F.contains("_metadata.file_name", F.lit("2024-01-")))
    return outbox.drop("payload")


def written_logs(spark, folder, text):
    """One log file a source, the texts of its documents in the order of their ids."""
    at = place(spark)
    docs = table(spark, folder, "documents").select("source", "doc_id", text.alias("value"))
    docs = docs.repartition("source").sortWithinPartitions("source", "doc_id")
    docs.select("source", "value").write.partitionBy("source").text(f"{at}/logs")
    lines = SC.read_log_lines(spark, f"{at}/logs", by_project=True)
    lines.write.parquet(f"{at}/lines")
    return spark.read.schema(lines.schema).parquet(f"{at}/lines")


FILE_LINES_SQL = """
    SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id, i) AS spot, line
    FROM (SELECT source, doc_id, l[i] AS line, i FROM (
      SELECT source, doc_id, l, unnest(range(1, len(l) + 1)) AS i
      FROM (SELECT source, doc_id, string_split({text}, chr(10)) AS l FROM documents)))
"""


@check(
    f"""
    WITH r AS (
      SELECT source, spot, regexp_replace(line, '[\\s\\x{{1c}}-\\x{{1f}}\\x{{a0}}]+$', '') AS line,
             CASE WHEN regexp_matches(line, 'Traceback \\(most recent call last\\):|panic: |AssertionError|panicked at|stack backtrace:|Exception in thread|\\w+Exception:|(TypeError|ReferenceError|SyntaxError|Error):') THEN 0
                  WHEN regexp_matches(line, '^\\s*at ') THEN 1 END AS kind, count(*) OVER (PARTITION BY source) AS n
      FROM ({FILE_LINES_SQL.format(text=NOISY_SQL)})
    ), f AS (SELECT source, min(spot) AS m, min_by(kind, spot) AS kind FROM r WHERE kind IS NOT NULL GROUP BY source)
    SELECT r.source, r.line FROM r LEFT JOIN f USING (source)
    WHERE CASE WHEN f.m IS NULL THEN r.spot > r.n - 40 WHEN f.kind = 0 THEN r.spot BETWEEN f.m AND f.m + 99 ELSE r.spot BETWEEN f.m - 1 AND f.m + 98 END
    """
)
def first_errors_of_log_files(spark, folder):
    lines = written_logs(spark, folder, noisy())
    kept = PL.extract_first_error(lines, ["project", "path"], ["block", "line_no"], F.col("block"))
    return kept.select(F.replace("project", F.lit("source=")).alias("source"), "line")


VENDOR_SQL = "replace(replace(text, 'License', 'FAILED'), ' of ', ' venv/of ')"


@check(
    f"""
    WITH r AS (
      SELECT *, regexp_matches(line, 'Exception|Error:|Traceback|FAILED|AssertionError|ERROR|CRITICAL') AS err,
             regexp_matches(line, 'node_modules/|venv/|site-packages/|/lib/python|/usr/lib/|external/') AS vendor
      FROM ({FILE_LINES_SQL.format(text=VENDOR_SQL)})
    ), f AS (SELECT source, min(CASE WHEN err THEN spot END) AS m FROM r GROUP BY source)
    SELECT source, line FROM r JOIN f USING (source) WHERE err OR NOT vendor OR f.m IS NULL OR spot < f.m
    """
)
def pruned_log_files(spark, folder):
    text = F.replace(F.replace(F.col("text"), F.lit("License"), F.lit("FAILED")), F.lit(" of "), F.lit(" venv/of "))
    kept = PL.prune_log_lines(written_logs(spark, folder, text), ["project", "path"], ["block", "line_no"], F.col("block"))
    return kept.select(F.replace("project", F.lit("source=")).alias("source"), "line")


@check("SELECT source, string_agg(text, chr(10) ORDER BY doc_id) || chr(10) AS content FROM documents GROUP BY source")
def documents_from_files(spark, folder):
    at = place(spark)
    docs = table(spark, folder, "documents").select("source", "doc_id", F.col("text").alias("value"))
    docs = docs.repartition("source").sortWithinPartitions("source", "doc_id")
    docs.select("source", "value").write.partitionBy("source").text(f"{at}/docs")
    read = SC.read_documents(spark, f"{at}/docs", "*.txt", by_project=True).where("error IS NULL")
    return read.select(F.replace("project", F.lit("source=")).alias("source"), "content")


@check(
    """
    SELECT source AS project, 1 AS files, CASE WHEN bool_or(doc_id % 97 = 5) THEN 1 ELSE 0 END AS unreadable,
           CASE WHEN bool_or(doc_id % 97 = 5) THEN 0 ELSE greatest(1, CAST(sum(length(text) + 1) AS BIGINT) // 4) END AS tokens,
           CAST(sum(octet_length(encode(text)) + CASE WHEN doc_id % 97 = 5 THEN 2 ELSE 1 END) AS BIGINT) AS bytes
    FROM documents GROUP BY source
    UNION ALL SELECT 'none', 1, 0, 1, 0
    """
)
def scanned_files(spark, folder):
    """Every file counts, also one without a byte and those that are no text: a byte that UTF-8 never has ends some documents."""
    at = place(spark)
    broken = F.when(F.col("doc_id") % 97 == 5, F.expr("CAST(unhex('FF') AS STRING)")).otherwise("")
    docs = table(spark, folder, "documents").select("source", "doc_id", F.concat("text", broken).alias("value"))
    docs.repartition("source").select("source", "value").write.partitionBy("source").text(f"{at}/docs")
    docs.where("false").select("value").coalesce(1).write.text(f"{at}/docs/source=none")
    read = SC.read_documents(spark, f"{at}/docs", "*.txt", by_project=True)
    sizes = SC.read_manifest(spark, f"{at}/docs", by_project=True).where(F.endswith("path", F.lit(".txt")))
    tokens = F.when(F.col("error").isNull(), tokens_at_least_one(F.col("content"))).otherwise(0)
    both = read.join(sizes, ["project", "path"]).groupBy(F.replace("project", F.lit("source=")).alias("project"))
    return both.agg(
        F.count("*").cast("int").alias("files"),
        F.count("error").cast("int").alias("unreadable"),
        F.sum(tokens).alias("tokens"),
        F.sum("length").alias("bytes"),
    )


# Every third document is no template; its text keeps the folder mention and gets the folder slot and the tool names.
NAME_SQL = "'d' || {id} || CASE WHEN ({id}) % 3 = 0 THEN '.txt' ELSE '.md' END"
RENDERED_SQL = f"""
    SELECT {NAME_SQL.format(id="doc_id")} AS path,
           text || chr(10) || '.c Glob ' || CASE WHEN doc_id % 3 = 0 THEN '{V.FOLDER_MENTION}' ELSE '.c' END || chr(10)
           || '@' || {NAME_SQL.format(id="doc_id // 10")} AS content FROM documents
"""


@check(
    f"""
    WITH RECURSIVE docs AS ({RENDERED_SQL}), lines AS (
      SELECT path, l[i] AS line, CASE WHEN starts_with(trim(l[i]), '@') AND NOT starts_with(trim(l[i]), '@ ') THEN trim(trim(l[i])[2:]) END AS target
      FROM (SELECT path, l, unnest(range(1, len(l) + 1)) AS i
            FROM (SELECT path, string_split_regex(content, '\\r\\n|[\\n\\r\\x{{0b}}\\x{{0c}}\\x{{1c}}-\\x{{1e}}\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS l FROM docs))
    ), linked AS (SELECT l.path, line, CASE WHEN d.path IS NOT NULL THEN target END AS target FROM lines l LEFT JOIN docs d ON d.path = l.target),
    tree AS (
      SELECT path AS root, line, CASE WHEN target <> path THEN target END AS target, [path] AS open FROM linked WHERE path LIKE '%.md'
      UNION ALL
      SELECT t.root, l.line, CASE WHEN NOT list_contains(list_append(t.open, t.target), l.target) THEN l.target END, list_append(t.open, t.target)
      FROM tree t JOIN linked l ON l.path = t.target
    )
    SELECT root, line FROM tree WHERE target IS NULL
    """
)
def inlined_templates(spark, folder):
    doc = F.col("doc_id")
    name = lambda i: F.concat(F.lit("d"), i, F.when(i % 3 == 0, ".txt").otherwise(".md"))
    content = F.concat(F.col("text"), F.lit(f"\n{V.FOLDER_SLOT} - glob {V.FOLDER_MENTION}\n@"), name(F.floor(doc / 10)))
    files = table(spark, folder, "documents").select(name(doc).alias("path"), content.alias("content"))
    lines = D.inline_templates(files, "claude", ".c").select("root", "line")
    return lines.withColumn("line", F.replace("line", F.lit("- Glob"), F.lit("Glob")))


ROUTING_NOTE = V.ROUTING_FORMAT % "`@one`, `@two`"


@check(
    f"""
    SELECT doc_id, replace(replace(text, ' the ', '{V.ROUTING_MARKER}'), '{V.ROUTING_MARKER}',
                           CASE WHEN doc_id % 2 = 0 THEN '{ROUTING_NOTE.replace("'", "''")}{V.ROUTING_MARKER}' ELSE '{V.ROUTING_MARKER}' END) AS content
    FROM documents
    """
)
def routed_rules(spark, folder):
    name = F.when(F.col("doc_id") % 2 == 0, f"rules/{V.ROUTING_FILE}").otherwise("rules/other.md")
    text = F.replace("text", F.lit(" the "), F.lit(V.ROUTING_MARKER))
    files = table(spark, folder, "documents").select("doc_id", name.alias("path"), text.alias("content"))
    return D.inject_routing(files, F.array(F.lit("one"), F.lit("two"))).select("doc_id", "content")


@check(
    """
    SELECT p_partkey, p_brand AS category, p_name AS name, coalesce(CASE WHEN p_size % 2 = 0 THEN 'mcp' END, '') AS type FROM part
    UNION ALL SELECT p_partkey, p_brand, p_type, '' FROM part
    """
)
def registry_tool_rows(spark, folder):
    tool = F.struct(F.col("p_name").alias("name"), F.when(F.col("p_size") % 2 == 0, "mcp").alias("type"))
    other = F.struct(F.col("p_type").alias("name"), F.lit(None).cast("string").alias("type"))
    registry = F.to_json(F.struct(F.create_map(F.col("p_brand"), F.array(tool, other)).alias("categories")))
    found = L.tool_rows(table(spark, folder, "part").select("p_partkey", registry.alias("registry")))
    return found.select("p_partkey", "category", "name", F.coalesce("type", F.lit("")).alias("type"))


@check("SELECT event_id, user_id, json_extract_string(props, '$.k') AS k FROM events")
def snapshot_of_events(spark, folder):
    at = place(spark)
    events = table(spark, folder, "events")
    props = F.from_json("props", "map<string,string>")
    R.write_snapshot(events.select("event_id", "user_id", props.alias("props"), "value"), f"{at}/snapshot", fields=["event_id", "user_id", "props"])
    back = spark.read.schema("event_id bigint, user_id bigint, props map<string,string>").json(f"{at}/snapshot")
    return back.select("event_id", "user_id", F.col("props")["k"].alias("k"))


@check(
    """
    SELECT k, CASE WHEN k % 10 = 4 THEN 'Malformed record' WHEN k % 3 = 0 THEN 'Missing API key' ELSE '' END AS error,
           count(*) AS lines, CAST(sum(CASE WHEN k % 10 <> 4 AND k % 3 <> 0 THEN event_id ELSE 0 END) AS BIGINT) AS tokens_in
    FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY k
    """
)
def malformed_usage_lines(spark, folder):
    """Cut-off landed lines are rows with an error."""
    at, k = place(spark), F.get_json_object("props", "$.k").cast("bigint")
    record = F.struct(
        F.lit("openai").alias("provider"), (k % 3 != 0).alias("has_key"), F.lit(200).alias("http_status"),
        F.struct(F.col("event_id").alias("tokens_in")).alias("body"),
    )
    text = F.when(k % 10 == 4, '{"provider": "openai", "has').otherwise(F.to_json(record))
    table(spark, folder, "events").select(k.alias("k"), text.alias("value")).write.partitionBy("k").text(f"{at}/usage")
    records = M.usage_records(L.read_usage(spark, f"{at}/usage"))
    return records.groupBy(F.col("k").cast("bigint").alias("k"), F.coalesce("error", F.lit("")).alias("error")).agg(
        F.count("*").alias("lines"), F.sum("tokens_in").alias("tokens_in")
    )


@check(
    """
    SELECT event_type AS provider, max(event_id) AS event_id FROM events e
    WHERE ts = (SELECT max(ts) FROM events f WHERE f.event_type = e.event_type) GROUP BY event_type
    """
)
def newest_of_any_source(spark, folder):
    """Sources that no list names."""
    when = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("fetched_at")
    records = table(spark, folder, "events").select(F.col("event_type").alias("provider"), when, "event_id")
    return M.latest_per_source(records).select("provider", "event_id")


@check(
    """
    SELECT p_size AS project, string_agg(DISTINCT 'label' || lpad(CAST(p_partkey % 150 AS VARCHAR), 3, '0'), ', ' ORDER BY 'label' || lpad(CAST(p_partkey % 150 AS VARCHAR), 3, '0')) AS stack
    FROM part GROUP BY p_size
    """
)
def stacks_of_many_labels(spark, folder):
    markers = {f"file{i}": f"label{i:03d}" for i in range(150)}
    files = table(spark, folder, "part").select(F.col("p_size").alias("project"), F.concat(F.lit("src/file"), F.col("p_partkey") % 150).alias("path"))
    return C.classify_projects(files, markers=markers)


@check(
    """
    SELECT CAST(i - 1 AS BIGINT) AS at, l[i] AS line FROM (
      SELECT l, unnest(range(1, len(l) + 1)) AS i
      FROM (SELECT string_split(string_agg(replace(text, chr(10), ' '), chr(10) ORDER BY doc_id), chr(10)) AS l FROM documents))
    """
)
def deep_include_chain(spark, folder):
    """Document 0 includes 1, that 2, and so on to the last of the table."""
    doc = F.col("doc_id")
    name = F.when(doc < table(spark, folder, "documents").agg(F.max("doc_id")).scalar(), F.concat(F.lit("\n@d"), doc + 1)).otherwise("")
    content = F.concat(F.replace("text", F.lit("\n"), F.lit(" ")), name)
    docs = table(spark, folder, "documents").select(F.concat(F.lit("d"), doc).alias("path"), content.alias("content"))
    lines = expand_includes(docs, roots=F.col("path") == "d0", numbered=True)
    return lines.select(F.col("level").cast("bigint").alias("at"), "line")
