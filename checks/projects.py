"""Project classification, tools, gates, enrichment and the full report (rows SC9, SC11, SC13, J1-J5, J10-J11, A7-A8, A14-A15, U2-U4, SK1-SK5, F5, F20)."""

import json

from pyspark.sql import functions as F

from checks import metrics as CM
from checks.registry import check, table
from opslens import values as V
from opslens.operators import classify as C
from opslens.operators import enrich as E
from opslens.operators import gates as G
from opslens.operators import report as R
from opslens.operators.metrics import repo_metrics
from opslens.plans.onboarding import domain_documents
from opslens.sources import landing as L

NAMES = [*V.TECH_MARKERS, "README.md", "main.c", "deep"]
LABELS = [*V.TECH_MARKERS.values(), None, None, None]
LABEL_SQL = "CASE k % 14 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(LABELS) if v) + " END"

# Three events make the file manifest of one project; every tenth value of k lies too deep to count.
STACK_SQL = f"""
    SELECT project, CASE WHEN len(labels) = 0 THEN 'Unknown Stack' ELSE array_to_string(list_sort(
             CASE WHEN len(list_filter(preferred, lambda x: contains(x, 'Node.js'))) > 0 THEN list_append(preferred, 'Frontend') ELSE preferred END), ', ') END AS stack
    FROM (
      SELECT project, labels, CASE WHEN list_contains(labels, 'Node.js/TypeScript') THEN list_filter(labels, lambda x: x <> 'Node.js/JavaScript') ELSE labels END AS preferred
      FROM (
        SELECT project, coalesce(list(DISTINCT label) FILTER (label IS NOT NULL), []) AS labels
        FROM (SELECT event_id // 3 AS project, CASE WHEN k % 10 <> 0 THEN {LABEL_SQL} END AS label
              FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))
        GROUP BY project
      )
    )
"""


def stacks(spark, folder):
    k = F.get_json_object("props", "$.k").cast("bigint")
    name = F.get(F.array(*[F.lit(n) for n in NAMES]), (k % 14).cast("int"))
    folder_name = F.when(k % 10 == 0, "a/b/").when(k % 3 == 0, "src/").otherwise("")
    manifest = table(spark, folder, "events").select(
        F.floor(F.col("event_id") / 3).alias("project"), F.concat(folder_name, name).alias("path")
    )
    return C.classify_projects(manifest)


@check(STACK_SQL)
def project_stacks(spark, folder):
    return stacks(spark, folder)


TOOLS = {
    "categories": {
        "frontend": [
            {"name": "styles", "url": "http://styles", "keywords": ["react"]},
            {"name": "browser", "command": "npx browser", "type": "mcp", "force_if_keywords": ["frontend"]},
            {"name": "browser-notes", "url": "http://notes", "type": "skill", "force_if_keywords": ["FRONTEND", "php"]},
        ],
        "backend": [
            {"name": "types", "url": "http://types", "force_if_keywords": ["python", "typescript"]},
            {"name": "crates", "command": "npx crates", "type": "mcp", "force_if_keywords": ["rust"]},
        ],
        "universal": [{"name": "beans", "url": "http://beans", "force_if_keywords": ["(java/"]}],
    }
}

FORCED_SQL = f"""
    SELECT project, stack, CAST(position AS BIGINT) AS position, category, name, coalesce(type, '') AS type FROM ({STACK_SQL}),
      (VALUES (1, 'frontend', 'browser', 'mcp', ['frontend']), (2, 'frontend', 'browser-notes', 'skill', ['frontend', 'php']),
              (3, 'backend', 'types', NULL, ['python', 'typescript']), (4, 'backend', 'crates', 'mcp', ['rust']),
              (5, 'universal', 'beans', NULL, ['(java/'])) t(position, category, name, type, words)
    WHERE len(list_filter(words, lambda w: contains(lower(stack), w))) > 0
"""


def tools():
    return L.registry_tools(F.lit(json.dumps(TOOLS)))


@check(FORCED_SQL)
def forced_tools(spark, folder):
    found = C.forced_tools(stacks(spark, folder), tools())
    return found.select("project", "stack", "position", "category", "name", F.coalesce("type", F.lit("")).alias("type"))


# A tool for each part, asked for by the digits of its key, by its brand and size, and by a word that no stack has.
@check(
    """
    WITH s AS (SELECT o_orderkey, 'Node ' || o_orderkey || ' on ' || o_orderpriority || ' Brand#' || (o_custkey % 30) || ' 1' AS stack FROM orders),
    w AS (
      SELECT p_partkey, unnest([CAST(p_partkey + 1000 AS VARCHAR), CASE WHEN p_partkey % 5 = 0 THEN upper(p_brand) || ' 1' ELSE 'nowhere' END,
                                CASE WHEN p_partkey = 7 THEN '' ELSE '?' || p_name END]) AS word FROM part WHERE p_partkey % 10 <> 9
    )
    SELECT DISTINCT o_orderkey, p_partkey FROM s JOIN w ON contains(lower(stack), lower(word))
    """
)
def forced_of_many_tools(spark, folder):
    key = F.col("p_partkey")
    brand = F.when(key % 5 == 0, F.concat(F.upper("p_brand"), F.lit(" 1"))).otherwise("nowhere")
    words = F.array((key + 1000).cast("string"), brand, F.when(key == 7, "").otherwise(F.concat(F.lit("?"), "p_name")))
    many = table(spark, folder, "part").select("p_partkey", F.when(key % 10 != 9, words).alias("force_if_keywords"))
    text = F.concat(F.lit("Node "), "o_orderkey", F.lit(" on "), "o_orderpriority", F.lit(" Brand#"), F.col("o_custkey") % 30, F.lit(" 1"))
    orders = table(spark, folder, "orders").select("o_orderkey", text.alias("stack"))
    return C.forced_by_index(orders, many).select("o_orderkey", "p_partkey")


@check(
    f"""
    SELECT s.project,
           coalesce(string_agg('- [x] ' || name || ' (http://' || CASE name WHEN 'browser-notes' THEN 'notes' ELSE name END || ') <!-- type:skill -->', chr(10) ORDER BY position)
                    FILTER (type <> 'mcp'), '- [ ] No skills recommended') AS skills_md,
           coalesce(string_agg('- [x] ' || name || ' (npx ' || name || ')', chr(10) ORDER BY position) FILTER (type = 'mcp'), '- [ ] No MCPs recommended') AS mcps_md
    FROM ({STACK_SQL}) s LEFT JOIN ({FORCED_SQL}) f ON s.project = f.project GROUP BY s.project
    """
)
def forced_checklists(spark, folder):
    return C.forced_checklists(stacks(spark, folder), tools()).drop("stack")


def _holds(*words):
    return " OR ".join(f"contains(lower(s.stack), '{w}')" for w in words)


@check(
    f"""
    SELECT project, 'Stack: ' || stack || chr(10) || 'Area ' || project || ' by owner-' || project || chr(10) || '1. rule ' || project || chr(10)
           || coalesce(nullif(concat_ws(chr(10), CASE WHEN notes THEN '- [x] browser-notes (http://notes) <!-- type:skill -->' END,
                CASE WHEN types THEN '- [x] types (http://types) <!-- type:skill -->' END, CASE WHEN beans THEN '- [x] beans (http://beans) <!-- type:skill -->' END,
                CASE WHEN project % 2 = 0 AND NOT types THEN '- [x] types (http://other) <!-- type:skill -->' END,
                CASE WHEN project % 2 = 0 THEN '- [x] extra (http://extra) <!-- type:extension -->' END), ''), '- [ ] No skills recommended') || chr(10)
           || coalesce(nullif(concat_ws(chr(10), CASE WHEN browser THEN '- [x] browser (npx browser)' END, CASE WHEN crates THEN '- [x] crates (npx crates)' END,
                CASE WHEN project % 3 = 0 AND NOT crates THEN '- [x] crates (npx mine)' END), ''), '- [ ] No MCPs recommended') AS document
    FROM (SELECT *, {_holds('frontend')} AS browser, {_holds('frontend', 'php')} AS notes, {_holds('python', 'typescript')} AS types,
                 {_holds('rust')} AS crates, {_holds('(java/')} AS beans FROM ({STACK_SQL}) s)
    """
)
def project_documents(spark, folder):
    project = F.col("project")
    suggestion = lambda name, **given: F.struct(F.lit(name).alias("name"), *[F.lit(v).alias(k) for k, v in given.items()])
    reply = F.to_json(
        F.struct(
            F.concat(F.lit("Owner-"), project).alias("sme_name"),
            F.array(F.concat(F.lit("rule "), project)).alias("invariants"),
            F.when(
                project % 2 == 0,
                F.array(suggestion("types", url="http://other", type="skill"), *[suggestion("extra", url="http://extra", type="extension")] * 2),
            ).alias("skills"),
            F.when(project % 3 == 0, F.array(suggestion("crates", command="npx mine"))).alias("mcps"),
        )
    )
    template = F.lit("Stack: {{TECH_STACK}}\nArea {{DOMAIN_SUMMARY}} by {{SME_NAME}}\n{{INVARIANTS}}\n{{SKILLS_MD}}\n{{MCPS_MD}}")
    rows = stacks(spark, folder).withColumns({"reply": F.concat(F.lit("Here it is: "), reply), "summary": project.cast("string")})
    return domain_documents(rows, tools(), template).select("project", "document")


@check(
    """
    WITH f AS (SELECT o_custkey, o_orderpriority AS name, o_orderkey AS position FROM orders WHERE o_orderstatus = 'F'),
    r AS (SELECT o_custkey, o_orderpriority AS name, min(o_orderkey) AS position FROM orders WHERE o_orderstatus <> 'F' GROUP BY ALL)
    SELECT *, 0 AS origin FROM f
    UNION ALL SELECT *, 1 FROM r WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.o_custkey = r.o_custkey AND f.name = r.name)
    """
)
def merged_recommendations(spark, folder):
    rows = table(spark, folder, "orders").select(
        "o_custkey", F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("position"), "o_orderstatus"
    )
    forced, other = rows.where("o_orderstatus = 'F'"), rows.where("o_orderstatus <> 'F'")
    return C.merge_recommended(forced.drop("o_orderstatus"), other.drop("o_orderstatus"), ["o_custkey"])


PART_KIND_SQL = "CASE WHEN p_size % 3 = 0 THEN 'mcp' WHEN p_size % 3 = 1 THEN 'skill' END"


@check(f"SELECT p_partkey, CASE WHEN coalesce({PART_KIND_SQL}, 'skill') = 'mcp' THEN 'mcps' ELSE 'skills' END AS part_of FROM part")
def tools_by_type(spark, folder):
    size = F.col("p_size")
    parts = table(spark, folder, "part").select("p_partkey", F.when(size % 3 == 0, "mcp").when(size % 3 == 1, "skill").alias("type"))
    skills, mcps = C.split_by_type(parts)
    return (
        skills.select("p_partkey", F.lit("skills").alias("part_of")).unionByName(mcps.select("p_partkey", F.lit("mcps").alias("part_of")))
    )


@check(
    f"""
    SELECT p_partkey, CASE WHEN {PART_KIND_SQL} = 'mcp' THEN 'mcp' ELSE 'skill' END AS kind,
           CASE WHEN {PART_KIND_SQL} = 'mcp' THEN '- [x] ' || p_name || ' (' || p_brand || ')'
                ELSE '- [x] ' || p_name || ' (http://' || p_brand || ') <!-- type:skill -->' END AS line
    FROM part
    """
)
def part_checklist_lines(spark, folder):
    size = F.col("p_size")
    parts = table(spark, folder, "part").select(
        "p_partkey",
        F.when(size % 3 == 0, "mcp").when(size % 3 == 1, "skill").alias("type"),
        F.col("p_name").alias("name"),
        F.concat(F.lit("http://"), F.col("p_brand")).alias("url"),
        F.col("p_brand").alias("command"),
        F.lit(0).alias("origin"),
        F.col("p_partkey").alias("position"),
    )
    return C.checklist_lines(parts, ["p_partkey"]).select("p_partkey", "kind", "line")


# Four documents make one workspace; what they are and say depends on doc_id and on their label.
ARTIFACT_SQL = """
    SELECT d.doc_id // 4 AS workspace,
           CASE d.doc_id % 4 WHEN 0 THEN CASE WHEN d.doc_id % 3 = 0 THEN 'artifacts/implementation_plan.md' ELSE 'artifacts/plan.md' END
                             WHEN 1 THEN 'artifacts/tdd_failing_test.log'
                             WHEN 2 THEN CASE WHEN d.doc_id % 5 = 0 THEN 'artifacts/code_review_report.md' ELSE 'artifacts/diagnosis_report.md' END
                             ELSE CASE WHEN d.doc_id % 3 = 0 THEN 'artifacts/qa_report.md' ELSE 'artifacts/plan.md' END END AS path,
           text || CASE WHEN coalesce(l.quality, 0) = 1 THEN chr(10) || '## Verification Criteria FAILED' || chr(10) || 'root Reproducible' ELSE '' END AS content
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""
GATE_SQL = f"""
    WITH a AS ({ARTIFACT_SQL}), w AS (
      SELECT workspace,
             bool_or(path = 'artifacts/implementation_plan.md') AS plan1, bool_or(path = 'artifacts/plan.md') AS plan2,
             bool_or(path = 'artifacts/tdd_failing_test.log') AS log, bool_or(path = 'artifacts/diagnosis_report.md') AS diag,
             bool_or(path = 'artifacts/code_review_report.md') AS review, bool_or(path = 'artifacts/qa_report.md') AS qa,
             bool_or(path = 'artifacts/implementation_plan.md' AND contains(content, '## Verification Criteria')) AS plan1_ok,
             bool_or(path = 'artifacts/plan.md' AND contains(content, '## Verification Criteria')) AS plan2_ok,
             bool_or(path = 'artifacts/tdd_failing_test.log' AND regexp_matches(content, '(?i)AssertionError|FAILED|E       |Traceback|Exception:|Error:')) AS log_ok,
             bool_or(path = 'artifacts/diagnosis_report.md' AND (contains(content, 'Root Cause') OR contains(lower(content), 'reproducible'))) AS diag_ok
      FROM a GROUP BY workspace
    ), v AS (
      SELECT workspace, 1 AS phase, [CASE WHEN NOT diag THEN 'artifacts/diagnosis_report.md is missing. You MUST perform a diagnosis before discovery.' END,
                                     CASE WHEN diag AND NOT diag_ok THEN 'artifacts/diagnosis_report.md lacks a clear Root Cause or reproduction steps.' END] AS found FROM w
      UNION ALL SELECT workspace, 3, [CASE WHEN NOT plan1 AND NOT plan2 THEN 'No implementation plan found in artifacts/.' END,
                                      CASE WHEN plan1 AND NOT plan1_ok THEN 'Plan in artifacts/implementation_plan.md is missing strict Verification Criteria (Sphinch Marks).'
                                           WHEN NOT plan1 AND plan2 AND NOT plan2_ok THEN 'Plan in artifacts/plan.md is missing strict Verification Criteria (Sphinch Marks).' END] FROM w
      UNION ALL SELECT workspace, 4, [CASE WHEN NOT plan1 AND NOT plan2 THEN 'MISSING ARTIFACT: artifacts/plan.md (Required for Phase 4)' END,
                                      CASE WHEN NOT log THEN 'MISSING ARTIFACT: artifacts/tdd_failing_test.log (Required to prove TDD Hard Gate)' END,
                                      CASE WHEN log AND NOT log_ok THEN 'INVALID ARTIFACT: artifacts/tdd_failing_test.log does not contain a verifiable failure trace. You must run the tests and capture the failure before implementation.' END] FROM w
      UNION ALL SELECT workspace, 5, [CASE WHEN NOT review THEN 'MISSING ARTIFACT: artifacts/code_review_report.md' END,
                                      CASE WHEN NOT qa THEN 'MISSING ARTIFACT: artifacts/qa_report.md' END] FROM w
    )
    SELECT workspace, phase, CAST(coalesce(len(list_filter(found, lambda x: x IS NOT NULL)), 0) = 0 AS INTEGER) AS passed,
           array_to_string(list_filter(found, lambda x: x IS NOT NULL), '; ') AS violations
    FROM v
"""


def artifacts(spark, folder):
    doc = F.col("doc_id")
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    path = (
        F.when(doc % 4 == 0, F.when(doc % 3 == 0, V.PLAN_CANDIDATES[0]).otherwise(V.PLAN_CANDIDATES[1]))
        .when(doc % 4 == 1, V.FAILING_TEST_LOG)
        .when(doc % 4 == 2, F.when(doc % 5 == 0, V.REVIEW_REPORT).otherwise(V.DIAGNOSIS_REPORT))
        .otherwise(F.when(doc % 3 == 0, V.QA_REPORT).otherwise(V.PLAN_CANDIDATES[1]))
    )
    note = F.when(F.col("quality") == 1, "\n## Verification Criteria FAILED\nroot Reproducible").otherwise("")
    joined = table(spark, folder, "documents").select("doc_id", "text").join(labels, "doc_id", "left")
    return joined.select(F.floor(doc / 4).alias("workspace"), path.alias("path"), F.concat("text", note).alias("content"))


@check(GATE_SQL)
def artifact_gates(spark, folder):
    found = G.artifact_gates(artifacts(spark, folder), G.PHASES)
    return found.select(
        "workspace", "phase", F.col("passed").cast("int").alias("passed"), F.array_join("violations", "; ").alias("violations")
    )


def skeleton(spark, folder):
    return table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "lang")


def enrichment(spark, folder):
    return table(spark, folder, "labels").select(F.col("doc_id").alias("id"), "quality")


@check("SELECT d.doc_id AS id, lang, quality, 'merged' AS source_kind FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def enriched_documents(spark, folder):
    return E.merge_enrichment(skeleton(spark, folder), enrichment(spark, folder))


@check(
    """
    SELECT d.doc_id AS id, lang, coalesce(quality, -1) AS quality, CASE WHEN l.doc_id IS NULL THEN 'ast_fallback' ELSE 'merged' END AS source_kind
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    """
)
def enriched_with_fallback(spark, folder):
    merged = E.merge_enrichment(skeleton(spark, folder), enrichment(spark, folder), on_missing="fallback")
    return merged.withColumn("quality", F.coalesce("quality", F.lit(-1)))


@check("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_enrichment(spark, folder):
    return E.missing_ids(skeleton(spark, folder), enrichment(spark, folder))


# The report of every configured customer.
REPORT_SQL = f"""
    WITH s AS ({CM.LATEST_SQL}), ai AS (
      SELECT string_agg('• *' || upper(source[1]) || substr(source, 2) || '*: model `' || model || '` | In: ' || tokens_in || ' | Out: '
                        || tokens_out || ' | Cost: $' || CAST(CAST(cost AS DECIMAL(18,4)) AS VARCHAR), chr(10)
                        ORDER BY CASE source WHEN 'openai' THEN 1 WHEN 'anthropic' THEN 2 ELSE 3 END) AS t
      FROM (SELECT s.*, u.tokens_out FROM s JOIN (SELECT provider, tokens_out FROM ({CM.USAGE_SQL}) JOIN events USING (event_id)
            QUALIFY row_number() OVER (PARTITION BY provider ORDER BY ts DESC) = 1) u ON u.provider = s.source)
    ), cloud AS (
      SELECT string_agg('• *' || upper(source) || ':* $' || CAST(CAST(cost AS DECIMAL(18,2)) AS VARCHAR), chr(10) ORDER BY source) AS t
      FROM s WHERE source IN ('aws', 'gcp')
    ), warn AS (
      SELECT string_agg(source || ': ' || error, chr(10) ORDER BY CASE source WHEN 'openai' THEN 1 WHEN 'anthropic' THEN 2 WHEN 'gemini' THEN 3 WHEN 'aws' THEN 4 ELSE 5 END) AS t
      FROM s WHERE error <> ''
    ), p AS (
      SELECT project, slack_channel_id, teams_url, c.repo IS NOT NULL AS has_activity, r.*,
             concat_ws(chr(10), CASE WHEN r.error IS NOT NULL THEN 'github: ' || r.error END, warn.t) AS warnings
      FROM ({CM.CONFIG_SQL}) c LEFT JOIN ({CM.REPO_SQL}) r ON r.repo = c.repo, warn
    )
    SELECT project, coalesce(slack_channel_id, '') AS slack_channel_id, coalesce(teams_url, '') AS teams_url,
           coalesce(CASE WHEN prs_submitted IS NOT NULL THEN '🛠️ *Engineering Metrics (GitHub)*' || chr(10) || '• *PRs Submitted:* ' || prs_submitted || chr(10)
             || '• *Lines Added:* ' || lines_added || chr(10) || '• *Lines Deleted:* ' || lines_deleted || chr(10) || '• *Bugs Closed:* ' || bugs_closed
             || chr(10) || '• *Releases:* ' || releases_done END, '') AS activity,
           '🤖 *AI Usage Metrics*' || chr(10) || ai.t AS usage, '☁️ *Infrastructure Costs*' || chr(10) || cloud.t AS costs, warnings
    FROM p, ai, cloud
"""


def weekly(spark, folder):
    projects = L.projects(CM.landed_configs(spark, folder))
    one_row = R.source_structs(CM.newest_sources(spark, folder))
    return R.reports(projects, repo_metrics(CM.landed_activity(spark, folder), CM.ORDERS_AS_OF), one_row)


@check(REPORT_SQL)
def weekly_report(spark, folder):
    empty = F.lit("")
    text = lambda c, n: F.coalesce(c, empty).alias(n)
    stats = F.col("stats")
    return weekly(spark, folder).select(
        "project",
        text(F.col("slack_channel_id"), "slack_channel_id"),
        text(F.col("teams_url"), "teams_url"),
        text(R.activity_text(stats), "activity"),
        text(R.usage_text(stats), "usage"),
        text(R.cost_text(stats), "costs"),
        text(R.warning_lines(F.col("warnings")), "warnings"),
    )


SECTION_SQL = "'{{\"type\":\"section\",\"text\":{{\"type\":\"mrkdwn\",\"text\":' || CAST(to_json({0}) AS VARCHAR) || '}}}}'"


@check(
    f"""
    SELECT project, slack_channel_id AS destination,
           '{{"channel":"' || slack_channel_id || '","text":"Report for ' || project || '","blocks":['
           || concat_ws(',', '{{"type":"header","text":{{"type":"plain_text","text":"Project Report: ' || project || '","emoji":true}}}}',
                        CASE WHEN activity <> '' THEN {SECTION_SQL.format('activity')} END, {SECTION_SQL.format('usage')}, {SECTION_SQL.format('costs')},
                        CASE WHEN warnings <> '' THEN '{{"type":"context","elements":[{{"type":"mrkdwn","text":' || CAST(to_json(':warning: _' || warnings || '_') AS VARCHAR) || '}}]}}' END)
           || ']}}' AS payload
    FROM ({REPORT_SQL}) WHERE slack_channel_id <> ''
    """
)
def report_messages(spark, folder):
    return R.routed(weekly(spark, folder)).where("sink = 'slack'").drop("sink")


@check(
    f"""
    SELECT project, 'slack' AS sink, slack_channel_id AS destination FROM ({CM.CONFIG_SQL}) WHERE slack_channel_id IS NOT NULL
    UNION ALL SELECT project, 'teams', teams_url FROM ({CM.CONFIG_SQL}) WHERE teams_url IS NOT NULL
    """
)
def report_routes(spark, folder):
    return R.routed(weekly(spark, folder)).drop("payload")


@check(
    f"""
    SELECT c.project, teams_url AS destination, coalesce(prs_submitted, -1) AS prs_submitted, coalesce(lines_added, -1) AS lines_added,
           (SELECT cost FROM ({CM.LATEST_SQL}) WHERE source = 'aws') AS aws_cost,
           (SELECT model FROM ({CM.LATEST_SQL}) WHERE source = 'openai') AS openai_model,
           coalesce(r.error, '') AS github_warning, coalesce(lines_deleted, -1) AS lines_deleted, coalesce(bugs_closed, -1) AS bugs_closed,
           coalesce(releases_done, -1) AS releases_done,
           (SELECT tokens_in FROM ({CM.LATEST_SQL}) WHERE source = 'gemini') AS gemini_tokens_in,
           (SELECT status FROM ({CM.LATEST_SQL}) WHERE source = 'gcp') AS gcp_status
    FROM ({CM.CONFIG_SQL}) c LEFT JOIN ({CM.REPO_SQL}) r ON r.repo = c.repo WHERE teams_url IS NOT NULL
    """
)
def report_records(spark, folder):
    raw = R.routed(weekly(spark, folder)).where("sink = 'teams'")
    field = lambda p: F.get_json_object("payload", "$." + p)
    return raw.select(
        "project",
        "destination",
        F.coalesce(field("stats.github.prs_submitted").cast("bigint"), F.lit(-1)).alias("prs_submitted"),
        F.coalesce(field("stats.github.lines_added").cast("bigint"), F.lit(-1)).alias("lines_added"),
        field("stats.aws.cost").cast("double").alias("aws_cost"),
        field("stats.openai.model").alias("openai_model"),
        F.coalesce(field("warnings.github"), F.lit("")).alias("github_warning"),
        *[F.coalesce(field(f"stats.github.{n}").cast("bigint"), F.lit(-1)).alias(n) for n in ("lines_deleted", "bugs_closed", "releases_done")],
        field("stats.gemini.tokens_in").cast("bigint").alias("gemini_tokens_in"),
        field("stats.gcp.status").alias("gcp_status"),
    )
