"""Corpus, Markdown, template and include jobs (rows SC6-SC8, SC10, PF10-PF17, J6-J8, A9-A11, A17, T4, F6-F16, F19, F21, U5)."""

from pyspark.sql import functions as F

from checks.logs import LINES
from checks.registry import check, table
from opslens.functions import jsontext, paths
from opslens.functions import text as T
from opslens.operators import closure as C
from opslens.operators import corpus as P
from opslens.operators.gates import has_diagnosis, preferred_artifact
from opslens.operators.ordered import position_chunk
from opslens.plans import documents as D
from opslens.sources import corpus as SC

LONG_LINES = f"SELECT doc_id, trim(line, ' ' || chr(9) || chr(160)) AS line FROM ({LINES.format(text='text')})"
LONG_LINES = f"SELECT * FROM ({LONG_LINES}) WHERE length(line) > 20"


def texts(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "text").toDF("path", "content")


@check(
    f"""
    SELECT line, count(*) AS occurrences, count(DISTINCT doc_id) AS documents FROM ({LONG_LINES})
    GROUP BY line HAVING count(*) > 1
    """
)
def shared_lines(spark, folder):
    return P.line_redundancy(texts(spark, folder))


@check(
    f"""
    SELECT line, doc_id, count(*) AS occurrences FROM ({LONG_LINES})
    WHERE line IN (SELECT line FROM ({LONG_LINES}) GROUP BY line HAVING count(*) > 1) GROUP BY line, doc_id
    """
)
def shared_line_postings(spark, folder):
    return P.line_postings(texts(spark, folder)).withColumnRenamed("path", "doc_id")


@check(
    f"""
    SELECT (SELECT count(*) FROM (SELECT line FROM ({LONG_LINES}) GROUP BY line HAVING count(*) > 1)) AS redundant_lines,
           (SELECT count(*) FROM documents) AS files
    """
)
def redundancy_summary(spark, folder):
    return P.redundancy_summary(texts(spark, folder))


@check(
    """
    SELECT doc_id,
           CAST(regexp_matches(t, '(?i)AssertionError|FAILED|E       |Traceback|Exception:|Error:') AS INTEGER) AS failure,
           CAST(contains(t, 'Root Cause') OR contains(lower(t), 'reproducible') AS INTEGER) AS diagnosis,
           CAST(contains(t, '[USER INPUT REQUIRED]') AS INTEGER) AS incomplete,
           CAST(length(t) > 2000 OR contains(t, 'Traceback') OR contains(t, 'at ') OR contains(t, 'Exception') AS INTEGER) AS intake
    FROM (SELECT doc_id, replace(replace(replace(text, 'License', 'failed'), ' of the ', ' REPRODUCIBLE '), 'token', '[USER INPUT REQUIRED]') AS t
          FROM documents)
    """
)
def document_predicates(spark, folder):
    rules = [("License", "failed"), (" of the ", " REPRODUCIBLE "), ("token", "[USER INPUT REQUIRED]")]
    text = T.replace_in_order(F.col("text"), rules)
    docs = table(spark, folder, "documents").select("doc_id", "text").select("doc_id", text.alias("t"))
    flag = lambda c, n: c.cast("int").alias(n)
    return docs.select(
        "doc_id",
        flag(T.matches_failure(F.col("t")), "failure"),
        flag(has_diagnosis(F.col("t")), "diagnosis"),
        flag(T.has_placeholder(F.col("t")), "incomplete"),
        flag(T.needs_intake(F.col("t")), "intake"),
    )


@check(
    """
    SELECT doc_id // 4 AS project,
           string_agg('=== ' || CASE doc_id % 4 WHEN 0 THEN 'INDEX.MD' ELSE 'ARCHITECTURE.MD' END || ' ===' || chr(10) || text,
                      chr(10) || chr(10) ORDER BY doc_id % 4) AS context
    FROM documents WHERE doc_id % 4 < 2 AND doc_id % 12 <> 8 GROUP BY 1
    """
)
def core_bundles(spark, folder):
    """Projects of four documents; of two with each name, one lies deeper, and some locations hold no index at all."""
    doc = F.col("doc_id")
    name = F.when(doc % 12 == 8, "w/other/index.md").when(doc % 4 == 0, "w/index.md").when(doc % 4 == 1, "w/architecture.md")
    name = name.when(doc % 4 == 2, "w/a/index.md").otherwise("architecture.md")
    files = table(spark, folder, "documents").select(F.floor(doc / 4).alias("project"), name.alias("path"), F.col("text").alias("content"))
    return P.core_bundle(files, ["project"], "w")


@check(
    """
    WITH f AS (
      SELECT doc_id // 4 AS project, doc_id, CASE source WHEN 'src1' THEN 'bundle/wiki' WHEN 'src2' THEN 'elsewhere' ELSE '.local/wiki' END AS folder FROM documents
    )
    SELECT f.project, folder || '/' || lpad(CAST(doc_id AS VARCHAR), 12, '0') || '.md' AS path FROM f
    JOIN (SELECT project, bool_or(folder = 'bundle/wiki') AS first FROM f GROUP BY project) b ON b.project = f.project
    WHERE folder = CASE WHEN b.first THEN 'bundle/wiki' ELSE '.local/wiki' END
    """
)
def located_documents(spark, folder):
    doc, source = F.col("doc_id"), F.col("source")
    where = F.when(source == "src1", "bundle/wiki").when(source == "src2", "elsewhere").otherwise(".local/wiki")
    files = table(spark, folder, "documents").select(
        F.floor(doc / 4).alias("project"), F.concat(where, F.lit("/"), F.lpad(doc.cast("string"), 12, "0"), F.lit(".md")).alias("path")
    )
    return P.in_first_location(files, ["project"], ["bundle/wiki", "bundle/.local/wiki", ".local/wiki"])


@check(
    """
    SELECT source AS project, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS part_no,
           '=== ' || lpad(CAST(doc_id AS VARCHAR), 12, '0') || '.MD ===' || chr(10) || text AS part
    FROM documents
    """
)
def full_bundles(spark, folder):
    doc = F.col("doc_id")
    name = F.concat(F.lit("w/"), F.lpad(doc.cast("string"), 12, "0"), F.lit(".md"))
    files = table(spark, folder, "documents").select(F.col("source").alias("project"), name.alias("path"), F.col("text").alias("content"))
    step = position_chunk(F.regexp_extract("path", r"(\d+)", 1).cast("bigint"))
    return P.full_bundle(files, ["project"], step)


@check(
    """
    SELECT o_custkey, coalesce(CASE WHEN bool_or(o_orderpriority = '2-HIGH') THEN 'wiki/2-HIGH' WHEN bool_or(o_orderpriority = '1-URGENT') THEN 'wiki/1-URGENT' END, '') AS location
    FROM orders GROUP BY o_custkey
    """
)
def first_locations(spark, folder):
    manifest = table(spark, folder, "orders").select("o_custkey", F.concat(F.lit("wiki/"), F.col("o_orderpriority")).alias("path"))
    found = SC.first_existing(manifest, ["wiki/2-HIGH", "wiki/1-URGENT"], ["o_custkey"])
    return found.withColumn("location", F.coalesce("location", F.lit("")))


@check(
    """
    SELECT workspace, arg_min(path, rank) AS path, arg_min(content, rank) AS content FROM (
      SELECT doc_id // 4 AS workspace, CASE WHEN doc_id % 7 = 0 THEN 'd.md' WHEN doc_id % 4 = 0 THEN 'b.md' WHEN doc_id % 4 = 1 THEN 'a.md' ELSE 'c.md' END AS path,
             text AS content, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 4 = 0 THEN 2 WHEN doc_id % 4 = 1 THEN 1 END AS rank
      FROM documents
    ) WHERE rank IS NOT NULL GROUP BY workspace
    """
)
def preferred_documents(spark, folder):
    doc = F.col("doc_id")
    name = F.when(doc % 7 == 0, "d.md").when(doc % 4 == 0, "b.md").when(doc % 4 == 1, "a.md").otherwise("c.md")
    files = table(spark, folder, "documents").select(
        F.floor(doc / 4).alias("workspace"), name.alias("path"), F.col("text").alias("content")
    )
    return preferred_artifact(files, ["a.md", "b.md"])


@check(
    """
    WITH sizes AS (
      SELECT 'o' || o_orderkey AS doc, greatest(1, length(o_orderpriority) // 4) AS tokens FROM orders
      UNION ALL SELECT 'p' || p_partkey, greatest(1, length(p_name) // 4) FROM part
    ), found AS (
      SELECT 'o' || l_orderkey AS doc, count(*) AS links, CAST(sum(s.tokens) AS BIGINT) AS linked
      FROM lineitem JOIN sizes s ON s.doc = 'p' || (l_partkey * 2) GROUP BY l_orderkey
    )
    SELECT s.doc, coalesce(f.links, 0) AS links, CAST(s.tokens + coalesce(f.linked, 0) AS BIGINT) AS payload
    FROM sizes s LEFT JOIN found f ON f.doc = s.doc
    """
)
def order_reference_payload(spark, folder):
    size = lambda prefix, key, text: F.struct(F.concat(F.lit(prefix), F.col(key)).alias("doc"), T.tokens_at_least_one(F.col(text)).alias("tokens"))
    orders = table(spark, folder, "orders").select(size("o", "o_orderkey", "o_orderpriority").alias("s")).select("s.*")
    parts = table(spark, folder, "part").select(size("p", "p_partkey", "p_name").alias("s")).select("s.*")
    links = table(spark, folder, "lineitem").select(
        F.concat(F.lit("o"), F.col("l_orderkey")).alias("doc"), F.concat(F.lit("p"), F.col("l_partkey") * 2).alias("target")
    )
    return P.reference_payload(orders.unionByName(parts), links)


LINKED_SQL = """
    SELECT 'w/d' || doc_id || '.md' AS doc,
           text || chr(10) || 'See [a](d' || (doc_id + 1) || '.md), [b](../w/./d' || (doc_id // 2) || '.md) and [c](gone.md)' AS content
    FROM documents
"""


def linked_documents(spark, folder):
    doc = F.col("doc_id")
    note = F.concat(
        F.col("text"), F.lit("\nSee [a](d"), doc + 1, F.lit(".md), [b](../w/./d"), F.floor(doc / 2), F.lit(".md) and [c](gone.md)")
    )
    return table(spark, folder, "documents").select("doc_id", "text").select(
        F.concat(F.lit("w/d"), doc, F.lit(".md")).alias("path"), note.alias("content")
    )


@check(
    f"""
    WITH docs AS ({LINKED_SQL}), sizes AS (SELECT doc, greatest(1, length(content) // 4) AS tokens FROM docs),
    links AS (SELECT doc, unnest(regexp_extract_all(content, '\\[.*?\\]\\((.*?\\.md)\\)', 1)) AS link FROM docs),
    found AS (
      SELECT l.doc, count(*) AS links, CAST(sum(s.tokens) AS BIGINT) AS linked
      FROM links l JOIN sizes s ON s.doc = 'w/' || replace(l.link, '../w/./', '') GROUP BY l.doc
    )
    SELECT s.doc, coalesce(f.links, 0) AS links, CAST(s.tokens + coalesce(f.linked, 0) AS BIGINT) AS payload
    FROM sizes s LEFT JOIN found f ON f.doc = s.doc
    """
)
def document_reference_payload(spark, folder):
    docs = linked_documents(spark, folder)
    sizes = P.token_counts(docs).withColumnRenamed("path", "doc")
    return P.reference_payload(sizes, P.markdown_reference_links(docs))


@check(
    """
    SELECT page_id, p AS path, regexp_extract(p, '([^/]*)$', 1) AS name,
           CASE WHEN regexp_extract(p, '^(.*)/[^/]*$', 1) = '' AND starts_with(p, '/') THEN '/' ELSE regexp_extract(p, '^(.*)/[^/]*$', 1) END AS folder,
           regexp_extract(regexp_extract(p, '([^/]*)$', 1), '^\\.*[^.].*?(\\.[^.]*)$', 1) AS suffix,
           length(p) - length(replace(p, '/', '')) AS depth,
           CAST(regexp_matches(p, '\\.(md|json|ya?ml)$') AS INTEGER) AS is_template,
           len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS links
    FROM (SELECT page_id, html, regexp_extract(url, '^https?://[^/?#]*(/[^?#]*)?', 1) AS p FROM pages)
    """
)
def page_paths(spark, folder):
    p = F.col("path")
    pages = table(spark, folder, "pages").select("page_id", "url", "html").select(
        "page_id", "html", F.regexp_extract("url", r"^https?://[^/?#]*(/[^?#]*)?", 1).alias("path")
    )
    return pages.select(
        "page_id",
        "path",
        paths.basename(p).alias("name"),
        paths.dirname(p).alias("folder"),
        paths.extension(p).alias("suffix"),
        paths.depth(p).cast("bigint").alias("depth"),
        paths.has_suffix(p).cast("int").alias("is_template"),
        F.size(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).cast("bigint").alias("links"),
    )


@check("SELECT page_id FROM (SELECT page_id, regexp_extract(url, '^https?://[^/?#]*/?([^?#]*)?', 1) AS p FROM pages) WHERE length(p) - length(replace(p, '/', '')) < 2")
def shallow_pages(spark, folder):
    path = F.regexp_extract("url", r"^https?://[^/?#]*/?([^?#]*)?", 1)
    return SC.within_depth(table(spark, folder, "pages").select("page_id", path.alias("path"))).select("page_id")


CLAUDE_SQL = "t"
for _old, _new in [("{{HARNESS_DIR}}", ".x"), ("@boilerplate-agent", ".x"), *T.V.PLATFORM_RULES["claude"]]:
    CLAUDE_SQL = f"replace({CLAUDE_SQL}, '{_old}', '{_new}')"


@check(
    f"""
    SELECT doc_id, CASE WHEN doc_id % 4 IN (1, 3) THEN t ELSE {CLAUDE_SQL} END AS content
    FROM (SELECT doc_id, replace(text, ' the ', ' replace ') || chr(10) || '- read_file glob {{{{HARNESS_DIR}}}} {{{{SUBAGENT_SYNTAX}}}}@boilerplate-agent' AS t
          FROM documents WHERE doc_id % 11 NOT IN (3, 7))
    """
)
def rendered_documents(spark, folder):
    doc = F.col("doc_id")
    name = F.when(doc % 4 == 0, "a.md").when(doc % 4 == 1, "b.py").when(doc % 4 == 2, "c.json").otherwise("x/d.txt")
    name = F.when(doc % 11 == 3, F.concat(F.lit(".git/"), name)).when(doc % 11 == 7, "x/run.log").otherwise(name)
    noted = F.concat(
        F.replace(F.col("text"), F.lit(" the "), F.lit(" replace ")),
        F.lit("\n- read_file glob {{HARNESS_DIR}} {{SUBAGENT_SYNTAX}}@boilerplate-agent"),
    )
    files = table(spark, folder, "documents").select("doc_id", "text").select("doc_id", name.alias("path"), noted.alias("content"))
    return D.render_templates(files, "claude", ".x").select("doc_id", "content")


@check(
    """
    SELECT event_id, CASE WHEN event_type IN ('error', 'click') THEN -1 ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k
    FROM events
    """
)
def recovered_json(spark, folder):
    props, kind = F.col("props"), F.col("event_type")
    reply = (
        F.when(kind == "error", F.concat(F.lit("{broken "), props))
        .when(kind == "click", F.concat(props, F.lit(" and "), props))
        .otherwise(F.concat(F.lit("Sure:\n```json\n"), props, F.lit("\n``` done")))
    )
    found = jsontext.recover_json(reply, "struct<k: bigint>", F.named_struct(F.lit("k"), F.lit(-1).cast("bigint")))
    return table(spark, folder, "events").select("event_id", "event_type", "props").select("event_id", found["k"].alias("k"))


@check(
    """
    SELECT event_id, 'k' AS field, json_extract_string(props, '$.k') AS value FROM events WHERE event_type NOT IN ('error', 'click')
    UNION ALL
    SELECT event_id, event_type || '_' || user_id, '{"ids":[' || event_id || ',null],"who":"u' || user_id || '"}' FROM events WHERE event_type NOT IN ('error', 'click')
    """
)
def recovered_fields(spark, folder):
    """Fields whose names are data: all that a recovered object holds, nested values as JSON text."""
    kind, event = F.col("event_type"), F.col("event_id")
    inner = F.to_json(F.struct(F.array(event, F.lit(None).cast("bigint")).alias("ids"), F.concat(F.lit("u"), "user_id").alias("who")))
    object_ = F.format_string('{"k": %s, "%s_%s": %s}', F.get_json_object("props", "$.k"), kind, F.col("user_id"), inner)
    reply = (
        F.when(kind == "error", F.concat(F.lit("{broken "), object_))
        .when(kind == "click", F.concat(object_, F.lit(" and "), object_))
        .otherwise(F.concat(F.lit("Sure:\n```json\n"), object_, F.lit("\n``` done")))
    )
    found = table(spark, folder, "events").select("event_id", jsontext.recover_variant(reply).alias("found"))
    fields = found.lateralJoin(spark.tvf.variant_explode(F.col("found").outer()))
    return fields.select("event_id", F.col("key").alias("field"), F.to_json("value").alias("value"))


@check(
    """
    SELECT p_partkey, lower(p_brand) || ' guards ' || p_name || chr(10) || '1. ' || p_type || chr(10) || '2. size ' || p_size || chr(10)
           || '*   **' || p_brand || '**: ' || p_type || chr(10)
           || CASE WHEN p_size % 2 = 0 THEN '*   **' || p_type || '**' ELSE '*   **[USER INPUT REQUIRED]**' END AS document
    FROM part
    """
)
def filled_templates(spark, folder):
    template = F.lit("{{SME_NAME}} guards {{CORE_DOMAIN_VALUE}}\n{{INVARIANTS}}\n{{GLOSSARY}}\n{{DOMAIN_EVENTS}}")
    profile = F.to_json(
        F.struct(
            F.col("p_brand").alias("sme_name"),
            F.col("p_name").alias("core_domain_value"),
            F.array(F.col("p_type"), F.concat(F.lit("size "), F.col("p_size"))).alias("invariants"),
            F.create_map("p_brand", "p_type").alias("glossary"),
            F.when(F.col("p_size") % 2 == 0, F.array("p_type")).alias("domain_events"),
        )
    )
    rows = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size").withColumn("reply", F.concat(F.lit("Reply: "), profile))
    return D.fill_documents(D.with_profile(rows), template, D.profile_slots(F.col("profile"))).select("p_partkey", "document")


CHECKLIST_SQL = """
    SELECT p_partkey, chr(10) || '## Proposed Skills' || chr(10) || '- [x] ' || p_name || ' (http://' || p_size || ') <!-- type: ' || lower(p_type) || ' -->' || chr(10)
           || '  - [' || CASE WHEN p_size % 2 = 0 THEN 'X' ELSE ' ' END || ']   ' || p_brand || '  (u)x)' || chr(10) || '- [x] bare' || chr(10)
           || CASE WHEN p_size % 3 = 0 THEN '' ELSE '## Proposed MCP Tools' || chr(10) END || '- [x] srv (npx ' || p_type || ')' || chr(10) AS content
    FROM part
"""


def checklist_documents(spark, folder):
    content = F.concat(
        F.lit("\n## Proposed Skills\n- [x] "), "p_name", F.lit(" (http://"), "p_size", F.lit(") <!-- type: "), F.lower("p_type"), F.lit(" -->\n  - ["),
        F.when(F.col("p_size") % 2 == 0, "X").otherwise(" "), F.lit("]   "), "p_brand", F.lit("  (u)x)\n- [x] bare\n"),
        F.when(F.col("p_size") % 3 == 0, "").otherwise("## Proposed MCP Tools\n"), F.lit("- [x] srv (npx "), "p_type", F.lit(")\n"),
    )
    return table(spark, folder, "part").select("p_partkey", content.alias("content"))


@check(
    f"""
    WITH s AS (
      SELECT p_partkey, 'skill' AS kind, regexp_extract(content, '(?s)## Proposed Skills\\n(.*?)(##|$)', 1) AS block FROM ({CHECKLIST_SQL})
      UNION ALL SELECT p_partkey, 'mcp', regexp_extract(content, '(?s)## Proposed MCP Tools\\n(.*?)(##|$)', 1) FROM ({CHECKLIST_SQL})
    ), l AS (
      SELECT p_partkey, kind, i, trim(string_split(block, chr(10))[i]) AS line
      FROM (SELECT *, unnest(range(1, len(string_split(block, chr(10))) + 1)) AS i FROM s)
    ), r AS (
      SELECT p_partkey, kind, i, regexp_extract(line, '^- \\[[xX]\\]\\s+([^\\(]+?)\\s*\\((.*?)\\)(?:\\s*<!--\\s*type:(.*?)\\s*-->)?', ['name', 'target', 'type']) AS m
      FROM l WHERE regexp_matches(line, '^- \\[[xX]\\]\\s+([^\\(]+?)\\s*\\((.*?)\\)')
    )
    SELECT p_partkey, kind, row_number() OVER (PARTITION BY p_partkey, kind ORDER BY i) AS pos, trim(m['name']) AS name, trim(m['target']) AS target,
           CASE WHEN kind = 'mcp' THEN 'mcp' WHEN m['type'] = '' THEN 'skill' ELSE trim(m['type']) END AS type
    FROM r
    """
)
def parsed_checklists(spark, folder):
    rows = D.parse_checklists(checklist_documents(spark, folder), "p_partkey")
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


@check(
    """
    SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'domain-sme' ELSE lower(replace(p_brand, '#', '_')) END AS owner,
           CASE WHEN p_size % 3 = 0 THEN 'None provided.' ELSE p_name || ' rules ' || chr(10) || chr(10) || '**' END AS invariants,
           'size ' || p_size AS glossary, CAST(p_size % 5 = 0 AS INTEGER) AS incomplete
    FROM part
    """
)
def domain_sections(spark, folder):
    size = F.col("p_size")
    content = F.concat(
        F.when(size % 4 == 0, "").otherwise(F.concat(F.lit("**Proposed Agent Name:** `@"), F.replace(F.col("p_brand"), F.lit("#"), F.lit("_")), F.lit("`\n"))),
        F.when(size % 3 == 0, "").when(size % 3 == 1, "### Domain Invariants (rules)\n").otherwise("### Aggregates & Invariants:\n"),
        F.when(size % 3 == 0, "").otherwise(F.concat(F.col("p_name"), F.lit(": rules (really)\n\n"))),
        F.lit("**Ubiquitous Language (terms):**\nsize: "), size, F.lit("\n\n## Proposed Skills\n"),
        F.when(size % 5 == 0, "[USER INPUT REQUIRED]").otherwise(""),
    )
    docs = table(spark, folder, "part").select("p_partkey", content.alias("content"))
    found = D.extract_domain_sections(docs, "p_partkey")
    return found.withColumn("incomplete", F.col("incomplete").cast("int"))


@check(
    """
    SELECT p_partkey, trim(regexp_replace(lower(regexp_replace(regexp_replace(n, '(.)([A-Z][a-z]+)', '\\1-\\2', 'g'), '([a-z0-9])([A-Z])', '\\1-\\2', 'g')), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
           substr(sha256(p_name || ':' || p_type || ':' || p_size), 1, 12) AS id,
           upper(p_type[1]) || lower(substr(p_type, 2)) AS title, upper(p_name) AS upper_name
    FROM (SELECT *, upper(p_name[1]) || replace(substr(p_name, 2), ' ', 'Big') || p_brand || '!' AS n FROM part)
    """
)
def slugs_and_ids(spark, folder):
    name = F.concat(F.upper(F.substring("p_name", 1, 1)), F.replace(F.expr("substring(p_name, 2)"), F.lit(" "), F.lit("Big")), F.col("p_brand"), F.lit("!"))
    return table(spark, folder, "part").select(
        "p_partkey",
        T.slug(name).alias("slug"),
        T.stable_id(F.col("p_name"), F.col("p_type"), F.col("p_size")).alias("id"),
        F.initcap("p_type").alias("title"),
        F.upper("p_name").alias("upper_name"),
    )


@check(
    """
    SELECT p_partkey, 'brand=' || p_brand || ',size=' || p_size || ',type=' || p_name AS settings FROM part
    """
)
def merged_settings(spark, folder):
    old = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type"))
    new = F.create_map(F.lit("type"), F.col("p_name"), F.lit("size"), F.col("p_size").cast("string"))
    pairs = F.transform(F.map_entries(D.merged_maps(old, new)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return table(spark, folder, "part").select("p_partkey", F.array_join(F.array_sort(pairs), ",").alias("settings"))


INCLUDED_SQL = """
    SELECT 'd' || doc_id AS path, text || chr(10) || '@d' || (doc_id // 10) || chr(10) || ' @none' || doc_id || chr(10) || '@ d1' AS content FROM documents
"""


@check(
    f"""
    WITH RECURSIVE docs AS ({INCLUDED_SQL}), lines AS (
      SELECT path, i - 1 AS line_no, l[i] AS line, CASE WHEN starts_with(trim(l[i]), '@') AND NOT starts_with(trim(l[i]), '@ ') THEN trim(trim(l[i])[2:]) END AS target
      FROM (SELECT path, l, unnest(range(1, len(l) + 1)) AS i
            FROM (SELECT path, string_split_regex(content, '\\r\\n|[\\n\\r\\x{{0b}}\\x{{0c}}\\x{{1c}}-\\x{{1e}}\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS l FROM docs))
    ), linked AS (
      SELECT l.path, line_no, line, CASE WHEN d.path IS NOT NULL THEN target END AS target FROM lines l LEFT JOIN docs d ON d.path = l.target
    ), tree AS (
      SELECT path AS root, CAST(line_no AS VARCHAR) AS position, line, CASE WHEN target <> path THEN target END AS target, [path] AS open FROM linked
      UNION ALL
      SELECT t.root, t.position || '.' || l.line_no, l.line,
             CASE WHEN NOT list_contains(list_append(t.open, t.target), l.target) THEN l.target END, list_append(t.open, t.target)
      FROM tree t JOIN linked l ON l.path = t.target
    )
    SELECT root, position, line FROM tree WHERE target IS NULL
    """
)
def expanded_documents(spark, folder):
    doc = F.col("doc_id")
    content = F.concat(F.col("text"), F.lit("\n@d"), F.floor(doc / 10), F.lit("\n @none"), doc, F.lit("\n@ d1"))
    docs = table(spark, folder, "documents").select("doc_id", "text").select(F.concat(F.lit("d"), doc).alias("path"), content.alias("content"))
    position = F.array_join(F.transform("position", lambda p: p.cast("string")), ".")
    return C.expand_includes(docs).withColumn("position", position)


@check(
    """
    WITH RECURSIVE edges AS (
      SELECT doc_id AS src, doc_id // 10 AS dst FROM documents UNION ALL SELECT doc_id, doc_id // 7 FROM documents
    ), reach AS (
      SELECT 'd' || src AS root, dst AS node, 1 AS depth FROM edges WHERE src <> dst
      UNION
      SELECT r.root, e.dst, r.depth + 1 FROM reach r JOIN edges e ON r.node = e.src WHERE r.root <> 'd' || e.dst AND e.src <> e.dst
    )
    SELECT root, 'd' || node AS node, min(depth) AS depth FROM reach GROUP BY root, node
    """
)
def include_reachability(spark, folder):
    """What each document includes, over the include lines of the documents."""
    doc = F.col("doc_id")
    content = F.concat(F.col("text"), F.lit("\n@d"), F.floor(doc / 10), F.lit("\n@d"), F.floor(doc / 7))
    docs = table(spark, folder, "documents").select(F.concat(F.lit("d"), doc).alias("path"), content.alias("content"))
    return C.include_closure(C.edge_table(docs), docs.select(F.col("path").alias("root")))


@check(
    """
    WITH RECURSIVE reach AS (
      SELECT 0 AS node, 0 AS depth UNION ALL
      SELECT CAST(doc_id AS INTEGER), depth + 1 FROM reach JOIN documents ON doc_id = node + 1
    )
    SELECT 'd' || node AS node, depth FROM reach WHERE depth > 0
    """
)
def include_chain_depths(spark, folder):
    """Every document includes the next one: how far each is from the first."""
    edges = table(spark, folder, "documents").select(F.concat(F.lit("d"), F.col("doc_id") - 1).alias("src"), F.concat(F.lit("d"), "doc_id").alias("dst"))
    roots = edges.where("dst = 'd0'").select(F.col("dst").alias("root"))
    return C.include_closure(edges, roots).select("node", "depth")
