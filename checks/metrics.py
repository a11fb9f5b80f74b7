"""Activity, usage and cost metrics (rows SC1-SC5, PF1-PF9, J1-J2, A1-A6, A16, A18, U1, F1-F2, F4, F17-F18)."""

from pyspark.sql import functions as F

from checks.registry import check, dealt, table
from opslens import schemas as S
from opslens.functions import money, temporal
from opslens.operators import enrich as E
from opslens.operators import metrics as M
from opslens.operators import report as R
from opslens.sources import landing as L

EVENTS_AS_OF = "2024-01-30"
ORDERS_AS_OF = "2001-08-01"
K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def k():
    return F.get_json_object("props", "$.k").cast("bigint")


@check(
    f"""
    SELECT user_id,
           count(*) FILTER (event_type = 'view' AND ts >= TIMESTAMP '2024-01-23') AS prs_submitted,
           count(*) FILTER (event_type = 'error' AND {K} % 2 = 0 AND ts >= TIMESTAMP '2024-01-23') AS bugs_closed,
           count(*) FILTER (event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-23') AS releases_done
    FROM events GROUP BY user_id
    """
)
def recent_activity_by_user(spark, folder):
    kind, ts = F.col("event_type"), F.col("ts")
    state = F.when(kind == "error", "CLOSED").otherwise("OPEN")
    labels = F.array(F.when(k() % 2 == 0, "bug").otherwise("task"), kind)
    return (
        table(spark, folder, "events")
        .groupBy("user_id")
        .agg(
            M.recent_releases(F.when(kind == "view", ts), EVENTS_AS_OF).alias("prs_submitted"),
            M.closed_bugs(state, labels, ts, EVENTS_AS_OF),
            M.recent_releases(F.when(kind == "purchase", ts), EVENTS_AS_OF),
        )
    )


@check(
    """
    SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAYS AND event_type = 'error'
    """
)
def recent_error_events(spark, folder):
    recent = temporal.in_trailing_window(F.col("ts"), EVENTS_AS_OF)
    return table(spark, folder, "events").where((F.col("event_type") == "error") & recent).select("event_id", "user_id")


@check(
    """
    SELECT c_custkey, coalesce(prs_submitted, 0) AS prs_submitted, coalesce(lines_added, 0) AS lines_added,
           coalesce(lines_deleted, 0) AS lines_deleted
    FROM customer LEFT JOIN (
      SELECT o_custkey, count(*) FILTER (o_orderdate >= TIMESTAMP '2001-07-25') AS prs_submitted,
             CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) FILTER (l_shipdate >= TIMESTAMP '2001-07-25'), 0) AS BIGINT) AS lines_added,
             CAST(coalesce(sum(l_linenumber) FILTER (l_shipdate >= TIMESTAMP '2001-07-25'), 0) AS BIGINT) AS lines_deleted
      FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey
    ) ON c_custkey = o_custkey
    """
)
def change_metrics_by_customer(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_orderdate")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_quantity", "l_linenumber", "l_shipdate")
    changes = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    counted = changes.groupBy("c_custkey").agg(
        *M.change_counters(
            F.col("o_orderdate"), F.col("l_shipdate"), F.col("l_quantity").cast("bigint"), F.col("l_linenumber"), ORDERS_AS_OF
        )
    )
    customers = table(spark, folder, "customer").select("c_custkey")
    return M.zero_filled(customers, counted, ["c_custkey"], ["prs_submitted", "lines_added", "lines_deleted"])


@check(
    """
    SELECT CAST(CAST(coalesce(sum(CAST(CAST(o_totalprice AS VARCHAR) AS DECIMAL(38,9))), 0) AS DECIMAL(18,2)) AS DOUBLE) AS cost
    FROM orders WHERE o_orderdate >= DATE '2001-07-25' AND o_orderdate < DATE '2001-08-01'
    """
)
def weekly_order_cost(spark, folder):
    days, price = F.col("o_orderdate"), F.col("o_totalprice").cast("string")
    orders = table(spark, folder, "orders").where(temporal.in_date_range(days, ORDERS_AS_OF))
    return orders.agg(M.cost_total(days, price, ORDERS_AS_OF).cast("decimal(18,2)").cast("double").alias("cost"))


@check(
    """
    SELECT c_custkey, coalesce(n, 0) AS orders_in_window, coalesce(cost, 0) AS cost FROM customer LEFT JOIN (
      SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS cost
      FROM orders WHERE o_orderdate >= TIMESTAMP '2001-07-25' GROUP BY o_custkey
    ) ON c_custkey = o_custkey
    """
)
def zero_filled_order_metrics(spark, folder):
    orders = table(spark, folder, "orders").where(temporal.in_trailing_window(F.col("o_orderdate"), ORDERS_AS_OF))
    counted = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("orders_in_window"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("cost")
    )
    customers = table(spark, folder, "customer").select("c_custkey")
    return M.zero_filled(customers, counted, ["c_custkey"], ["orders_in_window", "cost"])


# Each order is landed as one activity payload of the repo "org/<customer>", as JSON text.
REPO_SQL = """
    SELECT 'org/' || o_custkey AS repo,
           CAST(count(*) FILTER (ok AND o_orderdate >= TIMESTAMP '2001-07-25') AS BIGINT) AS prs_submitted,
           CAST(coalesce(sum(o_orderkey % 1000) FILTER (ok AND o_orderstatus = 'F' AND o_orderdate + INTERVAL 3 DAY >= TIMESTAMP '2001-07-25'), 0) AS BIGINT) AS lines_added,
           CAST(coalesce(sum(o_orderkey % 50) FILTER (ok AND o_orderstatus = 'F' AND o_orderdate + INTERVAL 3 DAY >= TIMESTAMP '2001-07-25'), 0) AS BIGINT) AS lines_deleted,
           CAST(count(*) FILTER (ok AND o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '2001-07-25') AS BIGINT) AS bugs_closed,
           CAST(count(*) FILTER (ok AND o_orderstatus = 'P' AND o_orderdate >= TIMESTAMP '2001-07-25') AS BIGINT) AS releases_done,
           min(CASE WHEN NOT ok THEN 'API error: 404' END) AS error
    FROM (SELECT *, o_orderkey % 97 <> 0 AS ok FROM orders) GROUP BY o_custkey
"""


def parsed(records, schema):
    """Records with their ``body`` as it comes out of JSON text."""
    return records.withColumn("body", F.from_json(F.to_json("body"), schema))


def raw_activity(orders):
    created = temporal.iso_format(F.col("o_orderdate"))
    merged = F.when(
        F.col("o_orderstatus") == "F", temporal.iso_format(F.col("o_orderdate") + F.make_dt_interval(F.lit(3)))
    )
    nodes = lambda keep, *fields: F.struct(F.array_compact(F.array(F.when(keep, F.struct(*fields)))).alias("nodes"))
    status = F.col("o_orderstatus")
    repository = F.struct(
        nodes(
            F.lit(True),
            created.alias("createdAt"),
            merged.alias("mergedAt"),
            (F.col("o_orderkey") % 1000).alias("additions"),
            (F.col("o_orderkey") % 50).alias("deletions"),
        ).alias("pullRequests"),
        nodes(status == "O", created.alias("closedAt")).alias("issues"),
        nodes(status == "P", created.alias("createdAt")).alias("releases"),
    )
    return orders.select(
        F.concat(F.lit("org/"), F.col("o_custkey")).alias("repo"),
        F.lit(True).alias("has_token"),
        F.when(F.col("o_orderkey") % 97 == 0, 404).otherwise(200).alias("http_status"),
        F.lit(None).cast("string").alias("exception"),
        F.struct(F.struct(repository.alias("repository")).alias("data")).alias("body"),
    )


def activity_payloads(orders):
    return parsed(raw_activity(orders), S.ACTIVITY_BODY)


def activity_orders(spark, folder):
    return dealt(table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"))


def landed_activity(spark, folder):
    return activity_payloads(activity_orders(spark, folder))


@check(f"SELECT * REPLACE (coalesce(error, '') AS error) FROM ({REPO_SQL})")
def nested_activity_by_repo(spark, folder):
    return M.repo_metrics(landed_activity(spark, folder), ORDERS_AS_OF).withColumn("error", F.coalesce("error", F.lit("")))


@check(
    f"""
    SELECT event_id, CASE WHEN {K} % 11 = 0 THEN 'Missing token or repo'
                          WHEN user_id % 7 = 0 THEN 'Invalid repo format. Expected owner/repo'
                          WHEN event_type = 'error' THEN 'Connection error'
                          WHEN {K} % 5 = 0 THEN 'API error: ' || (400 + {K})
                          WHEN event_type = 'view' THEN 'GraphQL error: scope ' || {K}
                          WHEN event_type = 'signup' THEN 'Repository not found' ELSE '' END AS error
    FROM events
    """
)
def activity_errors(spark, folder):
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    body = (
        F.when(kind == "view", F.concat(F.lit('{"errors":[{"message":"scope '), k().cast("string"), F.lit('"}]}')))
        .when(kind == "signup", F.lit('{"data":{"repository":null}}'))
        .otherwise(F.lit('{"data":{"repository":{"issues":{"nodes":[]}}}}'))
    )
    records = table(spark, folder, "events").select(
        "event_id",
        F.when(F.col("user_id") % 7 == 0, F.concat_ws("/", F.lit("a"), user, F.lit("b"))).otherwise(F.concat_ws("/", F.lit("a"), user)).alias("repo"),
        (k() % 11 != 0).alias("has_token"),
        F.when(k() % 5 == 0, 400 + k()).otherwise(200).cast("int").alias("http_status"),
        F.when(kind == "error", "Connection error").alias("exception"),
        F.from_json(body, S.ACTIVITY_BODY).alias("body"),
    )
    return records.select("event_id", F.coalesce(M.activity_error(), F.lit("")).alias("error"))


# Each event is landed as one usage payload and one cost payload.
PROVIDER_SQL = "CASE user_id % 3 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' ELSE 'gemini' END"
USAGE_SQL = f"""
    SELECT event_id, provider, error,
           CASE WHEN error IS NULL THEN CASE WHEN k % 4 = 0 THEN CASE provider WHEN 'openai' THEN 'gpt-4-turbo'
                     WHEN 'anthropic' THEN 'claude-3-opus' ELSE 'gemini-1.5-pro' END ELSE 'model-' || (k % 3) END ELSE 'unknown' END AS model,
           CASE WHEN error IS NULL THEN k ELSE 0 END AS tokens_in,
           CASE WHEN error IS NULL AND k % 6 <> 0 THEN user_id ELSE 0 END AS tokens_out,
           CAST(CASE WHEN error IS NULL THEN 1 ELSE 0 END AS BIGINT) AS prompts,
           CASE WHEN error IS NULL THEN CAST(value AS DECIMAL(18,2)) ELSE 0 END AS cost
    FROM (
      SELECT *, {K} AS k, {PROVIDER_SQL} AS provider,
             CASE WHEN {K} % 13 = 0 THEN 'Missing API key' WHEN event_type = 'error' THEN 'API error: 401' END AS error
      FROM events
    )
"""


def raw_usage(spark, folder):
    provider = F.when(F.col("user_id") % 3 == 0, "openai").when(F.col("user_id") % 3 == 1, "anthropic").otherwise("gemini")
    body = F.struct(
        k().alias("tokens_in"),
        F.when(k() % 6 != 0, F.col("user_id")).alias("tokens_out"),
        F.lit(1).alias("prompts"),
        F.col("value").cast("decimal(18,2)").alias("cost"),
        F.when(k() % 4 != 0, F.concat(F.lit("model-"), (k() % 3).cast("string"))).alias("model"),
    )
    return dealt(table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")).select(
        "event_id",
        provider.alias("provider"),
        (k() % 13 != 0).alias("has_key"),
        F.when(F.col("event_type") == "error", 401).otherwise(200).alias("http_status"),
        F.lit(None).cast("string").alias("exception"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("fetched_at"),
        body.alias("body"),
    )


def landed_usage(spark, folder):
    return parsed(raw_usage(spark, folder), S.USAGE_BODY)


@check(f"SELECT * REPLACE (coalesce(error, '') AS error, CAST(cost AS DOUBLE) AS cost) FROM ({USAGE_SQL})")
def usage_with_defaults(spark, folder):
    records = M.usage_records(landed_usage(spark, folder)).drop("fetched_at")
    return records.withColumns({"error": F.coalesce("error", F.lit("")), "cost": F.col("cost").cast("double")})


COST_SQL = """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'gcp' ELSE 'aws' END AS provider,
           CASE WHEN o_orderkey % 10 = 0 THEN CASE WHEN o_orderstatus = 'P' THEN 'Missing GCP credentials' ELSE 'Missing AWS credentials' END
                WHEN o_orderkey % 17 = 0 THEN 'denied' END AS error,
           CAST(o_totalprice AS DECIMAL(18,2)) + CAST(2.5 AS DECIMAL(18,2)) AS total, o_orderdate
    FROM orders
"""


def raw_costs(spark, folder):
    day = lambda a: F.struct(F.struct(F.struct(a.alias("Amount")).alias("UnblendedCost")).alias("Total"))
    body = F.struct(F.array(day(F.col("o_totalprice").cast("decimal(18,2)").cast("string")), day(F.lit("2.50")), day(F.lit("n/a"))).alias("ResultsByTime"))
    return dealt(table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")).select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", "gcp").otherwise("aws").alias("provider"),
        (F.col("o_orderkey") % 10 != 0).alias("has_credentials"),
        F.when(F.col("o_orderkey") % 17 == 0, "denied").alias("exception"),
        temporal.iso_format(F.col("o_orderdate") + F.make_dt_interval(secs=(F.col("o_orderkey") / 1e6).cast("decimal(18,6)"))).alias("fetched_at"),
        body.alias("body"),
    )


def landed_costs(spark, folder):
    return parsed(raw_costs(spark, folder), S.COST_BODY)


COST_ROWS_SQL = f"""
    SELECT o_orderkey, provider, CASE WHEN error IS NULL AND provider = 'aws' THEN CAST(total AS DOUBLE) ELSE 0 END AS cost,
           CASE WHEN error IS NOT NULL THEN 'error' WHEN provider = 'gcp' THEN 'stubbed' ELSE 'success' END AS status, error, o_orderdate
    FROM ({COST_SQL})
"""


@check(f"SELECT o_orderkey, provider, cost, status, coalesce(error, '') AS error FROM ({COST_ROWS_SQL})")
def cost_series_totals(spark, folder):
    records = M.cost_records(landed_costs(spark, folder)).drop("fetched_at")
    return records.withColumns({"error": F.coalesce("error", F.lit("")), "cost": F.col("cost").cast("double")})


LATEST_SQL = f"""
    SELECT provider AS source, model, tokens_in, CAST(cost AS DOUBLE) AS cost, '' AS status, coalesce(error, '') AS error
    FROM ({USAGE_SQL}) JOIN events USING (event_id)
    QUALIFY row_number() OVER (PARTITION BY provider ORDER BY ts DESC) = 1
    UNION ALL
    SELECT provider, '', 0, cost, status, coalesce(error, '') FROM ({COST_ROWS_SQL})
    QUALIFY row_number() OVER (PARTITION BY provider ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
"""


def newest_sources(spark, folder):
    usage = M.usage_records(M.latest_per_source(landed_usage(spark, folder).drop("event_id")))
    costs = M.cost_records(M.latest_per_source(landed_costs(spark, folder).drop("o_orderkey")))
    return M.source_union(usage.drop("fetched_at"), costs.drop("fetched_at"))


@check(LATEST_SQL)
def newest_source_records(spark, folder):
    empty = F.lit("")
    return newest_sources(spark, folder).select(
        "source",
        F.coalesce("model", empty).alias("model"),
        F.coalesce("tokens_in", F.lit(0)).alias("tokens_in"),
        F.col("cost").cast("double").alias("cost"),
        F.coalesce("status", empty).alias("status"),
        F.coalesce("error", empty).alias("error"),
    )


@check("SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'purchase') GROUP BY event_type")
def enabled_source_counts(spark, folder):
    return M.enabled_only(table(spark, folder, "events"), ["click", "purchase"], "event_type").groupBy("event_type").agg(F.count("*").alias("n"))


@check(
    f"""
    SELECT c_custkey, c_name, n AS events, total AS value FROM customer,
      (SELECT count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events)
    """
)
def global_stats_per_customer(spark, folder):
    stats = table(spark, folder, "events").agg(
        F.count("*").alias("events"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value")
    )
    return R.attach_sources(table(spark, folder, "customer").select("c_custkey", "c_name"), stats)


CONFIG_SQL = """
    SELECT c_custkey, 'p' || c_custkey AS project, c_custkey % 6 <> 0 AS has_repo,
           CASE WHEN c_custkey % 6 <> 0 THEN 'org/' || c_custkey END AS repo,
           CASE WHEN c_custkey % 5 <> 0 THEN 'C' || c_custkey END AS slack_channel_id,
           CASE WHEN c_custkey % 7 = 0 THEN 'http://teams/' || c_custkey END AS teams_url
    FROM customer WHERE c_custkey % 11 <> 0
"""


def landed_configs(spark, folder):
    """One configuration text per customer; every eleventh is malformed."""
    key = F.col("c_custkey")
    name = lambda p: F.concat(F.lit(p), key)
    settings = F.struct(
        F.when(key % 6 != 0, name("org/")).alias("repo"),
        F.when(key % 5 != 0, name("C")).alias("slack_channel_id"),
        F.when(key % 7 == 0, name("http://teams/")).alias("teams_url"),
    )
    text = F.concat(F.lit('{"p'), key, F.lit('":'), F.to_json(settings), F.lit("}"))
    return table(spark, folder, "customer").select("c_custkey", F.when(key % 11 == 0, "{broken").otherwise(text).alias("config"))


@check(
    f"""
    SELECT c_custkey, project, coalesce(repo, '') AS repo, coalesce(slack_channel_id, '') AS slack_channel_id,
           coalesce(teams_url, '') AS teams_url, CAST(has_repo AS INTEGER) AS has_repo
    FROM ({CONFIG_SQL}) WHERE c_custkey % 13 <> 0
    UNION ALL SELECT c_custkey, 'default-proj', '', 'C0', '', 1 FROM customer WHERE c_custkey % 13 = 0
    """
)
def project_configs(spark, folder):
    absent = F.when(F.col("c_custkey") % 13 != 0, F.col("config"))
    rows = L.projects(landed_configs(spark, folder).withColumn("config", absent), fallback={"slack_channel_id": "C0"})
    empty = F.lit("")
    return rows.select(
        "c_custkey",
        "project",
        *[F.coalesce(c, empty).alias(c) for c in ("repo", "slack_channel_id", "teams_url")],
        F.col("has_repo").cast("int").alias("has_repo"),
    )


@check(
    f"""
    SELECT user_id, CAST(sum({K}) AS BIGINT) AS total_tokens, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total_cost,
           string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS models_used
    FROM events GROUP BY user_id
    """
)
def run_metadata_by_user(spark, folder):
    events = table(spark, folder, "events").select("user_id", k().alias("k"), "value", "event_type")
    got = E.run_metadata(events, ["user_id"], F.col("k"), F.col("value").cast("decimal(18,2)"), F.col("event_type"))
    return got.withColumn("total_cost", F.col("total_cost").cast("double"))


@check(
    """
    SELECT event_type, count(DISTINCT value) AS models, 1 AS within FROM events GROUP BY event_type
    """
)
def distinct_values_by_type(spark, folder):
    """Exact counts of a column of many values, and whether the sketches of all users, merged, keep to their bounds."""
    events = table(spark, folder, "events").select("event_type", "user_id", F.col("value").cast("string").alias("value"))
    exact = E.model_counts(events, ["event_type"], F.col("value")).select("event_type", "models")
    parts = E.model_counts(events, ["event_type", "user_id"], F.col("value"))
    merged = E.merged_counts(parts, ["event_type"])
    both = exact.join(merged, "event_type")
    return both.select("event_type", "models", F.col("models").between(F.col("least"), F.col("most")).cast("int").alias("within"))


@check(
    f"""
    SELECT user_id, string_agg(event_type || ': API error: ' || e, chr(10) ORDER BY event_type) AS warnings
    FROM (SELECT user_id, event_type, max({K}) AS e FROM events WHERE {K} >= 90 GROUP BY user_id, event_type) GROUP BY user_id
    """
)
def warnings_by_user(spark, folder):
    kinds = ["click", "error", "purchase", "signup", "view"]
    code = F.when(k() >= 90, k())
    worst = table(spark, folder, "events").groupBy("user_id").agg(
        *[F.max(F.when(F.col("event_type") == n, code)).alias(n) for n in kinds]
    )
    entries = F.create_map(*[p for n in kinds for p in (F.lit(n), F.concat(F.lit("API error: "), F.col(n).cast("string")))])
    return worst.select("user_id", R.warning_lines(R.present(entries)).alias("warnings")).where("warnings is not null")


@check(
    """
    SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS iso, strftime(ts - INTERVAL 7 DAY, '%Y-%m-%d') AS week_before,
           CAST(ts < TIMESTAMP '2024-01-15' AS INTEGER) AS first_half
    FROM events
    """
)
def iso_times(spark, folder):
    iso = temporal.iso_format(F.col("ts"))
    back = temporal.parse_iso(iso)
    week = F.col("ts") - F.make_dt_interval(F.lit(7))
    return table(spark, folder, "events").select(
        "event_id",
        iso.alias("iso"),
        temporal.day_format(week).alias("week_before"),
        (back < temporal.instant("2024-01-15T00:00:00Z")).cast("int").alias("first_half"),
    )


@check(
    """
    SELECT o_orderkey, (t // 10) || '.' || (t % 10) AS short_text, (c // 100) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') || '00' AS long_text
    FROM (
      SELECT o_orderkey, c, c // 10 + CASE WHEN c % 10 > 5 OR (c % 10 = 5 AND (c // 10) % 2 = 1) THEN 1 ELSE 0 END AS t
      FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders)
    )
    """
)
def money_texts(spark, folder):
    price = money.amount(F.col("o_totalprice").cast("string"))
    return table(spark, folder, "orders").select(
        "o_orderkey", money.money_text(price, 1).alias("short_text"), money.money_text(price, 4).alias("long_text")
    )


@check(
    f"""
    SELECT event_id, {K} AS k, '{{"event_id":' || event_id || ',"event_type":"' || event_type || '","props":{{"k":' || {K} || '}}}}' AS record
    FROM events
    """
)
def event_json(spark, folder):
    props = F.from_json("props", "struct<k: bigint>")
    record = F.to_json(F.struct("event_id", "event_type", props.alias("props")))
    return table(spark, folder, "events").select("event_id", props["k"].alias("k"), record.alias("record"))
