"""Ordered-row operators over ``events`` as lines of a log, and the in-row forms over ``documents``.

A user's events are one log, ordered by (ts, event_id).
"""

from pyspark.sql import functions as F

from checks.registry import check, table
from opslens.functions import text as T
from opslens.operators import ordered as O
from opslens.sources.corpus import line_rows

K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


KEY, ORDER = ["user_id"], ["ts", "event_id"]

#: A tenth of the keys and a tenth of the times of the log are NULL.
GAPS_SQL = """(SELECT event_id, event_type, value, props, CASE WHEN event_id % 10 <> 3 THEN user_id END AS user_id,
                      CASE WHEN event_id % 10 <> 7 THEN ts END AS ts FROM events)"""


def log(spark, folder, gaps=False, rows=O.CHUNK_ROWS):
    """The log in chunks of at most ``rows`` rows; the checks with gaps make them so small that most keys have several."""
    events = table(spark, folder, "events")
    if gaps:
        hole = lambda c, digit: F.when(F.col("event_id") % 10 != digit, F.col(c))
        events = events.withColumns({"user_id": hole("user_id", 3), "ts": hole("ts", 7)})
    lines = events.select("event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    return O.ranked_chunks(lines, KEY, ORDER, max_rows=rows)


FIRST_ERROR_SQL = """
    WITH e AS (
      SELECT event_id, user_id, event_type,
             row_number() OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n,
             CASE WHEN event_type = 'error' AND {k} >= 90 THEN 0 WHEN event_type = 'purchase' AND {k} >= 95 THEN 1 END AS kind
      FROM {events}
    ), f AS (
      SELECT user_id, min(i) AS m, min_by(kind, i) AS kind FROM e WHERE kind IS NOT NULL GROUP BY user_id
    )
    SELECT e.user_id, e.event_id, e.event_type FROM e LEFT JOIN f ON e.user_id IS NOT DISTINCT FROM f.user_id
    WHERE CASE WHEN f.m IS NULL THEN e.i > e.n - 5
               WHEN f.kind = 0 THEN e.i BETWEEN f.m AND f.m + 9
               ELSE e.i BETWEEN f.m - 1 AND f.m + 8 END
"""


def first_errors(spark, folder, gaps=False, rows=O.CHUNK_ROWS, **options):
    match = (F.col("event_type") == "error") & (F.col("k") >= 90)
    call = (F.col("event_type") == "purchase") & (F.col("k") >= 95)
    kept = O.first_error_rows(log(spark, folder, gaps, rows), KEY, ORDER, F.col("chunk"), match, call, keep=10, tail=5, **options)
    return kept.select("user_id", "event_id", "event_type")


@check(FIRST_ERROR_SQL.format(k=K, events="events"))
def first_error_events(spark, folder):
    return first_errors(spark, folder)


@check(FIRST_ERROR_SQL.format(k=K, events=GAPS_SQL))
def first_error_events_with_gaps(spark, folder):
    return first_errors(spark, folder, gaps=True, rows=50)


@check(FIRST_ERROR_SQL.format(k=K, events=GAPS_SQL))
def first_error_events_with_gaps_shuffled(spark, folder):
    return first_errors(spark, folder, gaps=True, rows=50, broadcast_rows=0)


PRUNED_SQL = """
    WITH e AS (
      SELECT event_id, user_id, event_type, event_type = 'error' AND {k} >= 50 AS err, event_type = 'view' AS vendor, ts FROM {events}
    ), s AS (
      SELECT *, coalesce(max(CASE WHEN err THEN 1 ELSE 0 END) OVER
             (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM e
    )
    SELECT user_id, event_id, event_type FROM s WHERE err OR NOT vendor OR seen = 0
"""


def pruned(spark, folder, gaps=False, rows=O.CHUNK_ROWS, **options):
    error = (F.col("event_type") == "error") & (F.col("k") >= 50)
    kept = O.prune_rows(log(spark, folder, gaps, rows), KEY, ORDER, F.col("chunk"), error, F.col("event_type") == "view", **options)
    return kept.select("user_id", "event_id", "event_type")


@check(PRUNED_SQL.format(k=K, events="events"))
def pruned_events(spark, folder):
    return pruned(spark, folder)


@check(PRUNED_SQL.format(k=K, events=GAPS_SQL))
def pruned_events_with_gaps(spark, folder):
    return pruned(spark, folder, gaps=True)


@check(PRUNED_SQL.format(k=K, events=GAPS_SQL))
def pruned_events_with_gaps_shuffled(spark, folder):
    return pruned(spark, folder, gaps=True, rows=50, broadcast_rows=0)


REPEATED_SQL = """
    SELECT user_id, event_id, event_type FROM {events}
    QUALIFY event_type = lag(event_type, 1) OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id)
        AND event_type = lag(event_type, 2) OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id)
"""


@check(REPEATED_SQL.format(events="events"))
def repeated_event_types(spark, folder):
    return O.repeated_calls(log(spark, folder), KEY, ORDER, F.col("chunk"), ["event_type"], times=3).drop("ts")


@check(REPEATED_SQL.format(events=GAPS_SQL))
def repeated_event_types_with_gaps(spark, folder):
    return O.repeated_calls(log(spark, folder, gaps=True, rows=50), KEY, ORDER, F.col("chunk"), ["event_type"], times=3).drop("ts")


BREACH_SQL = """
    WITH e AS (
      SELECT user_id, event_id, ts,
             CAST(SUM(CAST(value AS DECIMAL(18,2))) OVER w AS DOUBLE) AS cost,
             CAST(SUM({k}) OVER w AS DOUBLE) AS tokens,
             (epoch_us(ts) - MIN(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS wall_clock
      FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id)
    ), b AS (
      SELECT user_id, event_id, ts, 'cost' AS budget, cost AS total FROM e WHERE cost > 500
      UNION ALL SELECT user_id, event_id, ts, 'tokens', tokens FROM e WHERE tokens > 1000
      UNION ALL SELECT user_id, event_id, ts, 'wall_clock', wall_clock FROM e WHERE wall_clock > 864000
    )
    SELECT user_id, budget, event_id, round(total, 4) AS total FROM b
    QUALIFY row_number() OVER (PARTITION BY user_id, budget ORDER BY ts NULLS FIRST, event_id) = 1
"""


def breaches(spark, folder, gaps=False, rows=O.CHUNK_ROWS):
    spent = {"cost": (F.col("value").cast("decimal(18,2)"), 500), "tokens": (F.col("k"), 1000)}
    found = O.first_breach(log(spark, folder, gaps, rows), KEY, ORDER, F.col("chunk"), spent, F.col("ts"), 10 * 86400)
    return found.select("user_id", "budget", "event_id", F.round("total", 4).alias("total"))


@check(BREACH_SQL.format(k=K, events="events"))
def budget_breaches(spark, folder):
    return breaches(spark, folder)


@check(BREACH_SQL.format(k=K, events=GAPS_SQL))
def budget_breaches_with_gaps(spark, folder):
    return breaches(spark, folder, gaps=True, rows=50)


@check("SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS row_no FROM part")
def numbered_parts(spark, folder):
    parts = table(spark, folder, "part").select("p_brand", "p_partkey")
    return O.row_numbers(parts, ["p_brand"], ["p_partkey"], O.position_chunk("p_partkey"))


@check(
    """
    SELECT source, doc_id, CAST(ceil(row_number() OVER (PARTITION BY source ORDER BY doc_id) / 40.0) AS BIGINT) AS chunk_no
    FROM documents
    """
)
def document_chunks(spark, folder):
    docs = table(spark, folder, "documents").select("source", "doc_id")
    return O.item_chunks(docs, ["source"], ["doc_id"], O.position_chunk("doc_id"))


@check(
    """
    SELECT o_orderpriority, o_orderkey FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) <= 100
    """
)
def latest_orders_per_priority(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderpriority", "o_orderkey", "o_orderdate")
    newest = [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]
    return O.latest_rows(orders, ["o_orderpriority"], newest, cap=100).drop("o_orderdate")


LINES = """
    SELECT doc_id, i - 1 AS line_no, l[i] AS line FROM (
      SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (
        SELECT doc_id, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM (
          SELECT doc_id, string_split_regex({text}, '\\r\\n|[\\n\\r\\x{{0b}}\\x{{0c}}\\x{{1c}}-\\x{{1e}}\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS l FROM documents
        )
      )
    )
"""


@check(f"SELECT doc_id, line_no, line FROM ({LINES.format(text='text')})")
def document_line_numbers(spark, folder):
    rows = line_rows(table(spark, folder, "documents").select("doc_id", "text"), "text")
    return rows.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "line")


NOISY_SQL = "replace(replace(text, 'License', 'Error: License'), chr(10) || 'The ', chr(10) || 'at ')"


def noisy():
    marked = F.replace(F.col("text"), F.lit("License"), F.lit("Error: License"))
    return F.replace(marked, F.lit("\nThe "), F.lit("\nat "))


@check(
    f"""
    WITH lines AS ({LINES.format(text=NOISY_SQL)}), r AS (
      SELECT doc_id, line_no, regexp_replace(line, '[\\s\\x{{1c}}-\\x{{1f}}\\x{{a0}}]+$', '') AS line,
             CASE WHEN regexp_matches(line, 'Traceback \\(most recent call last\\):|panic: |AssertionError|panicked at|stack backtrace:|Exception in thread|\\w+Exception:|(TypeError|ReferenceError|SyntaxError|Error):') THEN 0
                  WHEN regexp_matches(line, '^\\s*at ') THEN 1 END AS kind,
             count(*) OVER (PARTITION BY doc_id) AS n
      FROM lines
    ), f AS (SELECT doc_id, min(line_no) AS m, min_by(kind, line_no) AS kind FROM r WHERE kind IS NOT NULL GROUP BY doc_id),
    k AS (
      SELECT r.doc_id, r.line_no, r.line FROM r LEFT JOIN f USING (doc_id)
      WHERE CASE WHEN f.m IS NULL THEN r.line_no >= r.n - 40
                 WHEN f.kind = 0 THEN r.line_no BETWEEN f.m AND f.m + 99
                 ELSE r.line_no BETWEEN f.m - 1 AND f.m + 98 END
    )
    SELECT doc_id, count(*) AS kept, string_agg(line, chr(10) ORDER BY line_no) AS trace FROM k GROUP BY doc_id
    """
)
def document_error_traces(spark, folder):
    kept = T.first_error_lines(T.document_lines(noisy()))
    docs = table(spark, folder, "documents").select("doc_id", "text").select("doc_id", kept.alias("lines"))
    return docs.select("doc_id", F.size("lines").cast("bigint").alias("kept"), F.array_join("lines", "\n").alias("trace"))


@check(
    f"""
    WITH lines AS ({LINES.format(text="replace(replace(text, 'License', 'FAILED'), ' of ', ' venv/of ')")}), r AS (
      SELECT doc_id, line_no, line, regexp_matches(line, 'Exception|Error:|Traceback|FAILED|AssertionError|ERROR|CRITICAL') AS err,
             regexp_matches(line, 'node_modules/|venv/|site-packages/|/lib/python|/usr/lib/|external/') AS vendor
      FROM lines
    ), f AS (SELECT doc_id, min(CASE WHEN err THEN line_no END) AS m FROM r GROUP BY doc_id),
    k AS (
      SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS pruned
      FROM r JOIN f USING (doc_id) WHERE err OR NOT vendor OR f.m IS NULL OR line_no < f.m GROUP BY doc_id
    )
    SELECT doc_id, coalesce(pruned, '') AS pruned FROM documents LEFT JOIN k USING (doc_id)
    """
)
def pruned_documents(spark, folder):
    text = F.replace(F.replace(F.col("text"), F.lit("License"), F.lit("FAILED")), F.lit(" of "), F.lit(" venv/of "))
    pruned = T.prune_lines(T.document_lines(text))
    docs = table(spark, folder, "documents").select("doc_id", "text").select("doc_id", pruned.alias("lines"))
    return docs.select("doc_id", F.array_join("lines", "\n").alias("pruned"))
