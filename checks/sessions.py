"""Session cost over ``conversations`` (rows F3, W1, W2, A12, A13)."""

from pyspark.sql import functions as F

from checks.registry import check, table
from opslens import values as V
from opslens.functions import text as T
from opslens.operators import sessions as S
from opslens.operators.ordered import item_chunks, ranked_chunks, row_numbers

RUNNING_SQL = """
    SELECT conv_id, turn, role, length(text) // 4 AS tokens,
           SUM(length(text) // 4) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS context_tokens,
           SUM(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS task
    FROM {conversations}
"""
ISOLATED_SQL = "SELECT *, SUM(tokens) OVER (PARTITION BY conv_id, task ORDER BY turn NULLS FIRST) AS isolated_tokens FROM ({running})"
RUNNING = RUNNING_SQL.format(conversations="conversations")
ISOLATED = ISOLATED_SQL.format(running=RUNNING)

#: A tenth of the sessions lose their key, the second turn of the others loses its number, and turns lie far apart.
GAPS_SQL = """(SELECT CASE WHEN conv_id % 10 <> 3 THEN conv_id END AS conv_id, role, text,
                      CASE WHEN turn <> 1 OR conv_id % 10 = 3 THEN conv_id * 1000000 + turn * 1000 END AS turn FROM conversations)"""
RUNNING_GAPS = RUNNING_SQL.format(conversations=GAPS_SQL)
ISOLATED_GAPS = ISOLATED_SQL.format(running=RUNNING_GAPS)


def with_gaps(spark, folder):
    conv, turn = F.col("conv_id"), F.col("turn")
    messages = table(spark, folder, "conversations").select(
        F.when(conv % 10 != 3, conv).alias("conv_id"),
        F.when((turn != 1) | (conv % 10 == 3), conv * 1000000 + turn * 1000).alias("turn"),
        "role",
        "text",
    )
    return ranked_chunks(messages, ["conv_id"], ["turn"], max_rows=3)


@check(
    f"SELECT conv_id, turn, CAST(tokens AS BIGINT) AS tokens, CAST(context_tokens AS BIGINT) AS context_tokens FROM ({RUNNING_GAPS})"
)
def session_running_cost_with_gaps(spark, folder):
    cost = S.session_cost(with_gaps(spark, folder), "cumulative", chunk=F.col("chunk"))
    return cost.select("conv_id", "turn", "tokens", "context_tokens")


@check(
    f"SELECT conv_id, turn, CAST(task AS BIGINT) AS task, CAST(isolated_tokens AS BIGINT) AS context_tokens FROM ({ISOLATED_GAPS})"
)
def session_isolated_cost_with_gaps(spark, folder):
    cost = S.session_cost(with_gaps(spark, folder), "isolated", chunk=F.col("chunk"))
    return cost.select("conv_id", "turn", "task", "context_tokens")


@check("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS row_no FROM " + GAPS_SQL)
def numbered_turns_with_gaps(spark, folder):
    rows = with_gaps(spark, folder).select("conv_id", "turn", "chunk")
    return row_numbers(rows, ["conv_id"], ["turn"], F.col("chunk")).drop("chunk")


@check(
    "SELECT conv_id, turn, CAST(ceil(row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) / 4.0) AS BIGINT) AS chunk_no FROM "
    + GAPS_SQL
)
def turn_groups_with_gaps(spark, folder):
    rows = with_gaps(spark, folder).select("conv_id", "turn", "chunk")
    return item_chunks(rows, ["conv_id"], ["turn"], F.col("chunk"), items=4).drop("chunk")


@check(
    f"SELECT conv_id, turn, CAST(tokens AS BIGINT) AS tokens, CAST(context_tokens AS BIGINT) AS context_tokens FROM ({RUNNING})"
)
def session_running_cost(spark, folder):
    return S.running_cost(table(spark, folder, "conversations")).select("conv_id", "turn", "tokens", "context_tokens")


@check(
    f"""
    SELECT conv_id, CAST(count(*) AS BIGINT) AS turns, CAST(max(context_tokens) AS BIGINT) AS final_context,
           CAST(sum(context_tokens) AS BIGINT) AS billed,
           CAST(sum(CASE WHEN role = 'system' THEN tokens ELSE 0 END) AS BIGINT) AS system_tokens,
           CAST(sum(CASE WHEN role = 'user' THEN tokens ELSE 0 END) AS BIGINT) AS user_tokens,
           CAST(sum(CASE WHEN role = 'assistant' THEN tokens ELSE 0 END) AS BIGINT) AS assistant_tokens
    FROM ({RUNNING}) GROUP BY conv_id
    """
)
def session_totals(spark, folder):
    return S.session_totals(table(spark, folder, "conversations"))


@check(
    f"""
    SELECT conv_id, turn, CAST(task AS BIGINT) AS task, CAST(isolated_tokens AS BIGINT) AS context_tokens FROM ({ISOLATED})
    """
)
def session_isolated_cost(spark, folder):
    return S.isolated_cost(table(spark, folder, "conversations")).select("conv_id", "turn", "task", "context_tokens")


@check(
    f"""
    SELECT conv_id, CAST(sum(context_tokens) AS BIGINT) AS cumulative, CAST(sum(isolated_tokens) AS BIGINT) AS isolated,
           round(COALESCE((1 - sum(isolated_tokens) / CAST(nullif(sum(context_tokens), 0) AS DOUBLE)) * 100, 0), 6) AS savings_pct
    FROM ({ISOLATED}) GROUP BY conv_id
    """
)
def session_savings(spark, folder):
    saved = S.session_savings(table(spark, folder, "conversations"))
    return saved.withColumn("savings_pct", F.round(F.coalesce("savings_pct", F.lit(0.0)), 6))


@check(
    f"""
    SELECT CAST(sum(context_tokens) AS BIGINT) AS cumulative, CAST(sum(isolated_tokens) AS BIGINT) AS isolated,
           round((1 - sum(isolated_tokens) / CAST(sum(context_tokens) AS DOUBLE)) * 100, 6) AS savings_pct
    FROM ({ISOLATED})
    """
)
def overall_savings(spark, folder):
    saved = S.session_savings(table(spark, folder, "conversations"))
    total = saved.agg(F.sum("cumulative").alias("cumulative"), F.sum("isolated").alias("isolated"))
    return total.withColumn("savings_pct", F.round(S.savings_pct(F.col("cumulative"), F.col("isolated")), 6))


@check(
    """
    SELECT doc_id, length(text) // 4 AS floor_tokens, greatest(1, length(text) // 4) AS some_tokens,
           CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS tokens,
           length(substr(text, 1, 5000)) AS context_chars, substr(text, 1, 150) AS snippet
    FROM documents
    """
)
def document_tokens(spark, folder):
    text = F.col("text")
    return table(spark, folder, "documents").select(
        "doc_id",
        T.tokens_floor(text).alias("floor_tokens"),
        T.tokens_at_least_one(text).alias("some_tokens"),
        T.tokens(text).alias("tokens"),
        F.length(T.prefix(text, V.CONTEXT_PREFIX_CHARS)).cast("bigint").alias("context_chars"),
        T.prefix(text, V.SNIPPET_CHARS).alias("snippet"),
    )
