"""Context cost of sessions: every turn is billed for all messages up to it.

Turns count densely from 0, as a rule, and chunks follow from them; for turns with wide gaps, such as times or byte
offsets, give the column of ``ranked_chunks`` as ``chunk``. NULL sessions and turns are kept and come first.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslens.functions.text import tokens_floor
from opslens.operators.ordered import grouped, position_chunk, running_sums


def running_cost(
    messages: DataFrame,
    session: Sequence[str] = ("conv_id",),
    turn: str = "turn",
    text: str = "text",
    chunk: Column | None = None,
    tokens=tokens_floor,
) -> DataFrame:
    """Add ``tokens`` and ``context_tokens`` to every message."""
    counted = messages.withColumn("tokens", tokens(F.col(text)))
    chunk = position_chunk(turn) if chunk is None else chunk
    return running_sums(counted, list(session), [turn], chunk, {"context_tokens": F.col("tokens")})


def with_tasks(
    messages: DataFrame,
    session: Sequence[str] = ("conv_id",),
    turn: str = "turn",
    role: str = "role",
    chunk: Column | None = None,
) -> DataFrame:
    """Add ``task``: how many user messages the session has had so far."""
    chunk = position_chunk(turn) if chunk is None else chunk
    asked = F.when(F.col(role) == "user", 1).otherwise(0).cast("bigint")
    return running_sums(messages, list(session), [turn], chunk, {"task": asked})


def isolated_cost(
    messages: DataFrame,
    session: Sequence[str] = ("conv_id",),
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    chunk: Column | None = None,
    tokens=tokens_floor,
) -> DataFrame:
    """As :func:`running_cost`, with the history dropped at the start of every task; adds ``task`` too.

    The isolated context of a row is its running total less the total before its task. That base is the running
    maximum of the totals before user messages, so one pass over the chunks gives all of it.
    """
    session = list(session)
    group = [*session, "_chunk"]
    chunk = position_chunk(turn) if chunk is None else chunk
    begins = F.coalesce(F.col(role) == "user", F.lit(False))
    inside = Window.partitionBy("_group").orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
    local = (
        grouped(messages.withColumns({"tokens": tokens(F.col(text)), "_asked": begins.cast("bigint")}), session, chunk)
        .withColumns({"_run": F.sum("tokens").over(inside), "_task": F.sum("_asked").over(inside)})
        .withColumn("_base", F.max(F.when(begins, F.col("_run") - F.col("tokens"))).over(inside))
    )
    per_chunk = local.groupBy(*group).agg(
        F.sum("tokens").alias("_s"), F.sum("_asked").alias("_a"), F.max("_base").alias("_b")
    )
    before = Window.partitionBy(*session).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("bigint")
    placed = per_chunk.withColumns(
        {"_offset": F.coalesce(F.sum("_s").over(before), none), "_tasks": F.coalesce(F.sum("_a").over(before), none)}
    )
    placed = placed.withColumn("_carried", F.coalesce(F.max(F.col("_b") + F.col("_offset")).over(before), none))
    joined = local.join(placed.select(F.struct(*group).alias("_group"), "_offset", "_tasks", "_carried"), "_group")
    base = F.coalesce(F.col("_base") + F.col("_offset"), F.col("_carried"))
    return joined.select(
        *messages.columns,
        "tokens",
        (F.col("_tasks") + F.col("_task")).alias("task"),
        (F.col("_run") + F.col("_offset") - base).alias("context_tokens"),
    )


def session_totals(
    messages: DataFrame,
    session: Sequence[str] = ("conv_id",),
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    roles: Sequence[str] = ("system", "user", "assistant"),
    chunk: Column | None = None,
    tokens=tokens_floor,
) -> DataFrame:
    """Turns, final context, billed tokens and tokens per role of each session.

    A chunk's bill is its own running total plus its offset on each of its turns, so only one row per chunk
    leaves the chunk: no row-level result is carried to the session.
    """
    chunk = position_chunk(turn) if chunk is None else chunk
    group = [*session, "_chunk"]
    counted = messages.select(
        *session,
        F.col(turn).alias("_turn"),
        F.col(role).alias("_role"),
        tokens(F.col(text)).alias("_t"),
        chunk.alias("_chunk"),
    )
    inside = Window.partitionBy(*group).orderBy("_turn").rowsBetween(Window.unboundedPreceding, 0)
    per_chunk = (
        counted.withColumn("_run", F.sum("_t").over(inside))
        .groupBy(*group)
        .agg(
            F.count("*").alias("_n"),
            F.sum("_t").alias("_sum"),
            F.sum("_run").alias("_billed"),
            *[F.sum(F.when(F.col("_role") == r, F.col("_t")).otherwise(0)).alias(f"{r}_tokens") for r in roles],
        )
    )
    before = Window.partitionBy(*session).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    placed = per_chunk.withColumn("_offset", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    return placed.groupBy(*session).agg(
        F.sum("_n").alias("turns"),
        F.sum("_sum").alias("final_context"),
        F.sum(F.col("_billed") + F.col("_offset") * F.col("_n")).alias("billed"),
        *[F.sum(f"{r}_tokens").alias(f"{r}_tokens") for r in roles],
    )


def savings_pct(before: Column, after: Column) -> Column:
    """Percentage saved; NULL if there was nothing to save."""
    return F.when(before > 0, (1 - after / before) * 100)


def session_savings(
    messages: DataFrame,
    session: Sequence[str] = ("conv_id",),
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    chunk: Column | None = None,
    tokens=tokens_floor,
) -> DataFrame:
    """Cumulative against isolated cost per session, from one pass of running sums.

    The isolated context of a row is its context less the context before its task, which is the smallest
    ``context - tokens`` of the task.
    """
    chunk = position_chunk(turn) if chunk is None else chunk
    counted = messages.select(*session, turn, F.col(role).alias("_role"), tokens(F.col(text)).alias("_t"))
    asked = F.when(F.col("_role") == "user", 1).otherwise(0).cast("bigint")
    totals = running_sums(counted, list(session), [turn], chunk, {"_context": F.col("_t"), "_task": asked})
    per_task = totals.groupBy(*session, "_task").agg(
        F.sum("_context").alias("_billed"), F.count("*").alias("_n"), F.min(F.col("_context") - F.col("_t")).alias("_base")
    )
    both = per_task.groupBy(*session).agg(
        F.sum("_billed").alias("cumulative"), F.sum(F.col("_billed") - F.col("_n") * F.col("_base")).alias("isolated")
    )
    return both.withColumn("savings_pct", savings_pct(F.col("cumulative"), F.col("isolated")))


def session_cost(messages: DataFrame, mode: str = "cumulative", **columns) -> DataFrame:
    """Context cost per message: ``cumulative`` keeps the history of the session, ``isolated`` that of the task."""
    if mode not in ("cumulative", "isolated"):
        raise ValueError("mode must be 'cumulative' or 'isolated'")
    return (running_cost if mode == "cumulative" else isolated_cost)(messages, **columns)
