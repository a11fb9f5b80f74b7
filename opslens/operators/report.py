"""Assembling reports per project and rendering them for the sinks."""

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens import schemas as S
from opslens import values as V
from opslens.functions.money import money_text
from opslens.session import importable, qualified
from opslens.sources.outbox import DONE, Outbox


def source_structs(sources: DataFrame) -> DataFrame:
    """The source collection (source, counters, cost, status, error) as exactly one row.

    One nullable struct per known source plus a map of error texts, those of other sources included. Each source is
    one row here, so this is a global aggregate over a handful of rows.
    """
    pick = lambda name, schema, fields: F.max(
        F.when(F.col("source") == name, F.struct(*[F.col(f) for f in fields]))
    ).cast(schema).alias(name)
    usage_fields = ["model", "tokens_in", "tokens_out", "prompts", "cost"]
    errors = [
        F.struct(F.lit(n).alias("k"), F.max(F.when(F.col("source") == n, F.col("error"))).alias("v"))
        for n in [*V.AI_PROVIDERS, *V.CLOUD_PROVIDERS]
    ]
    other = F.col("error").isNotNull() & ~F.coalesce(F.col("source").isin(*V.AI_PROVIDERS, *V.CLOUD_PROVIDERS), F.lit(False))
    named = F.struct(F.coalesce("source", F.lit(V.UNREADABLE_SOURCE)).alias("k"), F.col("error").alias("v"))
    others = F.map_from_entries(F.array_sort(F.collect_set(F.when(other, named))))
    return sources.agg(
        *[pick(n, S.USAGE_STATS, usage_fields) for n in V.AI_PROVIDERS],
        *[pick(n, S.COST_STATS, ["cost", "status"]) for n in V.CLOUD_PROVIDERS],
        F.map_concat(F.map_from_entries(F.array(*errors)), others).alias("errors"),
    )


def attach_sources(projects: DataFrame, one_row: DataFrame) -> DataFrame:
    """Give every project the one row of source stats as a scalar subquery: evaluated once, no join."""
    row = one_row.select(F.struct(*[F.col(c) for c in one_row.columns]).alias("row")).scalar()
    return projects.withColumn("_sources", row).select("*", "_sources.*").drop("_sources")


def present(entries: Column) -> Column:
    """Map entries whose value is not NULL; NULL if none is left."""
    kept = F.map_filter(entries, lambda _, v: v.isNotNull())
    return F.when(F.size(kept) > 0, kept)


def reports(projects: DataFrame, metrics: DataFrame, one_row: DataFrame, activity_enabled: bool = True) -> DataFrame:
    """One report per project: (project, stats, warnings, slack_channel_id, teams_url).

    A failed source keeps its zero row in ``stats`` and its error text moves to ``warnings`` of every project.
    """
    known = metrics.select(
        F.col("repo").alias("_repo"),
        F.struct(*[F.col(n) for n in V.ACTIVITY_FIELDS]).alias("_github"),
        F.col("error").alias("_github_error"),
    )
    # Projects without a repo match nothing; a key of their own keeps them from meeting in one task.
    own = F.coalesce("repo", F.concat(F.lit("\0"), F.col("project")))
    joined = projects.join(known, own == F.col("_repo"), "left") if activity_enabled else projects
    if activity_enabled:
        wanted = F.col("has_repo")
        zero = F.struct(*[F.lit(0).cast("bigint").alias(n) for n in V.ACTIVITY_FIELDS])
        no_repo = F.coalesce(F.col("repo"), F.lit("")) == ""
        github = F.when(wanted & no_repo, zero).when(wanted, F.col("_github"))
        github_error = F.when(wanted & no_repo, F.lit(V.MISSING_TOKEN_OR_REPO)).when(wanted, F.col("_github_error"))
    else:
        github, github_error = F.lit(None).cast(S.ACTIVITY_STATS), F.lit(None).cast("string")
    known_of = joined.select(
        "project", "slack_channel_id", "teams_url", github.alias("github"), github_error.alias("_error")
    )
    attached = attach_sources(known_of, one_row)
    names = ["github", *V.AI_PROVIDERS, *V.CLOUD_PROVIDERS]
    warnings = present(F.map_concat(F.create_map(F.lit("github"), F.col("_error")), F.col("errors")))
    return attached.select(
        "project",
        F.struct(*[F.col(n) for n in names]).alias("stats"),
        warnings.alias("warnings"),
        "slack_channel_id",
        "teams_url",
    )


def activity_text(stats: Column) -> Column:
    """Text of the activity section; NULL if the project has none."""
    github = stats["github"]
    return F.when(github.isNotNull(), F.format_string(V.ACTIVITY_FORMAT, *[github[n] for n in V.ACTIVITY_FIELDS]))


def _section(title: str, lines: list[Column]) -> Column:
    body = F.concat_ws("\n", *lines)
    return F.when(body != "", F.concat(F.lit(title + "\n"), body))


def usage_text(stats: Column) -> Column:
    lines = [
        F.when(
            stats[n].isNotNull(),
            F.format_string(
                V.USAGE_FORMAT,
                F.initcap(F.lit(n)),
                stats[n]["model"],
                stats[n]["tokens_in"],
                stats[n]["tokens_out"],
                money_text(stats[n]["cost"], 4),
            ),
        )
        for n in V.AI_PROVIDERS
    ]
    return _section(V.USAGE_TITLE, lines)


def cost_text(stats: Column) -> Column:
    lines = [
        F.when(stats[n].isNotNull(), F.format_string(V.COST_FORMAT, F.upper(F.lit(n)), money_text(stats[n]["cost"], 2)))
        for n in V.CLOUD_PROVIDERS
    ]
    return _section(V.COST_TITLE, lines)


def warning_lines(warnings: Column) -> Column:
    return F.array_join(F.transform(F.map_entries(warnings), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def message_blocks(project: Column, stats: Column, warnings: Column) -> Column:
    """Blocks of a structured message: header, one section per family of sources, warnings as context."""
    text = lambda kind, value, emoji=None: F.struct(
        F.lit(kind).alias("type"), value.alias("text"), F.lit(emoji).cast("boolean").alias("emoji")
    )
    element = "array<struct<type: string, text: string>>"
    block = lambda kind, body, elements=None: F.struct(
        F.lit(kind).alias("type"),
        body.alias("text"),
        (F.lit(None).cast(element) if elements is None else elements).alias("elements"),
    )
    no_text = F.lit(None).cast("struct<type: string, text: string, emoji: boolean>")
    sections = [
        F.when(part.isNotNull(), block("section", text("mrkdwn", part)))
        for part in (activity_text(stats), usage_text(stats), cost_text(stats))
    ]
    note = F.format_string(V.WARNING_FORMAT, warning_lines(warnings))
    context = F.when(
        warnings.isNotNull(),
        block("context", no_text, F.array(F.struct(F.lit("mrkdwn").alias("type"), note.alias("text")))),
    )
    header = block("header", text("plain_text", F.format_string(V.HEADER_FORMAT, project), True))
    return F.filter(F.array(header, *sections, context), lambda b: b.isNotNull())


def message_payload(report: DataFrame) -> DataFrame:
    """Add ``payload``: the structured message of each report as JSON text."""
    project = F.coalesce(F.col("project"), F.lit("Unknown Project"))
    message = F.struct(
        F.col("slack_channel_id").alias("channel"),
        F.format_string(V.FALLBACK_TEXT_FORMAT, project).alias("text"),
        message_blocks(project, F.col("stats"), F.col("warnings")).alias("blocks"),
    )
    return report.withColumn("payload", F.to_json(message))


def raw_payload(report: DataFrame) -> DataFrame:
    """Add ``payload``: the report itself as JSON text. Absent sources and warnings are left out."""
    plain = lambda n: F.when(
        F.col("stats")[n].isNotNull(), F.col("stats")[n].withField("cost", F.col("stats")[n]["cost"].cast("double"))
    ).alias(n)
    stats = F.struct(F.col("stats.github").alias("github"), *[plain(n) for n in [*V.AI_PROVIDERS, *V.CLOUD_PROVIDERS]])
    return report.withColumn(
        "payload", F.to_json(F.struct(F.col("project"), stats.alias("stats"), F.col("warnings")))
    )


def routed(report: DataFrame) -> DataFrame:
    """One row per report and destination that is set: (project, sink, destination, payload)."""
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    messages = message_payload(report).withColumnRenamed("payload", "_message")
    rendered = raw_payload(messages).withColumnRenamed("payload", "_raw")
    entry = lambda sink, where, body: F.when(
        given(where), F.struct(F.lit(sink).alias("sink"), F.col(where).alias("destination"), F.col(body).alias("payload"))
    )
    targets = F.array_compact(
        F.array(entry("slack", "slack_channel_id", "_message"), entry("teams", "teams_url", "_raw"))
    )
    return rendered.select("project", F.explode(targets).alias("_t")).select("project", "_t.*")


def is_written(spark: SparkSession, path: str, run: str) -> bool:
    """True if the run is marked as done in the outbox."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_runs/{run}.{DONE}")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def write_outbox(report: DataFrame, path: str, mode: str = "append", run: str | None = None) -> None:
    """Write the outbox: one folder per sink, JSON records (project, destination, payload).

    ``run`` names the run that the report belongs to, such as its date: a run that has been written is not written again, so a
    repeated call leaves each record once, and makes no report. Without a name every call is a run of its own.
    """
    spark = report.sparkSession
    if run and mode == "append" and is_written(spark, path, run):
        return
    importable(spark)
    spark.dataSource.register(Outbox)
    options = {"run": run or uuid.uuid4().hex, "by": "sink"}
    routed(report).write.format("outbox").options(**options).mode(mode).save(qualified(spark, path))


def write_snapshot(records: DataFrame, path: str, mode: str = "overwrite", fields: Sequence[str] | None = None) -> None:
    """Write nested records as JSON lines."""
    (records.select(*fields) if fields else records).write.mode(mode).json(path)
