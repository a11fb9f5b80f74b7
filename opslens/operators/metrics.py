"""Activity, usage and cost metrics over a trailing window."""

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens import values as V
from opslens.functions.money import MONEY, amount
from opslens.functions.temporal import in_date_range, in_trailing_window, parse_iso, window_start

AsOf = str | datetime
UNDATED = "undated"


def _zero() -> Column:
    return F.lit(0).cast("bigint")


def _status_error(status: Column) -> Column:
    return F.concat(F.lit(V.API_ERROR_PREFIX), F.coalesce(status.cast("string"), F.lit("None")))


# --- activity ------------------------------------------------------------------------------------


def malformed(records: DataFrame) -> Column:
    """True for a landed line that could not be parsed; readers keep its text in ``malformed``."""
    return F.col("malformed").isNotNull() if "malformed" in records.columns else F.lit(False)


def activity_error(row: str = "body", broken: Column | None = None) -> Column:
    """Why an activity record has no usable payload; NULL if it has one. The first reason that applies wins."""
    repo, status = F.col("repo"), F.col("http_status")
    body = F.col(row)
    repository = body["data"]["repository"]
    empty = repository.isNull() | F.coalesce(
        repository["pullRequests"].isNull() & repository["issues"].isNull() & repository["releases"].isNull(), F.lit(True)
    )
    message = F.coalesce(F.get(body["errors"], 0)["message"], F.lit(V.UNKNOWN_QUERY_ERROR))
    missing = ~F.coalesce(F.col("has_token"), F.lit(False)) | (F.coalesce(repo, F.lit("")) == "")
    return (
        F.when(F.lit(False) if broken is None else broken, V.MALFORMED_RECORD)
        .when(missing, V.MISSING_TOKEN_OR_REPO)
        .when(F.size(F.split(repo, "/")) != 2, V.INVALID_REPO_FORMAT)
        .when(F.col("exception").isNotNull(), F.col("exception"))
        .when(~status.eqNullSafe(F.lit(200)), _status_error(status))
        .when(body["errors"].isNotNull(), F.concat(F.lit(V.QUERY_ERROR_PREFIX), message))
        .when(empty, V.REPOSITORY_NOT_FOUND)
    )


def payload_metrics(activity: DataFrame, as_of: AsOf, days: int = V.WINDOW_DAYS, kept: Sequence[str | Column] = ()) -> DataFrame:
    """Metrics of each payload (repo, five counters, error), counted inside the row: nothing is exploded or shuffled.

    Columns ``kept`` of the records stand before them.
    """
    repository = F.col("body")["data"]["repository"]

    def nodes(name: str) -> Column:
        return repository[name]["nodes"]

    def recent(name: str, field: str) -> Column:
        return F.filter(nodes(name), lambda n: parse_iso(n[field]) >= window_start(as_of, days))

    def count(name: str, field: str) -> Column:
        return F.coalesce(F.size(recent(name, field)), _zero()).cast("bigint")

    def total(field: str) -> Column:
        return F.coalesce(F.aggregate("_merged", _zero(), lambda s, n: s + F.coalesce(n[field], _zero())), _zero())

    counters = {
        "prs_submitted": count("pullRequests", "createdAt"),
        "lines_added": total("additions"),
        "lines_deleted": total("deletions"),
        "bugs_closed": count("issues", "closedAt"),
        "releases_done": count("releases", "createdAt"),
    }
    told = {"error": activity_error(broken=malformed(activity)), "_merged": recent("pullRequests", "mergedAt")}
    judged = activity.withColumns(told)
    return judged.select(
        *kept,
        "repo",
        *[F.when(F.col("error").isNull(), counters[n]).otherwise(_zero()).alias(n) for n in V.ACTIVITY_FIELDS],
        "error",
    )


def repo_metrics(activity: DataFrame, as_of: AsOf, days: int = V.WINDOW_DAYS) -> DataFrame:
    """One row per repo: counters summed over its payload pages, and its first error text if any page failed.

    Grouping by (repo, error) first keeps the large aggregate a hash aggregate: a text in its key is fine, a text in
    its buffer would make Spark sort all payloads.
    """
    return combined_pages(payload_metrics(activity, as_of, days))


def combined_pages(pages: DataFrame) -> DataFrame:
    """Payload metrics summed per repo, with the first error text."""
    return first_errors(pages.groupBy("repo", "error").agg(*[F.sum(n).alias(n) for n in V.ACTIVITY_FIELDS]))


def counted_pages(activity: DataFrame, as_of: AsOf, days: int = V.WINDOW_DAYS) -> DataFrame:
    """Payload metrics summed per (repo, error), and how many lines of each, ``unreadable``, could not be parsed."""
    pages = payload_metrics(activity, as_of, days, [malformed(activity).cast("bigint").alias("unreadable")])
    return pages.groupBy("repo", "error").agg(*[F.sum(n).alias(n) for n in [*V.ACTIVITY_FIELDS, "unreadable"]])


def first_errors(counted: DataFrame) -> DataFrame:
    """Sums per (repo, error) to one row per repo, with the first error text."""
    return counted.groupBy("repo").agg(*[F.sum(n).alias(n) for n in V.ACTIVITY_FIELDS], F.min("error").alias("error"))


def daily_partials(activity: DataFrame) -> DataFrame:
    """Counters of payloads by the day that they count for: (repo, day, five counters, error), one row a repo, day and error.

    Partials of several batches add up (:func:`combined_days`). The day ``UNDATED`` has a row for every payload, so that a repo
    without counts is there, and the errors.
    """
    repository = F.col("body")["data"]["repository"]
    kinds = {n: "bigint" for n in V.ACTIVITY_FIELDS}
    entry = f"array<struct<day: string, {', '.join(f'{n}: {kind}' for n, kind in kinds.items())}>>"
    zeros = {n: _zero().alias(n) for n in kinds}

    def counted(name: str, field: str, **values: str | None) -> Column:
        def one(node: Column) -> Column:
            given = {n: (F.lit(1) if f is None else F.coalesce(node[f], _zero())).cast("bigint").alias(n) for n, f in values.items()}
            return F.struct(F.date_format(parse_iso(node[field]), "yyyy-MM-dd").alias("day"), *(zeros | given).values())

        return F.coalesce(F.transform(repository[name]["nodes"], one), F.array().cast(entry))

    undated = F.array(F.struct(F.lit(UNDATED).alias("day"), *zeros.values()))
    dated = F.concat(
        counted("pullRequests", "createdAt", prs_submitted=None),
        counted("pullRequests", "mergedAt", lines_added="additions", lines_deleted="deletions"),
        counted("issues", "closedAt", bugs_closed=None),
        counted("releases", "createdAt", releases_done=None),
    )
    judged = activity.withColumn("error", activity_error(broken=malformed(activity)))
    entries = F.when(F.col("error").isNull(), F.concat(undated, dated)).otherwise(undated)
    exploded = judged.select("repo", "error", F.explode(entries).alias("_e")).select("repo", "error", "_e.*")
    return combined_days(exploded.where("day IS NOT NULL"))


def combined_days(partials: DataFrame) -> DataFrame:
    return partials.groupBy("repo", "day", "error").agg(*[F.sum(n).alias(n) for n in V.ACTIVITY_FIELDS])


def change_counters(
    created: Column, merged: Column, added: Column, deleted: Column, as_of: AsOf, days: int = V.WINDOW_DAYS
) -> list[Column]:
    """Aggregates for flat change tables: changes created, and lines of changes merged, in the window.

    The two tests are independent: a change created before and merged inside the window counts for lines only.
    """
    in_merged = in_trailing_window(merged, as_of, days)
    lines = lambda c: F.coalesce(F.sum(F.when(in_merged, F.coalesce(c, F.lit(0)))), F.lit(0)).cast("bigint")
    return [
        F.count_if(in_trailing_window(created, as_of, days)).alias("prs_submitted"),
        lines(added).alias("lines_added"),
        lines(deleted).alias("lines_deleted"),
    ]


def closed_bugs(state: Column, labels: Column, closed: Column, as_of: AsOf, days: int = V.WINDOW_DAYS) -> Column:
    bug = (state == "CLOSED") & F.array_contains(labels, "bug") & in_trailing_window(closed, as_of, days)
    return F.count_if(bug).alias("bugs_closed")


def recent_releases(created: Column, as_of: AsOf, days: int = V.WINDOW_DAYS) -> Column:
    return F.count_if(in_trailing_window(created, as_of, days)).alias("releases_done")


def zero_filled(projects: DataFrame, metrics: DataFrame, on: Sequence[str], counters: Sequence[str]) -> DataFrame:
    """Every project with its counters; projects without metrics get zeros."""
    joined = projects.join(metrics, list(on), "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counters})


# --- usage ---------------------------------------------------------------------------------------


def usage_error(broken: Column | None = None) -> Column:
    status = F.col("http_status")
    return (
        F.when(F.lit(False) if broken is None else broken, V.MALFORMED_RECORD)
        .when(~F.coalesce(F.col("has_key"), F.lit(False)), V.MISSING_API_KEY)
        .when(F.col("exception").isNotNull(), F.col("exception"))
        .when(~status.eqNullSafe(F.lit(200)), _status_error(status))
    )


def default_model(provider: Column) -> Column:
    model = F.lit(V.UNKNOWN_MODEL)
    for name, default in V.DEFAULT_MODELS.items():
        model = F.when(provider == name, default).otherwise(model)
    return model


def usage_records(usage: DataFrame) -> DataFrame:
    """Each usage payload with typed defaults; a failed one becomes the zero row plus its error text."""
    judged = usage.withColumn("error", usage_error(malformed(usage)))
    model = F.coalesce(F.col("body.model"), default_model(F.col("provider")))
    fine = F.col("error").isNull()
    count = lambda n: F.when(fine, F.coalesce(F.col("body")[n], _zero())).otherwise(_zero()).alias(n)
    free = F.lit(0).cast(MONEY)
    kept = [c for c in usage.columns if c not in ("has_key", "http_status", "exception", "body", "malformed")]
    return judged.select(
        *kept,
        F.when(fine, model).otherwise(V.UNKNOWN_MODEL).alias("model"),
        count("tokens_in"),
        count("tokens_out"),
        count("prompts"),
        F.when(fine, F.coalesce(amount(F.col("body.cost")), free)).otherwise(free).alias("cost"),
        "error",
    )


# --- costs ---------------------------------------------------------------------------------------


def cost_records(costs: DataFrame) -> DataFrame:
    """Each cost payload as (provider, cost, status, error); string amounts are summed exactly."""
    series = F.col("body.ResultsByTime")
    summed = F.aggregate(
        F.coalesce(series, F.from_json(F.lit("[]"), "array<struct<Total: struct<UnblendedCost: struct<Amount: string>>>>")),
        F.lit(0).cast(MONEY),
        lambda s, day: (s + F.coalesce(amount(day["Total"]["UnblendedCost"]["Amount"]), F.lit(0))).cast(MONEY),
    )
    provider = F.col("provider")
    missing = F.when(provider == "gcp", V.MISSING_CREDENTIALS["gcp"]).otherwise(V.MISSING_CREDENTIALS["aws"])
    judged = costs.withColumn(
        "error",
        F.when(malformed(costs), V.MALFORMED_RECORD)
        .when(~F.coalesce(F.col("has_credentials"), F.lit(False)), missing)
        .when(F.col("exception").isNotNull(), F.col("exception")),
    )
    fine, stub = F.col("error").isNull(), provider == "gcp"
    kept = [c for c in costs.columns if c not in ("has_credentials", "exception", "body", "malformed")]
    return judged.select(
        *kept,
        F.when(fine & ~stub, summed).otherwise(F.lit(0).cast(MONEY)).alias("cost"),
        F.when(~fine, "error").when(stub, "stubbed").otherwise("success").alias("status"),
        "error",
    )


def cost_total(days: Column, text_amount: Column, as_of: AsOf, span: int = V.WINDOW_DAYS) -> Column:
    """Aggregate: exact sum of string amounts of the days before ``as_of``, 0 if there are none."""
    inside = F.when(in_date_range(days, as_of, span), amount(text_amount))
    return F.coalesce(F.sum(inside), F.lit(0)).cast(MONEY)


# --- combining -----------------------------------------------------------------------------------


def enabled_only(records: DataFrame, enabled: Sequence[str], source: str = "provider") -> DataFrame:
    """Records of sources that are configured, and lines that could not be parsed, as a source of their own.

    The list is short configuration, so it is a literal filter.
    """
    broken = malformed(records)
    named = records.withColumn(source, F.when(broken, V.UNREADABLE_SOURCE).otherwise(F.col(source)))
    return named.where(broken | F.coalesce(F.col(source).isin(*enabled), F.lit(False)) if enabled else broken)


def unreadable_activity(activity: DataFrame) -> DataFrame:
    """One row (source, error) if any activity line could not be parsed."""
    return unreadable_source(activity.select(malformed(activity).cast("bigint").alias("unreadable")))


def unreadable_source(counted: DataFrame) -> DataFrame:
    """One row (source, error) if ``unreadable`` is above zero anywhere."""
    found = counted.where("unreadable > 0").agg(F.count("*").alias("n")).where("n > 0")
    return found.select(F.lit(V.UNREADABLE_SOURCE).alias("source"), F.lit(V.MALFORMED_RECORD).alias("error"))


def latest_per_source(
    records: DataFrame, source: str = "provider", newest: str = "fetched_at", sources: Sequence[str] | None = None
) -> DataFrame:
    """The newest record of each source, or of each of the named ``sources``; equal times fall back on the values.

    The records are read once. Those of a task are compared map-side, which sorts them by source inside the task; one a source
    and task is shuffled. Records without a readable time count as the oldest, and NULL is a source like any other.
    """
    known = records if sources is None else records.where(F.col(source).isin(*sources))
    timed = known.withColumn("_at", F.coalesce(parse_iso(F.col(newest)), F.lit("0001-01-01").cast("timestamp_ntz")))
    rest = [c for c in records.columns if c not in (source, newest)]
    top = F.max(F.struct("_at", newest, *rest)).alias("_r")
    return timed.groupBy(source).agg(top).select(source, *[f"_r.{c}" for c in (newest, *rest)])


def source_union(usage: DataFrame, costs: DataFrame) -> DataFrame:
    """Usage and cost records as one collection with a ``source`` column; absent fields are NULL."""
    return usage.withColumnRenamed("provider", "source").unionByName(
        costs.withColumnRenamed("provider", "source"), allowMissingColumns=True
    )
