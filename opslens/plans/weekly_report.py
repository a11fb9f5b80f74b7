"""The weekly report: activity, usage and cost records to one report per project."""

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame

from opslens import values as V
from opslens.operators import metrics as M
from opslens.operators import report as R
from opslens.session import materialize

ALL_SOURCES = ("github", *V.AI_PROVIDERS, *V.CLOUD_PROVIDERS)


def weekly_report(
    projects: DataFrame,
    activity: DataFrame,
    usage: DataFrame,
    costs: DataFrame,
    as_of: str | datetime,
    days: int = V.WINDOW_DAYS,
    enabled: Sequence[str] = ALL_SOURCES,
) -> DataFrame:
    """Reports (project, stats, warnings, slack_channel_id, teams_url) for the window that ends at ``as_of``.

    Activity is read and shuffled once, as partial sums per repo and error, which are stored: the projects and the count of
    unreadable lines both come from them. Each global source is reduced to its newest record and reaches the projects as one
    scalar row.
    """
    newest_usage = M.usage_records(M.latest_per_source(M.enabled_only(usage, enabled)))
    newest_costs = M.cost_records(M.latest_per_source(M.enabled_only(costs, enabled)))
    pages = materialize(M.counted_pages(activity, as_of, days), "pages")
    sources = M.source_union(newest_usage, newest_costs).unionByName(M.unreadable_source(pages), allowMissingColumns=True)
    one_row = R.source_structs(sources)
    metrics = M.first_errors(pages).hint("merge")  # one row a repo: no size for a broadcast, however small its files are
    return R.reports(projects, metrics, one_row, "github" in enabled)


def message_outbox(report: DataFrame) -> DataFrame:
    """Payloads of a report run, one row per project and destination."""
    return R.routed(report)
