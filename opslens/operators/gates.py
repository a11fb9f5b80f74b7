"""Completeness checks of the artifacts of a workspace."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens import values as V
from opslens.functions.text import contains_any, matches_failure

PHASES = (1, 3, 4, 5)


def has_diagnosis(content: Column) -> Column:
    return F.contains(content, F.lit(V.ROOT_CAUSE_TEXT)) | F.contains(F.lower(content), F.lit(V.REPRODUCIBLE_TEXT))


def has_criteria(content: Column) -> Column:
    return contains_any(content, V.PLAN_HEADINGS)


def _exists(path: str) -> Column:
    return F.coalesce(F.bool_or(F.col("_path") == path), F.lit(False))


def _holds(path: str, test: Column) -> Column:
    return F.coalesce(F.bool_or((F.col("_path") == path) & test), F.lit(False))


def chosen_plan() -> Column:
    """Aggregate: path of the plan that counts, the preferred candidate first; NULL if there is none."""
    picked = F.lit(None).cast("string")
    for candidate in reversed(V.PLAN_CANDIDATES):
        picked = F.when(_exists(candidate), candidate).otherwise(picked)
    return picked


def _violations(phase: int) -> list[Column]:
    content = F.col("_content")
    plan = chosen_plan()
    if phase == 1:
        there = _exists(V.DIAGNOSIS_REPORT)
        return [
            F.when(~there, V.NO_DIAGNOSIS % V.DIAGNOSIS_REPORT),
            F.when(there & ~_holds(V.DIAGNOSIS_REPORT, has_diagnosis(content)), V.WEAK_DIAGNOSIS % V.DIAGNOSIS_REPORT),
        ]
    if phase == 3:
        first, second = V.PLAN_CANDIDATES
        strict = F.when(plan == first, _holds(first, has_criteria(content))).otherwise(_holds(second, has_criteria(content)))
        return [
            F.when(plan.isNull(), V.NO_PLAN),
            F.when(plan.isNotNull() & ~strict, F.format_string(V.WEAK_PLAN, plan)),
        ]
    if phase == 4:
        log = _exists(V.FAILING_TEST_LOG)
        return [
            F.when(plan.isNull(), V.NO_PLAN_TO_EXECUTE % V.PLAN_CANDIDATES[-1]),
            F.when(~log, V.NO_FAILING_TEST % V.FAILING_TEST_LOG),
            F.when(log & ~_holds(V.FAILING_TEST_LOG, matches_failure(content)), V.NO_FAILURE_IN_LOG % V.FAILING_TEST_LOG),
        ]
    if phase == 5:
        return [F.when(~_exists(p), V.NO_REPORT % p) for p in (V.REVIEW_REPORT, V.QA_REPORT)]
    raise ValueError(f"phase must be one of {PHASES}")


def artifact_gates(
    artifacts: DataFrame,
    phases: Sequence[int] = PHASES,
    workspace: Sequence[str] = ("workspace",),
    path: str = "path",
    content: str = "content",
) -> DataFrame:
    """(workspace, phase, passed, violations) for every phase, from one aggregate over the artifacts.

    Contents are tested in the scan, before the shuffle: only one row of flags per workspace and task travels, never
    the text.
    """
    rows = artifacts.select(*workspace, F.col(path).alias("_path"), F.col(content).alias("_content"))
    found = rows.groupBy(*workspace).agg(*[F.array_compact(F.array(*_violations(p))).alias(f"_{p}") for p in phases])
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("phase"), F.col(f"_{p}").alias("violations")) for p in phases]))
    return found.select(*workspace, each.alias("_g")).select(
        *workspace, "_g.phase", (F.size("_g.violations") == 0).alias("passed"), "_g.violations"
    )


def artifact_gate(
    artifacts: DataFrame,
    phase: int,
    workspace: Sequence[str] = ("workspace",),
    path: str = "path",
    content: str = "content",
) -> DataFrame:
    """(workspace, passed, violations) for one phase."""
    return artifact_gates(artifacts, [phase], workspace, path, content).drop("phase")


def preferred_artifact(
    artifacts: DataFrame, candidates: Sequence[str], workspace: Sequence[str] = ("workspace",), path: str = "path"
) -> DataFrame:
    """The first candidate each workspace has, with its content: (workspace, path, content)."""
    rank = F.array_position(F.array(*[F.lit(c) for c in candidates]), F.col(path))
    ranked = artifacts.withColumn("_rank", rank).where(F.col("_rank") > 0)
    best = ranked.groupBy(*workspace).agg(F.min("_rank").alias("_rank"))
    return ranked.join(best, [*workspace, "_rank"]).select(*workspace, path, "content")
