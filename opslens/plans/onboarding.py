"""Domain documents of projects: stack, recommended tools and profile filled into a template."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens import schemas as S
from opslens import values as V
from opslens.operators import classify as C
from opslens.plans.documents import fill_documents, profile_slots, with_profile


def _as_suggestions(tools: Column) -> Column:
    narrow = F.transform(tools, lambda t: F.struct(*[t[n].alias(n) for n in ("name", "url", "command", "type")]))
    return F.coalesce(narrow, F.array().cast(f"array<{S.SUGGESTION}>"))


def with_new_names(known: Column, more: Column) -> Column:
    """``known`` followed by the entries of ``more`` whose name is not there yet; the first of equal names stays."""
    return F.aggregate(
        more,
        known,
        lambda done, t: F.when(F.exists(done, lambda d: d["name"].eqNullSafe(t["name"])), done).otherwise(
            F.array_append(done, t)
        ),
    )


def recommend_tools(projects: DataFrame, tools: Column, found: Column, stack: str = "stack") -> DataFrame:
    """Add ``skills`` and ``mcps``: the forced tools of each project, then what its profile suggests.

    Both lists are as short as the registry and one reply, so they are built inside the row.
    """
    forced = F.filter(tools, lambda t: C.is_forced(t, F.col(stack)))
    skills = _as_suggestions(F.filter(forced, lambda t: ~C.is_mcp(t["type"])))
    mcps = _as_suggestions(F.filter(forced, lambda t: C.is_mcp(t["type"])))
    return projects.withColumns(
        {
            "skills": with_new_names(skills, _as_suggestions(found["skills"])),
            "mcps": with_new_names(mcps, _as_suggestions(found["mcps"])),
        }
    )


def domain_documents(
    projects: DataFrame,
    tools: Column,
    template: Column,
    reply: str = "reply",
    summary: str = "summary",
    stack: str = "stack",
) -> DataFrame:
    """Add ``document`` to projects that have a stack text, a domain summary and a reply with their profile."""
    profile = F.col("_profile")
    picked = recommend_tools(with_profile(projects, reply, "_profile", S.REPLY), tools, profile, stack)
    skill_lines = F.transform("skills", lambda t: C.skill_line(t["name"], t["url"], t["type"]))
    mcp_lines = F.transform("mcps", lambda t: C.mcp_line(t["name"], t["command"]))
    slots = {
        "TECH_STACK": F.col(stack),
        "DOMAIN_SUMMARY": F.col(summary),
        **profile_slots(profile),
        "SKILLS_MD": C.checklist_text(skill_lines, V.NO_SKILLS_LINE),
        "MCPS_MD": C.checklist_text(mcp_lines, V.NO_MCPS_LINE),
    }
    return fill_documents(picked, template, slots).drop("skills", "mcps", "_profile")
