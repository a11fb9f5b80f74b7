"""Functions that read structure out of Markdown text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from opslens import values as V
from opslens.functions.text import SPACE_CLASS, strip

# Row, owner and section formats.
CHECKED_ROW = rf"^- \[[xX]\]{SPACE_CLASS}+([^\(]+?){SPACE_CLASS}*\((.*?)\)(?:{SPACE_CLASS}*<!--{SPACE_CLASS}*type:(.*?){SPACE_CLASS}*-->)?"
OWNER = r"(?id)Proposed Agent Name:.*?\s*`?@([a-zA-Z0-9_-]+)`?"
INVARIANT_HEADINGS = ["Domain Invariants", "Aggregates & Invariants"]
GLOSSARY_HEADING = "Ubiquitous Language"


def section(text: Column, heading: str) -> Column:
    """From ``heading`` up to the next ``##`` or the end; empty if the heading is absent."""
    return F.regexp_extract(text, rf"(?sd)\Q{heading}\E\n.*?(?=##|$)", 0)


def checked_rows(block: Column) -> Column:
    """Ticked rows of a checklist as ``array<struct<name,target,type>>`` in row order."""
    ticked = lambda line: F.startswith(F.lower(line), F.lit("- [x]")) & line.rlike(CHECKED_ROW)
    rows = F.filter(F.transform(F.split(block, "\n"), strip), ticked)
    kind = lambda line: strip(F.regexp_extract(line, CHECKED_ROW, 3))
    return F.transform(
        rows,
        lambda line: F.struct(
            strip(F.regexp_extract(line, CHECKED_ROW, 1)).alias("name"),
            strip(F.regexp_extract(line, CHECKED_ROW, 2)).alias("target"),
            F.when(F.regexp_extract(line, CHECKED_ROW, 3) == "", F.lit("skill")).otherwise(kind(line)).alias("type"),
        ),
    )


def owner_name(text: Column) -> Column:
    return F.coalesce(F.lower(F.nullif(F.regexp_extract(text, OWNER, 1), F.lit(""))), F.lit(V.DEFAULT_OWNER))


def _cleaned(raw: Column) -> Column:
    bare = F.regexp_replace(strip(raw), r"(?d)\(.*?\)", "")
    return strip(F.replace(F.replace(bare, F.lit("**:**"), F.lit("")), F.lit(":"), F.lit("")))


def _section_body(text: Column, headings: list[str], stops: list[str]) -> Column:
    names = "|".join(rf"\Q{h}\E" for h in headings)
    ends = "|".join(rf"\Q{s}\E" for s in stops)
    pattern = rf"(?isd)(?:{names}).*?\n(.*?)(?={ends}|$)"
    return F.when(text.rlike(pattern), _cleaned(F.regexp_extract(text, pattern, 1))).otherwise(F.lit(V.NO_SECTION_TEXT))


def invariants(text: Column, legacy: bool = False) -> Column:
    """Rules section, cleaned. ``legacy`` accepts only the older heading."""
    headings = INVARIANT_HEADINGS[:1] if legacy else INVARIANT_HEADINGS
    return _section_body(text, headings, [GLOSSARY_HEADING, V.SKILLS_HEADING, V.MCPS_HEADING])


def glossary(text: Column) -> Column:
    return _section_body(text, [GLOSSARY_HEADING], [V.SKILLS_HEADING, V.MCPS_HEADING])
