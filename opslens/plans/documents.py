"""Jobs over Markdown documents and templates."""

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens import schemas as S
from opslens import values as V
from opslens.functions import jsontext, markdown
from opslens.functions.paths import basename, has_suffix, is_ignored
from opslens.functions.text import (
    bold_list,
    fill_template,
    has_placeholder,
    numbered_list,
    platform_rules,
    replace_in_order,
    term_list,
)
from opslens.operators.closure import expand_includes


def parse_checklists(documents: DataFrame, doc: str = "doc", text: str = "content") -> DataFrame:
    """Ticked rows of both checklists: (doc, kind, pos, name, target, type), ``pos`` from 1 within doc and kind."""

    def rows(kind: str, heading: str, type_of: Callable[[Column], Column]) -> Column:
        return F.transform(
            markdown.checked_rows(markdown.section(F.col(text), heading)),
            lambda r, i: F.struct(
                F.lit(kind).alias("kind"),
                (i + 1).alias("pos"),
                r["name"].alias("name"),
                r["target"].alias("target"),
                type_of(r).alias("type"),
            ),
        )

    skills = rows("skill", V.SKILLS_HEADING, lambda r: r["type"])
    mcps = rows("mcp", V.MCPS_HEADING, lambda r: F.lit("mcp"))
    return documents.select(doc, F.explode(F.concat(skills, mcps)).alias("_r")).select(doc, "_r.*")


def extract_domain_sections(
    documents: DataFrame, doc: str = "doc", text: str = "content", legacy: bool = False
) -> DataFrame:
    """(doc, owner, invariants, glossary, incomplete)"""
    content = F.col(text)
    return documents.select(
        doc,
        markdown.owner_name(content).alias("owner"),
        markdown.invariants(content, legacy).alias("invariants"),
        markdown.glossary(content).alias("glossary"),
        has_placeholder(content).alias("incomplete"),
    )


def render_templates(
    files: DataFrame, platform: str, folder: str, path: str = "path", text: str = "content"
) -> DataFrame:
    """Template files with placeholders and tool names replaced for one platform; other files pass unchanged.

    Files on the ignore list are left out.
    """
    rendered = replace_in_order(F.col(text), platform_rules(platform, folder))
    return files.where(~is_ignored(F.col(path))).withColumn(
        text, F.when(has_suffix(F.col(path)), rendered).otherwise(F.col(text))
    )


def inline_templates(
    files: DataFrame, platform: str, folder: str, path: str = "path", text: str = "content"
) -> DataFrame:
    """Lines (root, position, line) of the template files after rendering, with their includes inlined.

    Any file can be included. Only the text of templates has its folder mentions replaced; other included text gets the
    folder slot and the tool names.
    """
    kept = files.where(~is_ignored(F.col(path)))
    rules = platform_rules(platform, folder)
    included = [rule for rule in rules if rule[0] != V.FOLDER_MENTION]
    whole, part = (replace_in_order(F.col(text), r) for r in (rules, included))
    rendered = kept.select(F.col(path).alias("path"), F.when(has_suffix(F.col(path)), whole).otherwise(part).alias("content"))
    return expand_includes(rendered, roots=has_suffix(F.col("path")))


def inject_routing(files: DataFrame, agents: Column, path: str = "path", text: str = "content") -> DataFrame:
    """Name the given agents in front of the negative rules of each dispatch-rules file."""
    marker = V.ROUTING_MARKER
    mentions = F.array_join(F.transform(agents, lambda a: F.concat(F.lit("`@"), a, F.lit("`"))), ", ")
    note = F.format_string(V.ROUTING_FORMAT, mentions)
    wanted = (basename(F.col(path)) == V.ROUTING_FILE) & (F.size(agents) > 0)
    filled = F.replace(F.col(text), F.lit(marker), F.concat(note, F.lit(marker)))
    return files.withColumn(text, F.when(wanted, filled).otherwise(F.col(text)))


def with_profile(rows: DataFrame, reply: str = "reply", name: str = "profile", schema: str = S.PROFILE) -> DataFrame:
    """Add ``name``: the profile found as JSON in the free text of ``reply``, NULL if there is none."""
    return rows.withColumn(name, jsontext.recover_json(F.col(reply), schema))


def profile_slots(found: Column) -> dict[str, Column]:
    """Template slots of a domain profile; gaps get placeholders."""
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    named = F.when(found["sme_name"] != "", found["sme_name"])
    return {
        "SME_NAME": F.lower(F.coalesce(named, F.lit(V.DEFAULT_OWNER))),
        "CORE_DOMAIN_VALUE": F.coalesce(found["core_domain_value"], F.lit(V.PLACEHOLDER_LEFT)),
        "INVARIANTS": F.when(some(found["invariants"]), numbered_list(found["invariants"])).otherwise(V.DEFAULT_INVARIANTS),
        "GLOSSARY": F.when(some(found["glossary"]), term_list(found["glossary"])).otherwise(V.DEFAULT_GLOSSARY),
        "DOMAIN_EVENTS": F.when(some(found["domain_events"]), bold_list(found["domain_events"])).otherwise(V.DEFAULT_EVENTS),
    }


def fill_documents(rows: DataFrame, template: Column, slots: Mapping[str, Column], name: str = "document") -> DataFrame:
    """Add ``name``: the template with the slots of each row filled in, in the fixed slot order."""
    ordered = {slot: slots[slot] for slot in V.TEMPLATE_SLOTS if slot in slots}
    return rows.withColumn(name, fill_template(template, ordered))


def merged_maps(old: Column, new: Column) -> Column:
    """Both maps as one; for a key in both the value of ``new`` wins."""
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))
    return F.map_concat(kept, new)
