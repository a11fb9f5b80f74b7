"""Readers for landed API payloads, project configuration and tool registries."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens import schemas as S
from opslens import values as V


def _landed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a landing folder, a JSON line each; the text of a line that is no such record stays in ``malformed``.

    A partition folder's value wins over the field of the same name. Each line is parsed once, whatever is asked of its fields
    afterwards: filters on them would move below a plain projection and take the parser with them, but not below ``inline``.
    """
    lines = spark.read.text(path)
    folders = [c for c in lines.columns if c != "value"]
    parsed = F.from_json("value", f"{schema}, malformed string", {"columnNameOfCorruptRecord": "malformed"})
    told = [F.col(c).alias(f"_folder_{k}") for k, c in enumerate(folders)]
    rows = lines.where(F.trim("value") != "").select(*told, F.inline(F.array(parsed)))
    names = rows.columns[len(folders) :]
    value = {c: F.col(f"_folder_{k}") for k, c in enumerate(folders)}
    given = [value[c].cast("string").alias(c) if c in folders else F.col(c) for c in names]
    return rows.select(*given, *[value[c].alias(c) for c in folders if c not in names])


def read_activity(spark: SparkSession, path: str) -> DataFrame:
    """Landed repository activity, one payload per record."""
    return _landed(spark, path, S.ACTIVITY)


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """Landed usage payloads; ``provider`` may be a partition folder (``provider=x/``)."""
    return _landed(spark, path, S.USAGE)


def read_costs(spark: SparkSession, path: str) -> DataFrame:
    """Landed daily cost series."""
    return _landed(spark, path, S.COST)


def project_rows(configs: DataFrame, config: str = "config", fallback: dict[str, str | None] | None = None) -> DataFrame:
    """Rows (project, settings) from JSON text ``{project: {setting: value}}``.

    Malformed text gives no rows. NULL or empty text means "not configured" and gives one project made of
    ``fallback`` (``id``, ``repo``, ``slack_channel_id``, ``teams_url``).
    """
    fallback = fallback or {}
    default = F.create_map(
        F.lit(fallback.get("id") or V.DEFAULT_PROJECT_ID),
        F.create_map(
            *[
                part
                for name in ("slack_channel_id", "teams_url", "repo")
                for part in (F.lit(name), F.lit(fallback.get(name)).cast("string"))
            ]
        ),
    )
    absent = F.coalesce(F.col(config), F.lit("")) == ""
    parsed = F.from_json(F.col(config), S.PROJECT_CONFIG, {"allowSingleQuotes": "false"})
    kept = [c for c in configs.columns if c != config]
    return configs.select(*kept, F.explode(F.when(absent, default).otherwise(parsed)).alias("project", "settings"))


def projects(configs: DataFrame, config: str = "config", fallback: dict[str, str | None] | None = None) -> DataFrame:
    """Projects table: project, repo, slack_channel_id, teams_url and whether a repo entry was given at all."""
    rows = project_rows(configs, config, fallback)
    kept = [c for c in rows.columns if c != "settings"]
    setting = lambda name: F.element_at("settings", name).alias(name)
    return rows.select(
        *kept,
        F.coalesce(F.map_contains_key("settings", "repo"), F.lit(False)).alias("has_repo"),
        setting("repo"),
        setting("slack_channel_id"),
        setting("teams_url"),
    )


def registry_tools(registry: Column) -> Column:
    """Registry JSON text as one flat array of tools, each with its category; bad text gives an empty array."""
    parsed = F.from_json(registry, S.REGISTRY)
    flat = F.flatten(
        F.transform(
            F.map_entries(parsed["categories"]),
            lambda entry: F.transform(
                entry["value"],
                lambda t: F.struct(
                    entry["key"].alias("category"),
                    *[t[n].alias(n) for n in ("name", "url", "command", "type", "keywords", "force_if_keywords")],
                ),
            ),
        )
    )
    return F.coalesce(flat, F.array().cast(f"array<{S.FLAT_TOOL}>"))


def tool_rows(registries: DataFrame, registry: str = "registry") -> DataFrame:
    """One row per tool of each registry text."""
    kept = [c for c in registries.columns if c != registry]
    return registries.select(*kept, F.explode(registry_tools(F.col(registry))).alias("tool")).select(*kept, "tool.*")
