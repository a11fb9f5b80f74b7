"""Merging skeleton records with enrichment, and run metadata."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.functions.money import MONEY


def merge_enrichment(
    skeleton: DataFrame, enrichment: DataFrame, on: Sequence[str] = ("id",), on_missing: str = "drop"
) -> DataFrame:
    """Skeleton rows with their enrichment and a ``source_kind``; unmatched enrichment is dropped.

    ``on_missing='drop'`` keeps matched rows only (see :func:`missing_ids` for the rest);
    ``on_missing='fallback'`` keeps the others as ``ast_fallback``.
    """
    marked = enrichment.withColumn("_matched", F.lit(True))
    joined = skeleton.join(marked, list(on), "inner" if on_missing == "drop" else "left")
    kind = F.when(F.col("_matched"), "merged").otherwise("ast_fallback")
    return joined.withColumn("source_kind", kind).drop("_matched")


def missing_ids(skeleton: DataFrame, enrichment: DataFrame, on: Sequence[str] = ("id",)) -> DataFrame:
    """Ids of skeleton rows that have no enrichment."""
    return skeleton.join(enrichment, list(on), "left_anti").select(*on)


def run_metadata(records: DataFrame, key: Sequence[str], tokens: Column, cost: Column, model: Column) -> DataFrame:
    """Total tokens, total cost and the distinct model names of each run.

    Model names are first reduced to one row per run and name, so no set is built from raw rows; the list of a run is as
    long as it has different models, so ``model`` must be a column of few values.
    """
    per_model = records.groupBy(*key, model.alias("_model")).agg(
        F.sum(tokens).alias("_tokens"), F.sum(cost.cast(MONEY)).alias("_cost")
    )
    return per_model.groupBy(*key).agg(
        F.sum("_tokens").alias("total_tokens"),
        F.sum("_cost").alias("total_cost"),
        F.array_join(F.array_sort(F.collect_set("_model")), ", ").alias("models_used"),
    )


def model_counts(records: DataFrame, key: Sequence[str], model: Column, log_size: int = 12) -> DataFrame:
    """How many distinct models each key has: ``models`` exactly, and ``sketch``, mergeable, with its estimate and error bound.

    The exact count first reduces to one row per key and model, so no set is built; NULL models do not count. The sketch is an
    HLL of ``2 ** log_size`` registers: :func:`merged_counts` adds up those of days or sources without going back to the records.
    """
    pairs = records.select(*key, model.alias("_model")).groupBy(*key, "_model").agg(F.lit(1).alias("_one"))
    counted = pairs.groupBy(*key).agg(F.count("_model").alias("models"), F.hll_sketch_agg("_model", log_size).alias("sketch"))
    return _with_bounds(counted, log_size)


def merged_counts(counts: DataFrame, key: Sequence[str], log_size: int = 12) -> DataFrame:
    """Sketches of several parts as one for each key: (key, sketch, estimate, least, most)."""
    return _with_bounds(counts.groupBy(*key).agg(F.hll_union_agg("sketch").alias("sketch")), log_size)


def _with_bounds(counted: DataFrame, log_size: int) -> DataFrame:
    """``least`` and ``most`` are three standard errors (1.04 / sqrt(registers), of merged sketches) around the estimate."""
    error = 3 * 1.04 / 2 ** (log_size / 2)
    estimate = F.hll_sketch_estimate("sketch")
    return counted.withColumn("estimate", estimate).withColumns(
        {"least": F.floor(F.col("estimate") * (1 - error)), "most": F.ceil(F.col("estimate") * (1 + error))}
    )
