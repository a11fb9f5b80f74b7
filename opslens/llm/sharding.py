"""Shards as runs of a Hilbert curve over several metadata dimensions.

Every dimension is quantised into ``2 ** BITS`` steps at approximate quantiles of all rows; a row's steps give its place on
the curve. Rows are ordered by that place, then by a hash of the text and the id, and the order is cut into runs of equal
length, so the shards' row counts differ by at most one, each shard covers a compact box of every dimension, and readers
can skip shards by the least and greatest values in the manifest. Equal texts with equal metadata stand side by side.

The order is global but never in one task: rows are range-partitioned on the whole sort key (a full cell of the curve is
split by hash and id, repeated rows by a row number), each partition numbers its own rows, and the partitions' offsets come
from their counts. The numbered rows are written to the shared folder, so numbers do not change when an executor is lost.
"""

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opslens.session import materialize

BITS = 5
SHARDS = 24
DIMENSIONS = ("source", "lang", "n_chars")
LOW = (1 << 33) - 1  # row numbers inside a partition, as monotonically_increasing_id makes them


def hilbert_index(steps: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of points given as rows of ``steps`` (points x dimensions, each under 2 ** bits)."""
    axes = [steps[:, d].astype(np.int64) for d in range(steps.shape[1])]
    # From axes to the transposed index, one bit plane after the other, then the Gray code of all planes.
    for bit in range(bits - 1, 0, -1):
        below = (1 << bit) - 1
        for d in range(len(axes)):
            high = (axes[d] >> bit) & 1 == 1
            swap = np.where(high, 0, (axes[0] ^ axes[d]) & below)
            axes[0] = np.where(high, axes[0] ^ below, axes[0] ^ swap)
            axes[d] = axes[d] ^ swap
    for d in range(1, len(axes)):
        axes[d] = axes[d] ^ axes[d - 1]
    turn = np.zeros_like(axes[0])
    for bit in range(bits - 1, 0, -1):
        turn = np.where((axes[-1] >> bit) & 1 == 1, turn ^ ((1 << bit) - 1), turn)
    index = np.zeros_like(axes[0])
    for bit in range(bits - 1, -1, -1):
        for axis in axes:
            index = (index << 1) | (((axis ^ turn) >> bit) & 1)
    return index


def as_number(docs: DataFrame, name: str) -> Column:
    """A dimension as a number in the order of its values: strings by their first seven bytes."""
    kind = docs.schema[name].dataType
    if isinstance(kind, T.NumericType):
        return F.col(name).cast("double")
    if isinstance(kind, (T.DateType, T.TimestampType)):
        return F.unix_micros(F.col(name).cast("timestamp")).cast("double")
    start = F.substring(F.encode(F.col(name).cast("string"), "UTF-8"), 1, 7)
    return F.conv(F.rpad(F.hex(start), 14, "0"), 16, 10).cast("double")


def quantile_cuts(docs: DataFrame, dimensions: Sequence[str], bits: int = BITS) -> list[list[float]]:
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    found = docs.select(
        *[F.percentile_approx(as_number(docs, name), shares).alias(f"d{i}") for i, name in enumerate(dimensions)]
    ).first()
    return [list(cuts or []) for cuts in found]


def curve_place(docs: DataFrame, dimensions: Sequence[str], bits: int = BITS) -> Column:
    cuts = [np.array(c) for c in quantile_cuts(docs, dimensions, bits)]

    @F.pandas_udf("long")
    def place(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for values in batches:
            steps = [np.searchsorted(c, v.to_numpy(float, na_value=-np.inf), "right") for c, v in zip(cuts, values, strict=True)]
            yield pd.Series(hilbert_index(np.stack(steps, 1), bits))

    return place(*[as_number(docs, name) for name in dimensions])


def numbered(rows: DataFrame, order: Sequence[str], name: str) -> tuple[DataFrame, int]:
    """``rows`` with their ``rank`` from 0 in the order of the columns ``order``, and how many there are."""
    placed = materialize(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("rank", F.monotonically_increasing_id()), name
    )
    part = F.shiftright("rank", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row for each partition
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("part", F.coalesce(before, F.lit(0)).alias("offset"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    joined = placed.withColumn("part", part).join(F.broadcast(offsets), "part")
    return joined.withColumn("rank", F.col("offset") + F.col("rank").bitwiseAND(LOW)).drop("part", "offset"), total


def assign_shards(
    docs: DataFrame,
    shards: int = SHARDS,
    dimensions: Sequence[str] = DIMENSIONS,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: bool = False,
) -> DataFrame:
    """Rows (id, size, text_crc32, shard, slot), one for each row of ``docs``; with ``carry`` also the whole row, as ``row``.

    ``size`` is the UTF-8 length of the text plus 8; a null text is measured as an empty one. ``slot`` counts from 0 in each
    shard, without gaps. Null metadata go to the first step of their dimension. Repeated rows get places of their own; an
    empty table gives no rows.
    """
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    keys = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("crc"),
        curve_place(docs, dimensions).alias("place"),
        F.xxhash64(text).alias("hash"),
        F.monotonically_increasing_id().alias("number"),
        *([F.struct("*").alias("row")] if carry else []),
    )
    keys = materialize(keys, "shard_keys")
    ranked, total = numbered(keys, ["place", "hash", "id", "number"], "shard_ranks")
    shard = F.expr(f"rank * {shards} div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {shards} - 1) div {shards}")
    return (
        ranked.withColumn("shard", shard)
        .withColumn("slot", F.col("rank") - first)
        .select(
            F.col("id").alias(id_col),
            "size",
            F.col("crc").alias("text_crc32"),
            F.col("shard").cast("int").alias("shard"),
            "slot",
            *(["row"] if carry else []),
        )
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, dimensions: Sequence[str] = DIMENSIONS, **columns: str) -> DataFrame:
    """Write the rows of ``docs`` under ``path``, a folder ``shard=N`` for each shard in the order of slots; returns the manifest.

    The manifest has a row for each shard that has rows: rows, bytes, and the least and greatest value of every dimension,
    nulls aside. Long texts count with all their bytes; rows that repeat have slots of their own; an empty table gives an empty
    manifest. Every column in ``dimensions`` has to be there.
    """
    assigned = assign_shards(docs, shards, dimensions, carry=True, **columns)
    assigned.select("shard", "slot", "size", "row").write.partitionBy("shard").parquet(path)
    ends = [end(F.col(f"row.{d}")).alias(f"{d}_{end.__name__}") for d in dimensions for end in (F.min, F.max)]
    written = docs.sparkSession.read.parquet(path)
    return written.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *ends)
