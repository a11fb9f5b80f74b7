"""Vectors as scaled integers, packed into bytes: one byte for the width of a number, then the numbers."""

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 2.0**62


def packed(values: np.ndarray) -> bytes:
    """Integers in the smallest width that holds them; equal vectors have equal bytes."""
    top = int(np.abs(values).max()) if len(values) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w - 1))
    return bytes([width]) + values.astype(f"<i{width}").tobytes()


def unpacked(rows: Sequence[bytes], dims: int) -> np.ndarray:
    """The vectors as a matrix of ``dims`` columns; shorter ones end in zeros."""
    matrix = np.zeros((len(rows), dims), np.int64)
    for i, row in enumerate(rows):
        values = np.frombuffer(row, f"<i{row[0]}", offset=1)
        matrix[i, : len(values)] = values
    return matrix


def integer_rows(table: DataFrame, vector_col: str, scale: float, *keep: str) -> DataFrame:
    """The columns ``keep`` and ``x``, the packed floor(scale * entry) of each vector, with entries as doubles.

    Rows whose vector is null or holds null, non-finite or 64-bit-exceeding entries are left out. An empty vector stays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(len(keep))
            entries = pc.fill_null(vectors.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore", invalid="ignore"):
                scaled = np.floor(entries * scale)
                good = np.abs(scaled) < MOST
            ends = np.cumsum(pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            starts = np.r_[0, ends[:-1]].astype(np.int64)
            bad = np.r_[0, np.cumsum(~good)]
            rows = np.flatnonzero((bad[ends] == bad[starts]) & pc.is_valid(vectors).to_numpy(zero_copy_only=False))
            numbers = np.where(good, scaled, 0).astype(np.int64)
            made = pa.array([packed(numbers[starts[i] : ends[i]]) for i in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(rows)) for i in range(len(keep))] + [made], names=[*keep, "x"])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in table.select(*keep).schema]
    vector = F.col(vector_col).cast("array<double>")
    return table.select(*keep, vector.alias("__vector")).mapInArrow(run, ", ".join([*kept, "x binary"]))


def most_dims(rows: DataFrame) -> Column:
    """The greatest number of entries of the packed vectors ``x``."""
    width = F.conv(F.hex(F.substring("x", 1, 1)), 16, 10).cast("int")
    return F.coalesce(F.max(((F.octet_length("x") - 1) / width).cast("int")), F.lit(0))
