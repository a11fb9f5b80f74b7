"""Arrow plumbing for operators that read one text at a time, and columns over the spans they find."""

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
            T.StructField("base", T.BooleanType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
)


def slices(batch: pa.RecordBatch, column: int, most_bytes: int = 4 * 1024 * 1024) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows whose texts, or lists of numbers, have about ``most_bytes`` together, a row at least."""
    values = batch.column(column)
    lists = pa.types.is_list(values.type)
    sizes = pc.fill_null(pc.list_value_length(values) if lists else pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    sizes = sizes.astype(np.int64) * (4 if lists else 1)
    runs = np.cumsum(sizes, dtype=np.int64) // most_bytes
    borders = [0, *(np.flatnonzero(np.diff(runs)) + 1).tolist(), len(batch)]
    for start, end in zip(borders, borders[1:], strict=False):
        if end > start:
            yield batch.slice(start, end - start)


def map_texts(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    functions: Callable[[], Callable[[str], tuple]],
    fields: Sequence[T.StructField],
    keep_text: bool = False,
) -> DataFrame:
    """Rows (id, [text,] fields) in the order of ``docs``; ``functions()`` gives, once a task, what maps a text to a tuple.

    A null text is passed on as an empty one. The batches stream through: a task holds one batch at a time.
    """
    head = [T.StructField("id", docs.schema[id_col].dataType)] + [T.StructField("text", T.StringType())] * keep_text
    schema = T.StructType(head + list(fields))
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = functions()
        for batch in (part for whole in batches for part in slices(whole, 1)):
            rows = [one(text or "") for text in batch.column(1).to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
            made = [pa.array(c, type=arrow.field(len(head) + i).type) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i).cast(arrow.field(i).type) for i in range(len(head))] + made, schema=arrow
            )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def span_text(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def base_spans(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["base"])


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long")


def digest(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)
