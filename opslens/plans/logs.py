"""Error traces and pruned logs, from whole texts or from tables of lines."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens import values as V
from opslens.functions import text as T
from opslens.operators import ordered as O


def extract_first_error(
    lines: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    line: str = "line",
    keep: int = V.TRACE_ROWS,
    tail: int = V.TAIL_ROWS,
) -> DataFrame:
    """Lines around the first error of each log. Use this form for logs too large for one row."""
    clean = T.rstrip(F.col(line))
    rows = lines.withColumn(line, clean)
    return O.first_error_rows(
        rows, key, order, chunk, T.matches_trace(F.col(line)), T.matches_call_site(F.col(line)), keep, tail
    )


def extract_first_error_text(logs: DataFrame, text: str = "content", name: str = "trace") -> DataFrame:
    """Add ``name``: the lines around the first error of each whole-text log, joined by line feeds."""
    return logs.withColumn(name, F.array_join(T.first_error_lines(T.file_lines(F.col(text))), "\n"))


def prune_log_lines(
    lines: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    line: str = "line",
    error: Column | None = None,
    vendor: Column | None = None,
) -> DataFrame:
    """Lines without the vendor lines that follow an error line of their log."""
    error = T.matches_error(F.col(line)) if error is None else error
    vendor = T.matches_vendor(F.col(line)) if vendor is None else vendor
    return O.prune_rows(lines, key, order, chunk, error, vendor)


def prune_log_text(logs: DataFrame, text: str = "content", name: str = "pruned") -> DataFrame:
    """Add ``name``: each whole-text log without the vendor lines that follow an error line."""
    return logs.withColumn(name, F.array_join(T.prune_lines(T.document_lines(F.col(text))), "\n"))
