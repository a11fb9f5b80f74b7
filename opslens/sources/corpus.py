"""Readers for documents, log lines, file manifests and artifacts."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.functions.paths import depth
from opslens.functions.text import document_lines
from opslens.session import importable, qualified
from opslens.sources.files import PARTITION_BYTES, FileTree
from opslens import values as V


def _located(spark: SparkSession, root: str, by_project: bool, address: str) -> list[Column]:
    """[project,] path: decoded places below ``root``; with ``by_project`` the first folder is the project."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    folder = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder)
    plain = lambda c: F.regexp_replace(c, "^([A-Za-z0-9]+):/+", "$1:/")
    start = F.length(plain(F.lit(folder.toUri().toString().rstrip("/")))) + 2
    encoded = F.replace(F.substring(plain(F.col(address)), start, F.lit(2**31 - 1)), F.lit("+"), F.lit("%2B"))
    path = F.url_decode(encoded)
    if not by_project:
        return [path.alias("path")]
    slash = F.locate("/", path)
    return [F.when(slash > 0, F.left(path, slash - 1)).alias("project"), F.substring(path, slash + 1, F.lit(2**31 - 1)).alias("path")]


def file_tree(
    spark: SparkSession, root: str, pattern: str = "*", by_project: bool = False, content: bool = True, partition_bytes: int = PARTITION_BYTES
) -> DataFrame:
    """All files at any depth below ``root`` whose names match: ([project,] path, length, modified[, content, error])."""
    importable(spark)
    spark.dataSource.register(FileTree)
    options = {"pattern": pattern, "byProject": by_project, "content": content, "partitionBytes": partition_bytes}
    least = spark.sparkContext.defaultParallelism
    return spark.read.format("file_tree").options(**options, leastPartitions=least).load(qualified(spark, root))


def read_documents(
    spark: SparkSession, root: str, pattern: str = "*" + V.DOCUMENT_SUFFIX, by_project: bool = False
) -> DataFrame:
    """Whole files ([project,] path, content, error) at any depth below ``root``, their paths relative to it.

    Empty files are rows with an empty text. A file that cannot be read, is not UTF-8 or is larger than a text can be
    is a row without content that names the error. With ``by_project`` the first folder is the project.
    """
    return file_tree(spark, root, pattern, by_project).drop("length", "modified")


def read_log_lines(spark: SparkSession, root: str, pattern: str = "*", by_project: bool = False) -> DataFrame:
    """Lines of log files of any size: ([project,] path, block, line_no, line).

    Files stay splittable: ``block`` is the byte offset of the input split and ``line_no`` grows within it, so
    (block, line_no) orders a file and ``block`` is its chunk. Store the result as a table before running ordered
    operators on it, so that the numbers are given once.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return reader.text(root).withColumn("_at", F.col("_metadata.file_path")).select(
        *_located(spark, root, by_project, "_at"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_no"),
        F.col("value").alias("line"),
    )


def read_manifest(spark: SparkSession, root: str, by_project: bool = False) -> DataFrame:
    """File manifest ([project,] path, length, modified) of a folder tree, relative to ``root``, without reading contents."""
    return file_tree(spark, root, by_project=by_project, content=False)


def line_rows(documents: DataFrame, text: str = "content", lines: Column | None = None) -> DataFrame:
    """One row per line with ``line_no`` from 0; the text column itself is dropped."""
    kept = [c for c in documents.columns if c != text]
    lines = document_lines(F.col(text)) if lines is None else lines
    return documents.select(*kept, F.posexplode(lines).alias("line_no", "line"))


def within_depth(manifest: DataFrame, path: str = "path", limit: int = V.MANIFEST_DEPTH) -> DataFrame:
    """Files whose folder lies fewer than ``limit`` levels below the root."""
    return manifest.where(depth(F.col(path)) < limit)


def first_existing(
    manifest: DataFrame, candidates: Sequence[str], key: Sequence[str], path: str = "path", name: str = "location"
) -> DataFrame:
    """For each key the first candidate path that its manifest holds; keys without any keep NULL.

    One aggregate with map-side combine: the candidate list is a literal, so nothing is joined.
    """
    rank = F.array_position(F.array(*[F.lit(c) for c in candidates]), F.col(path))
    best = F.min(F.when(rank > 0, rank))
    picked = F.get(F.array(*[F.lit(c) for c in candidates]), (best - 1).cast("int"))
    return manifest.groupBy(*key).agg(picked.alias(name))
