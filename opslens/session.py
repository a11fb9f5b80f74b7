"""Session settings and the shared folder for intermediate tables."""

import os
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 * 1024 * 1024

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app: str = "opslens", **settings: str) -> SparkSession:
    """A session with the library's defaults; ``settings`` use ``__`` for dots and win over defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    chosen = {**DEFAULTS, **{k.replace("__", "."): v for k, v in settings.items()}}
    for key, value in chosen.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver has it.

    On a cluster the package is shipped with the job (``--py-files``), and this adds a path that nobody needs.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    given = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in given:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, given)])


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme of its file system, as Python workers need it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()


def shared_folder(spark: SparkSession) -> str:
    """This application's folder for intermediate tables, removed when the application ends normally.

    It lies under ``spark.checkpoint.dir``, which every executor can reach; where that is unset, under the warehouse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    folder = f"{base.rstrip('/')}/opslens-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path)
    system.deleteOnExit(path)
    return folder


_SCOPES: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove the intermediate tables that are made inside, once the results that read them are stored."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for name in _SCOPES.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str, result: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage for iterative jobs: the table outlives any executor and is computed a single time. A ``result`` of a
    :func:`scratch` block stays when the block ends; it belongs to the block around it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}/{name}"
    scopes = _SCOPES[:-1] if result else _SCOPES
    if scopes:
        scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(
    df: DataFrame, name: str, limit: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> tuple[DataFrame, bool]:
    """``df`` as a stored table, marked for broadcast if it is small, and whether it is marked.

    Small means at most ``limit`` rows and ``max_bytes`` of all columns, nested ones included, as measured on the stored
    table by the length of its rows as JSON. A larger table comes back unmarked and is joined by a shuffle.
    """
    table = materialize(df, name)
    rows, size = table.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()
    small = rows <= limit and size <= max_bytes
    return (F.broadcast(table) if small else table), small


def meet(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal columns, where NULL equals NULL; the columns ``on`` come from ``left``.

    The columns are compared as one struct, which is never NULL itself: an ordinary equality join.
    """
    named = right.select(F.struct(*on).alias("_on"), *[c for c in right.columns if c not in on])
    return left.withColumn("_on", F.struct(*on)).join(named, "_on", how).drop("_on")
