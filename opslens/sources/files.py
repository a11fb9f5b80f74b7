"""A folder tree as a data source: its own listing, partitions of like size, every file read once.

Unlike Spark's file sources it lists empty files and hidden ones, and a file that cannot be read or decoded is a row that says so.
It runs in Python workers, on any store that pyarrow can open (``file``, ``hdfs``, ``s3``, ``gs``, ``abfs``). The tree is listed
while the query is planned: a partition carries the names and sizes of its files, nothing else.
"""

import fnmatch
import heapq
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from opslens import values as V

PARTITION_BYTES = 64 * 1024 * 1024
FILE_COST = 256 * 1024  # opening a file counts as so many bytes
BATCH_BYTES = 8 * 1024 * 1024
MOST_BYTES = 2**31 - 1


def opened(address: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address or path, and the path in it without a trailing slash."""
    if re.match("^file:/(?!/)", address):
        address = address.removeprefix("file:")
    if not re.match("^[A-Za-z0-9.+-]+://", address):
        return fs.LocalFileSystem(), address.rstrip("/") or "/"
    system, path = fs.FileSystem.from_uri(address)
    return system, path.rstrip("/") or "/"


@dataclass(frozen=True)
class Listed:
    path: str
    size: int
    modified: datetime


@dataclass
class Share(InputPartition):
    files: list[Listed]


def shares(files: Sequence[Listed], partition_bytes: int, least: int) -> list[Share]:
    """The files in shares of like size: the largest first, each to the share that has least so far."""
    cost = lambda f: f.size + FILE_COST
    wanted = max(-(-sum(map(cost, files)) // partition_bytes), least)
    heap = [(0, i, []) for i in range(max(1, min(wanted, len(files))))]
    for file in sorted(files, key=cost, reverse=True):
        load, i, held = heap[0]
        held.append(file)
        heapq.heapreplace(heap, (load + cost(file), i, held))
    return [Share(held) for _, _, held in sorted(heap, key=lambda x: x[1])]


class FileTree(DataSource):
    """Options: ``path``, ``pattern`` of file names, ``byProject``, ``content``, ``partitionBytes``, ``leastPartitions``."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        project = "project string, " if self.options.get("byProject") == "true" else ""
        body = ", content string, error string" if self.options.get("content", "true") == "true" else ""
        return f"{project}path string, length bigint, modified timestamp{body}"

    def reader(self, schema: object) -> "FileTreeReader":
        return FileTreeReader(dict(self.options), self.schema())


class FileTreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: str) -> None:
        self.root = options["path"]
        self.pattern = options.get("pattern", "*")
        self.columns = [field.split(" ")[0] for field in schema.split(", ")]
        self.partition_bytes = int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES)))
        self.least = int(options.get("leastpartitions", options.get("leastPartitions", 1)))

    def partitions(self) -> list[Share]:
        system, root = opened(self.root)
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        files = [
            Listed(info.path, info.size or 0, info.mtime or datetime.fromtimestamp(0, UTC))
            for info in found
            if info.type == fs.FileType.File and fnmatch.fnmatchcase(info.base_name, self.pattern)
        ]
        return shares(files, self.partition_bytes, self.least)

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        system, root = opened(self.root)
        start = len(root.rstrip("/")) + 1
        held, size = [], 0
        for file in partition.files:
            row = self.row(system, file, file.path[start:])
            held.append(row)
            size += len(row.get("content") or "")
            if size >= BATCH_BYTES:
                yield self.batch(held)
                held, size = [], 0
        if held:
            yield self.batch(held)

    def row(self, system: fs.FileSystem, file: Listed, path: str) -> dict:
        row = {"path": path, "length": file.size, "modified": file.modified}
        if "project" in self.columns:
            project, slash, rest = path.partition("/")
            row |= {"project": project if slash else None, "path": rest if slash else path}
        if "content" in self.columns:
            row |= self.content(system, file)
        return row

    def content(self, system: fs.FileSystem, file: Listed) -> dict:
        try:
            if file.size > MOST_BYTES:
                raise OSError("larger than a text can be")
            with system.open_input_stream(file.path) as stream:
                return {"content": stream.read().decode("utf-8"), "error": None}
        except (OSError, UnicodeDecodeError):
            return {"content": None, "error": V.UNREADABLE_FILE}

    def batch(self, rows: list[dict]) -> pa.RecordBatch:
        kinds = {"length": pa.int64(), "modified": pa.timestamp("us", "UTC")}
        columns = [pa.array([row[c] for row in rows], kinds.get(c, pa.string())) for c in self.columns]
        return pa.RecordBatch.from_arrays(columns, names=self.columns)
