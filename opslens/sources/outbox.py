"""An outbox as a data source: JSON records in a folder for each value of a column, each run of a job in it once.

Tasks write to files of their own under ``_runs/<run>``, which readers do not see. When all have ended, the driver moves the files of
the tasks that Spark counts to ``<column>=<value>/<run>-<n>.json`` and marks the run as done. A run that is marked is not
taken in again; what an earlier, broken attempt of the run has moved is removed first. Records of other runs are never touched,
except by ``overwrite``. Stores are those of :mod:`opslens.sources.files`.
"""

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from opslens.sources.files import opened

DONE = "done"
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"
ROWS_AT_ONCE = 1000


@dataclass
class Written(WriterCommitMessage):
    """The staged files of a task, each with the folder that it belongs to."""

    files: list[tuple[str, str]]


class Outbox(DataSource):
    """Options: ``path``, ``run`` (letters, digits, ``-``, ``_``, ``.``) and ``by``, the column that names the folders."""

    @classmethod
    def name(cls) -> str:
        return "outbox"

    def writer(self, schema: StructType, overwrite: bool) -> "OutboxWriter":
        return OutboxWriter(self.options["path"], self.options["run"], self.options.get("by", "sink"), overwrite)


class OutboxWriter(DataSourceArrowWriter):
    def __init__(self, address: str, run: str, by: str, overwrite: bool) -> None:
        if not run or run != quote(run, safe="") or run.startswith((".", "_")):
            raise ValueError(f"not a name for a run: {run}")
        self.address, self.run, self.by, self.overwrite = address, run, by, overwrite

    def places(self) -> tuple[fs.FileSystem, str, str]:
        system, root = opened(self.address)
        return system, root, f"{root}/_runs/{self.run}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, _, staged = self.places()
        system.create_dir(staged, recursive=True)
        streams: dict[str, tuple[str, pa.NativeFile]] = {}
        try:
            for batch in iterator:
                for start in range(0, len(batch), ROWS_AT_ONCE):
                    for row in batch.slice(start, ROWS_AT_ONCE).to_pylist():
                        value = row.pop(self.by)
                        folder = f"{self.by}={NULL_FOLDER if value is None else quote(str(value), safe=' ')}"
                        if folder not in streams:
                            path = f"{staged}/{uuid.uuid4().hex}.json"
                            streams[folder] = path, system.open_output_stream(path)
                        record = {k: v for k, v in row.items() if v is not None}
                        streams[folder][1].write((json.dumps(record, ensure_ascii=False, default=str) + "\n").encode("utf-8"))
        finally:
            for _, stream in streams.values():
                stream.close()
        return Written([(folder, path) for folder, (path, _) in streams.items()])

    def commit(self, messages: Sequence[Written | None]) -> None:
        system, root, staged = self.places()
        mark = f"{root}/_runs/{self.run}.{DONE}"
        if self.overwrite or system.get_file_info(mark).type == fs.FileType.NotFound:
            for old in self.visible(system, root):
                if self.overwrite or old.base_name.rpartition("-")[0] == self.run:
                    system.delete_file(old.path)
            if self.overwrite:
                for old in system.get_file_info(fs.FileSelector(f"{root}/_runs", allow_not_found=True)):
                    if old.base_name.endswith(f".{DONE}"):
                        system.delete_file(old.path)
            for n, (folder, path) in enumerate(file for m in messages if m for file in m.files):
                system.create_dir(f"{root}/{folder}", recursive=True)
                system.move(path, f"{root}/{folder}/{self.run}-{n}.json")
            system.create_dir(f"{root}/_runs", recursive=True)
            system.open_output_stream(mark).close()
        self.drop_staged(system, staged)

    def abort(self, messages: Sequence[Written | None]) -> None:
        system, _, staged = self.places()
        self.drop_staged(system, staged)

    def visible(self, system: fs.FileSystem, root: str) -> list[fs.FileInfo]:
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        return [f for f in found if f.type == fs.FileType.File and f.path.startswith(f"{root}/{self.by}=")]

    def drop_staged(self, system: fs.FileSystem, staged: str) -> None:
        if system.get_file_info(staged).type != fs.FileType.NotFound:
            system.delete_dir(staged)
