"""One indented JSON array written by the cluster: a Python data source with Spark's commit protocol."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def _filesystem(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Part(WriterCommitMessage):
    partition: int
    path: str
    rows: int


class ArrayWriter(DataSourceWriter):
    """Each task writes its rows as text into a part beside the target; the commit joins the parts in the order of the partitions, byte by byte, and moves the whole into place. What isn't committed is deleted."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.parts = path, overwrite, f"{path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Part:
        task = TaskContext.get()
        files, folder = _filesystem(self.parts)
        files.create_dir(folder, recursive=True)
        part, rows = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}", 0
        with files.open_output_stream(part) as out:
            for row in iterator:
                text = json.dumps(row.asDict(recursive=True), indent=2, ensure_ascii=False).replace("\n", "\n  ")
                out.write(f"{',' if rows else ''}\n  {text}".encode())
                rows += 1
        return Part(task.partitionId(), part, rows)

    def commit(self, messages: list) -> None:
        files, target = _filesystem(self.path)
        whole = f"{_filesystem(self.parts)[1]}.whole"
        try:
            some = False
            with files.open_output_stream(whole) as out:
                out.write(b"[")
                for part in sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.partition):
                    out.write(b"," if some else b"")
                    some = True
                    with files.open_input_stream(part.path) as source:
                        while piece := source.read(1 << 20):
                            out.write(piece)
                out.write(b"\n]" if some else b"]")
            files.move(whole, target)
        finally:
            self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        files, folder = _filesystem(self.parts)
        if files.get_file_info(folder).type != fs.FileType.NotFound:
            files.delete_dir(folder)
        if files.get_file_info(f"{folder}.whole").type != fs.FileType.NotFound:
            files.delete_file(f"{folder}.whole")


class JsonArraySource(DataSource):
    """df.write.format("json_array").mode("overwrite").save(path)"""

    @classmethod
    def name(cls) -> str:
        return "json_array"

    def writer(self, schema, overwrite: bool) -> ArrayWriter:
        return ArrayWriter(self.options["path"], overwrite)
