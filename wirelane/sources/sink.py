"""What the file sinks share: a file a task, under its name only once the job is committed."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage


class Written(WriterCommitMessage):
    def __init__(self, temporary: str, name: str):
        self.temporary, self.name = temporary, name


class FileWriter(DataSourceArrowWriter):
    """Files of a folder from chunks(), which a subclass gives; a task without rows leaves no file.

    A task that is run again leaves no part of a file behind. Overwriting deletes the old files after the new ones are in place.
    """

    suffix = ""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex

    def chunks(self, iterator: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from wirelane.sources.pcap import _filesystem

        store, folder = _filesystem(self.path)
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{self.job}.{self.suffix}"
        temporary = f"{folder}/_temporary-{self.job}/{name}-{context.taskAttemptId()}"
        store.create_dir(os.path.dirname(temporary), recursive=True)
        any_rows = False
        with store.open_output_stream(temporary) as out:
            for chunk in self.chunks(iterator):
                out.write(chunk)
                any_rows = True
        return Written(temporary, name if any_rows else "")

    def _clean(self) -> None:
        from wirelane.sources.pcap import _filesystem

        store, folder = _filesystem(self.path)
        store.create_dir(f"{folder}/_temporary-{self.job}", recursive=True)
        store.delete_dir(f"{folder}/_temporary-{self.job}")

    def commit(self, messages: list) -> None:
        from wirelane.sources.pcap import _filesystem, _paths

        store, folder = _filesystem(self.path)
        store.create_dir(folder, recursive=True)
        old = _paths(self.path) if self.overwrite else []
        for m in messages:
            if m is not None and m.name:
                store.move(m.temporary, f"{folder}/{m.name}")
        for path in old:
            store.delete_file(_filesystem(path)[1])
        self._clean()

    def abort(self, messages: list) -> None:
        self._clean()
