"""Text files written by tasks: ``df.write.format("text_files")`` with rows (name, content).

A file is written beside its place and moved there whole, so a repeated task leaves the same
files. The commit lists them in ``session-files.json``. Folders may lie in any file system that pyarrow knows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

INDEX = "session-files.json"


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder else str(Path(folder).absolute()))


class Names(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class TextFilesWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Names:
        store, folder = opened(self.folder)
        names = []
        for batch in iterator:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content")):
                path = f"{folder}/{name}"
                store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                part = f"{path}.{uuid.uuid4().hex}.part"
                with store.open_output_stream(part) as out:
                    out.write(content.as_py().encode())
                store.move(part, path)
                names.append(name)
        return Names(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder = opened(self.folder)
        names = sorted(n for m in messages if m is not None for n in m.names)
        with store.open_output_stream(f"{folder}/{INDEX}") as out:
            out.write(json.dumps(names, indent=0).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Files stay; only a commit lists them."""


class TextFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "text_files"

    def schema(self) -> str:
        return "name string, content string"

    def writer(self, schema: StructType, overwrite: bool) -> TextFilesWriter:
        return TextFilesWriter(self.options["path"])


def write_files(rows: DataFrame, folder: str) -> list[str]:
    """Writes rows (name, content); the names of the files."""
    store, path = opened(folder)
    store.create_dir(path, recursive=True)
    rows.sparkSession.dataSource.register(TextFiles)
    rows.select("name", "content").write.format("text_files").mode("append").save(folder)
    with store.open_input_stream(f"{path}/{INDEX}") as data:
        return json.loads(data.read())
