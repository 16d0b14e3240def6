"""A Spark data source that writes one text file per row, with commit and abort.

Every task writes into a folder of its own attempt under ``<folder>/_staging-<job>``, and tells the driver that
folder when it has finished.  Only then, when all tasks have, does the driver move the files to their
places; an attempt that failed or was overtaken is never named, so its files are never seen.  When
the job fails, the staging folder goes and nothing else has changed.

Folders are reached through ``pyarrow.fs``: a plain path, ``file://``, or a store that it knows (``hdfs://``,
``s3://``, ``gs://``).  The driver and the executors must share them.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Files that the driver moves side by side.
MOVERS = 16


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder.rstrip("/"))
    return fs.LocalFileSystem(), os.path.abspath(folder)


@dataclass
class Attempt(WriterCommitMessage):
    folder: str
    files: int


class TextFilesSource(DataSource):
    """Columns ``index`` and ``text`` (strings): ``<index>.txt`` in the folder of the option ``folder`` (mode ``append``).

    The file holds the text's UTF-8 bytes; a NULL text gives an empty file.  A NULL or empty index, one with a
    ``/`` and an index that occurs twice fail the job.  A file that is there from before is replaced.
    """

    @classmethod
    def name(cls) -> str:
        return "text_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("write with mode append")
        if [f.name for f in schema.fields] != ["index", "text"]:
            raise ValueError("columns index and text expected")
        return TextFilesWriter(self.options["folder"], f"_staging-{uuid.uuid4().hex}")


class TextFilesWriter(DataSourceWriter):
    def __init__(self, folder: str, staging: str):
        self.folder, self.staging = folder, staging

    def write(self, iterator: Iterator) -> Attempt:
        store, folder = _store(self.folder)
        own = f"{folder}/{self.staging}/{uuid.uuid4().hex}"  # every attempt has another
        store.create_dir(own, recursive=True)
        seen: set[str] = set()
        for row in iterator:
            index = row["index"]
            if not index or "/" in index:
                raise ValueError(f"no file can have the index {index!r}")
            if index in seen:
                raise ValueError(f"duplicate index: {index}")
            seen.add(index)
            with store.open_output_stream(f"{own}/{index}.txt") as f:
                f.write((row["text"] or "").encode("utf-8"))
        return Attempt(own, len(seen))

    def commit(self, messages: list[Attempt | None]) -> None:
        store, folder = _store(self.folder)
        taken: set[str] = set()
        moves = []
        for m in filter(None, messages):
            files = store.get_file_info(fs.FileSelector(m.folder))
            if len(files) != m.files:
                raise RuntimeError(f"{m.folder} has {len(files)} of {m.files} files")
            for f in files:
                if f.base_name in taken:
                    raise ValueError(f"duplicate index: {f.base_name.removesuffix('.txt')}")
                taken.add(f.base_name)
                moves.append((f.path, f"{folder}/{f.base_name}"))
        store.create_dir(folder, recursive=True)
        with ThreadPoolExecutor(MOVERS) as pool:
            list(pool.map(lambda m: store.move(*m), moves))
        self._clear(store, folder)

    def abort(self, messages: list[Attempt | None]) -> None:
        self._clear(*_store(self.folder))

    def _clear(self, store: fs.FileSystem, folder: str) -> None:
        if store.get_file_info(f"{folder}/{self.staging}").type == fs.FileType.Directory:
            store.delete_dir(f"{folder}/{self.staging}")
