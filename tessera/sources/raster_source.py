"""Rasters as a Spark data source: files dealt out by size, only the wanted window decoded.

The driver lists the files and packs them into partitions of about ``partition_bytes`` (a small file
counts as :data:`OPEN_BYTES`, so a task doesn't get thousands of them); a partition carries paths, not contents.  A
task opens one file at a time and gives it to the caller's decoder with the window's side, so of a large raster a decoder that
can seek reads the upper left window alone, as far as the grid reaches, and no whole file is held.

Folders are reached through ``pyarrow.fs``, as in :mod:`sources.text_files`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from fnmatch import fnmatchcase
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import constants as K
from .rasters import RASTER_SCHEMA, RGB_SCHEMA
from .text_files import _store

#: An open file and a side (None: whole raster) to an array of at most side x side pixels (by bands, if any): the
#: upper left window, or all of the raster if the decoder can't cut it.
WindowDecoder = Callable[[BinaryIO, int | None], np.ndarray]

PARTITION_BYTES = 128 << 20
OPEN_BYTES = 4 << 20


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


def packed(files: Sequence[tuple[str, int]], limit: int) -> list[Files]:
    """Files (path, bytes) in order, in partitions of at most ``limit`` bytes or one file."""
    out: list[list[str]] = []
    room = 0
    for path, size in files:
        cost = max(size, OPEN_BYTES)
        if not out or cost > room:
            out.append([])
            room = limit
        out[-1].append(path)
        room -= cost
    return [Files(tuple(p)) for p in out]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], decode: WindowDecoder):
        self.root, self.glob = options["root"], options.get("glob", "*.tif")
        self.cut, self.rgb = int(options.get("cut", K.SUFFIX_CUT)), options.get("kind", "mask") == "rgb"
        self.side = int(options["window"]) if options.get("window") else None
        self.limit = int(options.get("partition_bytes", PARTITION_BYTES))
        self.decode = decode

    def partitions(self) -> list[Files]:
        store, root = _store(self.root)
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.is_file and fnmatchcase(f.base_name, self.glob))
        return packed(files, self.limit) or [Files(())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store = _store(self.root)[0]
        for path in partition.paths:
            with store.open_input_file(path) as f:
                a = np.asarray(self.decode(f, self.side))
            a = a[:self.side, :self.side]
            name = path.rsplit("/", 1)[-1]
            name = name[:-self.cut] if self.cut else name
            if self.rgb:
                a = a[:, :, None] if a.ndim == 2 else a
                data = pa.array([[a[:, :, b].astype(np.float32).ravel() for b in range(a.shape[2])]], pa.list_(pa.list_(pa.float32())))
            elif a.ndim != 2:
                raise ValueError("mask rasters must have one band")
            else:
                data = pa.array([a.astype(np.int32).ravel()], pa.list_(pa.int32()))
            sides = [pa.array([n], pa.int32()) for n in a.shape[:2]]
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([path]), *sides, data], ["img_name", "path", "height", "width", "bands" if self.rgb else "pixels"])


def raster_source(decode: WindowDecoder) -> type[DataSource]:
    """A data source called ``rasters`` with the caller's decoder.

    Options: ``root`` (searched whole), ``glob`` (of file names, case-sensitive), ``cut`` (characters that a
    name loses at its end), ``kind`` (``mask`` or ``rgb``), ``window`` (a side; none: whole rasters) and ``partition_bytes``.
    """

    class RasterSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return "rasters"

        def schema(self) -> str:
            kind = self.options.get("kind", "mask")
            if kind not in ("mask", "rgb"):
                raise ValueError("kind must be mask or rgb")
            return RGB_SCHEMA if kind == "rgb" else RASTER_SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return _Reader(dict(self.options), decode)

    return RasterSource


def read_rasters(
    spark: SparkSession,
    root: str,
    decode: WindowDecoder,
    glob: str = "*.tif",
    cut: int = K.SUFFIX_CUT,
    kind: str = "mask",
    window: int | None = K.GRID_EXTENT,
    partition_bytes: int = PARTITION_BYTES,
) -> DataFrame:
    """img_name, path, height, width, pixels (or bands) of the window of every raster under ``root``.

    What the grid operators make of it is what they make of :func:`sources.rasters.ingest_rasters`: pixels
    outside the grid's extent count nowhere.  ``height`` and ``width`` are those of the window.
    """
    spark.dataSource.register(raster_source(decode))
    options = {"root": root, "glob": glob, "cut": str(cut), "kind": kind, "partition_bytes": str(partition_bytes)}
    return spark.read.format("rasters").options(**options, **({"window": str(window)} if window else {})).load()
