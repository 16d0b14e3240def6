"""Raster ingestion: list files, decode them once into an array table.

``binaryFile`` lists and reads the files in parallel (the glob is applied while
listing); each task decodes its files with NumPy inside ``mapInPandas``.  The
result is written once as a table bucketed by ``img_name``, so later per-image
aggregations read it co-partitioned and do not shuffle pixels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import paths as PTH

RASTER_SCHEMA = "img_name string, path string, height int, width int, pixels array<int>"
RGB_SCHEMA = "img_name string, path string, height int, width int, bands array<array<float>>"

Decoder = Callable[[bytes], np.ndarray]


def list_rasters(spark: SparkSession, root: str, glob: str = "*.tif") -> DataFrame:
    """path, modificationTime, length, content of every matching file under ``root`` (recursive, case-sensitive glob)."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(root)
    )


def _decode_masks(decode: Decoder) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches):
        for pdf in batches:
            for name, path, content in zip(pdf["img_name"], pdf["path"], pdf["content"]):  # one raster in memory at a time
                a = np.asarray(decode(bytes(content)))
                if a.ndim != 2:
                    raise ValueError("mask rasters must have one band")
                pixels = a.astype(np.int32).ravel()
                yield pd.DataFrame({"img_name": [name], "path": [path], "height": [a.shape[0]], "width": [a.shape[1]], "pixels": [pixels]})

    return run


def _decode_rgb(decode: Decoder) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches):
        for pdf in batches:
            for name, path, content in zip(pdf["img_name"], pdf["path"], pdf["content"]):
                a = np.asarray(decode(bytes(content)))
                a = a[:, :, None] if a.ndim == 2 else a
                bands = [a[:, :, b].astype(np.float32).ravel() for b in range(a.shape[2])]
                yield pd.DataFrame({"img_name": [name], "path": [path], "height": [a.shape[0]], "width": [a.shape[1]], "bands": [bands]})

    return run


def ingest_rasters(
    spark: SparkSession,
    root: str,
    decode: Decoder,
    glob: str = "*.tif",
    cut: int = K.SUFFIX_CUT,
    kind: str = "mask",
) -> DataFrame:
    """Decode every raster under ``root``: img_name, path, height, width, pixels (or bands).

    ``decode`` turns a file's bytes into an array (height, width) or (height, width, bands).

    ``img_name`` is the file name without its last ``cut`` characters (mask files end
    in ``_reference_map.tif``; pass ``cut=4`` for ``<name>.tif`` images).
    """
    files = list_rasters(spark, root, glob).select(
        PTH.strip_suffix(PTH.basename(F.col("path")), cut).alias("img_name"), "path", "content"
    )
    if kind == "mask":
        return files.mapInPandas(_decode_masks(decode), RASTER_SCHEMA)
    if kind == "rgb":
        return files.mapInPandas(_decode_rgb(decode), RGB_SCHEMA)
    raise ValueError("kind must be mask or rgb")


def write_raster_table(rasters: DataFrame, table: str, buckets: int, mode: str = "overwrite") -> None:
    """Save rasters as a table bucketed and sorted by ``img_name`` (co-partitioned reads)."""
    rasters.write.mode(mode).bucketBy(buckets, "img_name").sortBy("img_name").saveAsTable(table)
