"""Incremental context tables: new mask files in a folder -> appended area rows.

A file-stream source over ``binaryFile`` picks up rasters as they arrive; each
micro-batch is decoded, turned into the dense area table with the batch operators and
written to a folder of its own (``batch_id=N``), which a repeated batch replaces.  The
checkpoint is a folder that the caller names: a query restarted with it, also in another
application, resumes where it stopped, and each file is processed once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import constants as K
from ..functions import paths as PTH
from ..operators.grid import grid_area
from ..sources.rasters import RASTER_SCHEMA, Decoder, _decode_masks

BINARY_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def stream_context_tables(
    spark: SparkSession,
    root: str,
    out: str,
    checkpoint: str,
    decode: Decoder,
    glob: str = "*.tif",
    cut: int = K.SUFFIX_CUT,
    available_now: bool = False,
    max_files_per_trigger: int = 1000,
) -> StreamingQuery:
    """Start the stream; ``available_now`` processes what is there and stops.

    ``checkpoint`` has to be a stable folder that all machines share.
    """
    files = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_SCHEMA)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .load(root)
        .select(PTH.strip_suffix(PTH.basename(F.col("path")), cut).alias("img_name"), "path", "content")
    )

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        rasters = batch.mapInPandas(_decode_masks(decode), RASTER_SCHEMA)
        grid_area(rasters).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch_id={batch_id}")

    w = files.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
