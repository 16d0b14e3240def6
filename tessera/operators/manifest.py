"""Image manifests: split counts, file paths, manifest x raster join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as PTH
from ..schemas import check


def read_manifests(spark, paths_by_split: dict[str, str]) -> DataFrame:
    """One manifest parquet per split -> img_name, path_to_your_file, split."""
    frames = [check(spark.read.parquet(p), "manifest").withColumn("split", F.lit(s)) for s, p in paths_by_split.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def split_counts(manifest: DataFrame) -> DataFrame:
    """split, n: rows per split."""
    return manifest.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def manifest_paths(manifest: DataFrame, image_dir: str, mask_dir: str) -> DataFrame:
    """img_name, split, img_path, mask_path."""
    return manifest.select(
        "img_name",
        "split",
        PTH.image_path(image_dir, F.col("img_name")).alias("img_path"),
        PTH.mask_path(mask_dir, F.col("path_to_your_file"), F.col("img_name")).alias("mask_path"),
    )


def manifest_join(manifest: DataFrame, masks: DataFrame, rgb: DataFrame | None = None, missing: str = "error") -> DataFrame:
    """Manifest rows with their mask (and image) rasters.

    Masks are found by folder and name where they have a ``folder`` column (a name may be in
    several folders), else by name; images by name.  ``missing``: a manifest row whose file isn't
    there fails the job (``error``), is left out (``drop``) or has NULL columns (``null``).  Rasters
    partitioned by ``img_name`` are not moved.
    """
    if missing not in ("error", "drop", "null"):
        raise ValueError("missing must be error, drop or null")
    how = "inner" if missing == "drop" else "left"
    out = manifest
    for what, rasters in (("mask", masks), ("image", rgb)):
        if rasters is None:
            continue
        on = ["img_name"]
        if "folder" in rasters.columns:
            rasters = rasters.withColumnRenamed("folder", "path_to_your_file")
            on.append("path_to_your_file")
        found = rasters.withColumn("_found", F.lit(True))
        out = out.join(found, on, how)
        if missing == "error":
            name = F.concat_ws("/", *on[::-1])
            lost = F.raise_error(F.concat(F.lit(f"no {what} file for "), name)).cast("string")
            out = out.withColumn("img_name", F.when(F.col("_found").isNull(), lost).otherwise(F.col("img_name")))
        out = out.drop("_found")
    return out
