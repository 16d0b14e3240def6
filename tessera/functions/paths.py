"""Path expressions: file names, suffix cuts, per-image file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def strip_suffix(name: Column, n: int = K.SUFFIX_CUT) -> Column:
    """Drop the last ``n`` characters whatever they are ('' when shorter)."""
    return F.left(name, F.greatest(F.length(name) - n, F.lit(0)))


def join_path(*parts: Column | str) -> Column:
    """Join path parts with '/', without doubling a separator already present."""
    cols = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    out = cols[0]
    for c in cols[1:]:
        out = F.concat(out, F.when(out.endswith("/"), F.lit("")).otherwise(F.lit("/")), c)
    return out


def image_path(image_dir: str, img_name: Column, ext: str = ".tif") -> Column:
    return join_path(image_dir, F.concat(img_name.cast("string"), F.lit(ext)))


def mask_path(mask_dir: str, folder: Column, img_name: Column, suffix: str = K.MASK_SUFFIX) -> Column:
    return join_path(mask_dir, folder, F.concat(img_name.cast("string"), F.lit(suffix)))
