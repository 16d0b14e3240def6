"""Image arrays: bilinear resize, byte scaling and per-band normalisation.

Images stay one row each (``array<double>`` row-major per band, bands as
``array<array<...>>``); every operator is a projection with higher-order functions,
so it runs inside the scan stage without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K


def axis_table(n_in: int, n_out: int) -> tuple[list[int], list[int], list[float]]:
    """Per output index: first and second source index and the weight of the second.

    Half-pixel centres, no corner alignment: ``s = max((o + 0.5) * n_in / n_out - 0.5, 0)``,
    ``i0 = floor(s)``, ``i1 = min(i0 + 1, n_in - 1)``, ``w = s - i0``.  The sizes are
    known when the plan is built, so the table is a literal (same IEEE arithmetic).
    """
    i0s, i1s, ws = [], [], []
    for o in range(n_out):
        s = max((o + 0.5) * n_in / n_out - 0.5, 0.0)
        i0 = math.floor(s)
        i0s.append(i0)
        i1s.append(min(i0 + 1, n_in - 1))
        ws.append(s - i0)
    return i0s, i1s, ws


def resize_band(band: Column, in_h: int, in_w: int, out_h: int, out_w: int) -> Column:
    """Bilinear resize of one row-major band of ``in_h x in_w`` to ``out_h x out_w`` (doubles)."""

    def lit_array(xs):
        return F.array(*[F.lit(x) for x in xs])

    y0s, y1s, wys = (lit_array(t) for t in axis_table(in_h, out_h))
    x0s, x1s, wxs = (lit_array(t) for t in axis_table(in_w, out_w))

    def px(y, x):
        return F.element_at(band, y * in_w + x + 1).cast("double")

    def value(o):
        oy = F.floor(o / out_w).cast("int") + 1
        ox = (o % out_w).cast("int") + 1
        y0, y1, wy = F.element_at(y0s, oy), F.element_at(y1s, oy), F.element_at(wys, oy)
        x0, x1, wx = F.element_at(x0s, ox), F.element_at(x1s, ox), F.element_at(wxs, ox)
        top = (F.lit(1.0) - wx) * px(y0, x0) + wx * px(y0, x1)
        bottom = (F.lit(1.0) - wx) * px(y1, x0) + wx * px(y1, x1)
        return (F.lit(1.0) - wy) * top + wy * bottom

    return F.transform(F.sequence(F.lit(0), F.lit(out_h * out_w - 1)), value)


def resize_bilinear(df: DataFrame, col: str, in_h: int, in_w: int, out_h: int, out_w: int, out: str | None = None) -> DataFrame:
    """Resize a band (``array<number>``) or a stack of bands (``array<array<number>>``).

    A band that hasn't ``in_h * in_w`` values fails the job.
    """
    def checked(band: Column) -> Column:
        wrong = F.concat(F.lit(f"a band of {in_h} x {in_w} expected, values: "), F.size(band).cast("string"))
        return F.when(F.size(band) == in_h * in_w, band).otherwise(F.raise_error(wrong).cast(band_type))

    dt = df.schema[col].dataType
    nested = hasattr(dt, "elementType") and hasattr(dt.elementType, "elementType")
    band_type = dt.elementType if nested else dt
    df = df.withColumn(out or col, F.transform(col, checked) if nested else checked(F.col(col)))
    col = out or col
    expr = (
        F.transform(col, lambda b: resize_band(b, in_h, in_w, out_h, out_w))
        if nested
        else resize_band(F.col(col), in_h, in_w, out_h, out_w)
    )
    return df.withColumn(col, expr)


#: Fraction bits of the weights of :func:`resize_bytes`.
BYTE_BITS = 22


def byte_axis(n_in: int, n_out: int) -> tuple[np.ndarray, np.ndarray]:
    """Per output index: the first source index and the fixed-point weights of the following ones (0 beyond the last).

    A triangle around the output's centre, as wide as an output step when shrinking (so every source
    pixel counts) and two source pixels wide when enlarging; weights are normalised, then rounded to :data:`BYTE_BITS` bits.
    """
    step = n_in / n_out
    wide = max(step, 1.0)
    firsts, weights = [], []
    for o in range(n_out):
        centre = (o + 0.5) * step
        lo, hi = max(int(centre - wide + 0.5), 0), min(int(centre + wide + 0.5), n_in)
        own = [max(0.0, 1.0 - abs((i - centre + 0.5) * (1.0 / wide))) for i in range(lo, hi)]
        total = sum(own)
        firsts.append(lo)
        weights.append([int(0.5 + w / total * (1 << BYTE_BITS)) for w in own])
    taps = max(map(len, weights))
    return np.array(firsts), np.array([w + [0] * (taps - len(w)) for w in weights], dtype=np.int64)


def _byte_pass(a: np.ndarray, n_out: int) -> np.ndarray:
    """Resamples the last axis of bytes, rounded to bytes again."""
    firsts, weights = byte_axis(a.shape[-1], n_out)
    out = np.full((*a.shape[:-1], n_out), 1 << (BYTE_BITS - 1), dtype=np.int64)
    for t in range(weights.shape[1]):
        out += a[..., np.minimum(firsts + t, a.shape[-1] - 1)] * weights[:, t]
    return np.clip(out >> BYTE_BITS, 0, 255)


def resize_bytes(df: DataFrame, col: str, in_h: int, in_w: int, out_h: int, out_w: int, out: str | None = None) -> DataFrame:
    """Bilinear resize of 8-bit bands, as image libraries do it: along the rows, then along the columns, each pass
    rounded to a byte; the filter widens when shrinking (:func:`byte_axis`).

    ``col``: a band (array of 0 to 255, row-major) or a stack of bands; the result is ``array<int>`` of the same shape.  A
    NULL band stays NULL; a band that hasn't ``in_h * in_w`` values, a NULL in it or a value that is no byte fails the job.
    """
    dt = df.schema[col].dataType
    nested = hasattr(dt, "elementType") and hasattr(dt.elementType, "elementType")

    def resized(band) -> np.ndarray | None:
        if band is None:
            return None
        a = np.asarray(band, dtype=np.float64)
        if a.size != in_h * in_w:
            raise ValueError(f"a band of {in_h} x {in_w} expected, values: {a.size}")
        if not ((a >= 0) & (a <= 255) & (a == np.floor(a))).all():
            raise ValueError("bytes expected")
        rows = _byte_pass(a.astype(np.int64).reshape(in_h, in_w), out_w)
        return _byte_pass(rows.T, out_h).T.ravel().astype(np.int32)

    @F.pandas_udf("array<array<int>>" if nested else "array<int>")
    def resize(bands: pd.Series) -> pd.Series:
        if nested:
            return pd.Series([None if v is None else [resized(b) for b in v] for v in bands])
        return pd.Series([resized(v) for v in bands])

    return df.withColumn(out or col, resize(F.col(col)))


def normalize_bands(bands: Column, mean: Sequence[float], std: Sequence[float], scale: float = 255.0) -> Column:
    """``((v / scale) - mean[b]) / std[b]`` for every value of band ``b`` (bytes -> [0,1] -> z)."""
    m = F.array(*[F.lit(float(x)) for x in mean])
    s = F.array(*[F.lit(float(x)) for x in std])
    return F.transform(
        bands,
        lambda band, b: F.transform(
            band,
            lambda v: (v.cast("double") / F.lit(float(scale)) - F.element_at(m, b + 1)) / F.element_at(s, b + 1),
        ),
    )


def predicted_rasters(logits: DataFrame, in_h: int, in_w: int, side: int = K.GRID_EXTENT) -> DataFrame:
    """Class logit maps -> rasters: every channel resized to ``side`` x ``side``, first maximum per pixel, its code.

    ``logits``: img_name, logits array<array<float>> (a row-major map per class id).  A map that
    hasn't ``in_h * in_w`` values fails the job.  One image is resized at a time: two small
    matrix products per channel.
    """
    codes = np.array(K.ID_CODES, dtype=np.int32)

    def axis(n_in: int) -> np.ndarray:
        i0, i1, w = (np.array(t) for t in axis_table(n_in, side))
        m = np.zeros((side, n_in))
        np.add.at(m, (np.arange(side), i0), 1.0 - w)
        np.add.at(m, (np.arange(side), i1), w)
        return m

    rows, cols = axis(in_h), axis(in_w)

    def run(batches):
        for pdf in batches:
            for name, maps in zip(pdf["img_name"], pdf["logits"]):
                z = np.stack([np.asarray(m, dtype=np.float64).reshape(in_h, in_w) for m in maps])
                ids = (rows @ z @ cols.T).argmax(axis=0)
                yield pd.DataFrame({"img_name": [name], "height": [side], "width": [side], "pixels": [codes[ids].ravel()]})

    return logits.select("img_name", "logits").mapInPandas(run, "img_name string, height int, width int, pixels array<int>")
