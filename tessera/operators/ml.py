"""Model fitting on Spark ML: multi-label heads on pooled vectors, per-pixel classifier.

The networks of the original pipeline are single-GPU programs; what a Spark user
builds on the same tables is a distributed linear model per label (heads) and a
multinomial classifier over pixel features, with predictions mapped back to class
codes.  Inputs are persisted for the iterations and released afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classes as C
from .grid import explode_pixels
from .remap import argmax, code_id
from .scoring import score_heads


def fit_heads(
    examples: DataFrame, features: str, labels: Sequence[str], max_iter: int = 20, reg: float = 0.01, parallel: int = 8
) -> DataFrame:
    """Fit one binary logistic regression per label column; report training accuracy.

    The per-label fits are independent Spark jobs, submitted from up to ``parallel``
    driver threads so the scheduler runs them side by side (hundreds of labels do not
    queue one after another).  Returns ``label, n, positives, accuracy, loss, prior_loss`` (one
    row per label; losses are mean log losses, of the fit and of always giving the label's
    rate), computed in one scan for all labels.
    """
    data = examples.select(
        array_to_vector(F.col(features)).alias("features"), *[F.col(c).cast("double").alias(c) for c in labels]
    ).persist(StorageLevel.MEMORY_AND_DISK)

    def fit(lab: str):
        return LogisticRegression(featuresCol="features", labelCol=lab, maxIter=max_iter, regParam=reg).fit(data)

    try:
        with ThreadPoolExecutor(max_workers=max(1, min(parallel, len(labels)))) as pool:
            models = list(pool.map(fit, labels))
    finally:
        data.unpersist()
    matrix = (np.array([m.coefficients.toArray() for m in models]), np.array([m.intercept for m in models]))
    truth = F.array(*[F.col(c).cast("int") for c in labels]).alias("y")
    scored = score_heads(examples.select(F.col(features).alias("x"), truth), "x", {"p": matrix}, activation="none")
    pairs = scored.select(F.posexplode_outer(F.arrays_zip("y", "p")).alias("j", "s")).where(F.col("j").isNotNull())
    name = F.element_at(F.array(*[F.lit(c) for c in labels]), F.col("j") + 1)
    out = pairs.groupBy(name.alias("label")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("s.y").cast("bigint").alias("positives"),
        F.avg(((F.col("s.p") > 0.5).cast("int") == F.col("s.y")).cast("int")).alias("accuracy"),
        F.avg(-F.log(F.when(F.col("s.y") == 1, F.col("s.p")).otherwise(1 - F.col("s.p")))).alias("loss"),
    )
    share = F.col("positives") / F.col("n")
    entropy = sum((F.when(q > 0, -q * F.log(q)).otherwise(0.0) for q in (share, 1 - share)), F.lit(0.0))
    return out.withColumn("prior_loss", entropy)


def pixel_features(masks: DataFrame) -> DataFrame:
    """Per pixel: img_name, x, y, code, id (remapped) and three band values.

    band_k = ((code * (k + 3)) % 97 + x % 3) / 97: a deterministic stand-in for RGB
    values, learnable from the code.
    """
    px = explode_pixels(masks, "pixels", "p", "width").select(
        "img_name",
        (F.col("p") % F.col("width")).cast("int").alias("x"),
        F.floor(F.col("p") / F.col("width")).cast("int").alias("y"),
        "code",
    )
    bands = [((F.col("code") * (k + 3)) % 97 + F.col("x") % 3) / 97.0 for k in range(3)]
    return px.select("img_name", "x", "y", "code", code_id(F.col("code")).alias("id"), F.array(*bands).alias("bands"))


def _weighted_rows(pixels: DataFrame) -> DataFrame:
    """features, label, w: equal (bands, id) rows as one row with their count as weight."""
    grouped = pixels.groupBy("bands", "id").agg(F.count(F.lit(1)).cast("double").alias("w"))
    return grouped.select(array_to_vector("bands").alias("features"), F.col("id").cast("double").alias("label"), "w")


def train_pixel_model(pixels: DataFrame, max_iter: int = 15):
    """Multinomial logistic regression id ~ bands on weighted distinct rows.

    Identical (features, id) rows are merged first into one row with a weight equal to
    their count: the weighted log-likelihood is the same sum, so the fit is exact while
    the iterations run over the distinct rows only (map-side combined before the shuffle).
    """
    data = _weighted_rows(pixels).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return LogisticRegression(maxIter=max_iter, family="multinomial", regParam=0.0, weightCol="w").fit(data), data
    except Exception:
        data.unpersist()
        raise


def fit_pixels(pixels: DataFrame, max_iter: int = 15) -> DataFrame:
    """Fit the pixel classifier and report, per true id: ``id, code, n, correct``."""
    model, data = train_pixel_model(pixels, max_iter)
    try:
        pred = model.transform(data).select(
            F.col("label").cast("int").alias("id"),
            "w",
            argmax(vector_to_array("probability")).alias("pred_id"),
        )
        return pred.groupBy("id").agg(
            F.sum("w").cast("long").alias("n"),
            F.sum(F.when(F.col("pred_id") == F.col("id"), F.col("w")).otherwise(0.0)).cast("long").alias("correct"),
        ).withColumn("code", F.element_at(C.id_to_code(), F.col("id") + 1))
    finally:
        data.unpersist()


def train_pixel_forest(pixels: DataFrame, trees: int = 20, depth: int = 12, seed: int = 0):
    """Random forest id ~ bands (splits searched on histograms of the bands, grown level by level over all trees).

    Like :func:`train_pixel_model` on weighted distinct rows; the caller unpersists the second value.
    """
    data = _weighted_rows(pixels).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=128, seed=seed, weightCol="w", featureSubsetStrategy="all")
        return forest.fit(data), data
    except Exception:
        data.unpersist()
        raise


def compare_pixel_models(train: DataFrame, held_out: DataFrame, max_iter: int = 15, trees: int = 20, depth: int = 12, seed: int = 0) -> DataFrame:
    """model (``linear``, ``forest``), n, correct, majority: how both classifiers do on held-out pixels.

    ``majority`` is how many pixels the most frequent held-out class has.
    """
    rows = _weighted_rows(held_out).withColumnRenamed("label", "truth")
    parts = []
    for name, (model, data) in (("linear", train_pixel_model(train, max_iter)), ("forest", train_pixel_forest(train, trees, depth, seed))):
        hit = argmax(vector_to_array("probability")) == F.col("truth").cast("int")
        scored = model.transform(rows).groupBy("truth").agg(F.sum("w").alias("n"), F.sum(F.when(hit, F.col("w")).otherwise(0.0)).alias("correct"))
        whole = scored.agg(F.sum("n").cast("long").alias("n"), F.sum("correct").cast("long").alias("correct"), F.max("n").cast("long").alias("majority"))
        parts.append(whole.select(F.lit(name).alias("model"), "*"))
        data.unpersist()
    return parts[0].unionByName(parts[1])


def predict_pixels(model, pixels: DataFrame) -> DataFrame:
    """Per pixel: img_name, x, y, predicted id (first maximum) and its class code."""
    scored = model.transform(pixels.select("img_name", "x", "y", array_to_vector("bands").alias("features")))
    ids = argmax(vector_to_array("probability"))
    return scored.select("img_name", "x", "y", ids.alias("id")).withColumn(
        "code", F.element_at(C.id_to_code(), F.col("id") + 1)
    )


def masks_from_pixels(pred: DataFrame, value: str = "code") -> DataFrame:
    """Gather per-pixel predictions back into raster rows (img_name, height, width, pixels).

    One group per image, bounded by the image size; the result feeds the grid operators.
    """
    return pred.groupBy("img_name").agg(
        (F.max("y") + 1).cast("int").alias("height"),
        (F.max("x") + 1).cast("int").alias("width"),
        F.transform(F.array_sort(F.collect_list(F.struct("y", "x", F.col(value).alias("v")))), lambda s: s["v"]).alias(
            "pixels"
        ),
    )
