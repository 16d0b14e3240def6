"""Query registry: one callable ``(spark, sf_dir) -> DataFrame`` per Q-name.

Each query reads the scale-factor tables (or inputs Spark derives from them) whole.
Floating results are rounded to 6 digits so that the oracle, which sums in another
order, gives the same values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import paths as PTH
from ..operators import batching as B
from ..operators import encode as E
from ..operators import examples as X
from ..operators import grid as G
from ..operators import images as IM
from ..operators import labels as L
from ..operators import manifest as M
from ..operators import ml as ML
from ..operators import prompts as P
from ..operators import remap as R
from ..operators import scoring as S
from ..operators import training as T
from ..sources import derived as D
from ..sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__.removeprefix("q_")] = fn
    return fn


@query
def q_grid_counts(spark, sf):
    return G.grid_counts(D.masks(spark, sf))


@query
def q_grid_cells(spark, sf):
    return G.grid_cells(D.masks(spark, sf))


@query
def q_image_classes(spark, sf):
    return G.image_classes(D.masks(spark, sf))


@query
def q_grid_area(spark, sf):
    return G.grid_area(D.masks(spark, sf))


@query
def q_grid_pivot(spark, sf):
    return G.grid_pivot(G.grid_area(D.masks(spark, sf)))


# --- questions and prompts --------------------------------------------------------------
def _qa_flat(qa):
    return qa.select(
        "index",
        "img_name",
        "question",
        "question_type",
        "answer",
        F.size("grid_coordinates").alias("n_lines"),
        F.array_join(F.flatten("grid_coordinates"), " ").alias("coords"),
    )


@query
def q_qa_scan(spark, sf):
    return _qa_flat(D.qa(spark, sf))


@query
def q_head_rows(spark, sf):
    return B.head_rows(D.qa(spark, sf), 10, "index").select("index", "img_name", "question")


@query
def q_prompt_text(spark, sf):
    return P.prompt_text(D.qa(spark, sf), G.grid_area(D.masks(spark, sf)), missing="empty")


@query
def q_missing_context(spark, sf):
    return P.missing_context(D.qa(spark, sf), G.grid_area(D.masks(spark, sf)))


@query
def q_flat_context(spark, sf):
    flat = P.flat_context(G.grid_area(D.masks(spark, sf)))
    return flat.select("img_name", F.array_join("values", ",").alias("values"))


# --- labels ------------------------------------------------------------------------------
@query
def q_json_vocab(spark, sf):
    ev = read_table(spark, sf, "events", "props")
    return L.vocab_from_json(ev, "props").groupBy("token", "id").agg(F.count(F.lit(1)).alias("n"))


@query
def q_patch_labels(spark, sf):
    lab = L.patch_labels(D.qa(spark, sf), empty="keep")
    return lab.select("index", F.array_join("labels", ",").alias("labels"))


@query
def q_patch_multihot(spark, sf):
    lab = L.patch_labels(D.qa(spark, sf), empty="keep")
    mh = L.patch_multihot(lab, L.vocab_map(L.patch_vocab(spark)))
    return mh.select("index", L.bits(F.col("multihot")).alias("bits"))


@query
def q_answer_ids(spark, sf):
    ids = L.answer_ids(D.qa(spark, sf), L.vocab_map(L.answer_vocab(spark), K.PROTECTED_ANSWERS))
    return ids.select("index", F.size("tokens").alias("n_tokens"), F.array_join("ids", ",").alias("ids"))


@query
def q_answer_multihot(spark, sf):
    ids = L.answer_ids(D.qa(spark, sf), L.vocab_map(L.answer_vocab(spark), K.PROTECTED_ANSWERS))
    mh = L.answer_multihot(ids)
    return mh.select(
        "index",
        L.n_hot(F.col("multihot")).alias("n_hot"),
        L.bits(F.col("multihot")).alias("bits"),
    )


# --- remapping, paths, manifests ---------------------------------------------------------
@query
def q_remap_codes(spark, sf):
    # Count codes per image first (codegen'd, no shuffle), then map the <= 45 codes of
    # each image to ids and merge codes sharing an id; same result as remapping every
    # pixel and counting ids.
    m = D.masks(spark, sf)
    codes = G.explode_pixels(m).groupBy("img_name", "code").agg(
        F.count(F.lit(1)).alias("n")
    )
    return codes.groupBy("img_name", R.code_id(F.col("code")).alias("id")).agg(F.sum("n").alias("n"))


@query
def q_predicted_mask(spark, sf):
    logits = D.vectors(spark, sf).select("vec_id", D.class_scores(F.col("embedding")).alias("z"))
    return R.predicted_codes(logits).select("vec_id", "id", "code")


@query
def q_strip_suffix(spark, sf):
    sup = read_table(spark, sf, "supplier", "s_suppkey", "s_name")
    path = F.when(F.col("s_suppkey") % 7 == 0, F.lit("masks/short.tif")).otherwise(
        F.concat(F.lit("masks/"), F.col("s_name"), F.lit(K.MASK_SUFFIX))
    )
    out = sup.select("s_suppkey", path.alias("path"))
    return out.withColumn("out_name", F.concat(PTH.strip_suffix(PTH.basename(F.col("path"))), F.lit(".parquet")))


@query
def q_manifest_scan(spark, sf):
    return M.split_counts(D.manifest(spark, sf))


@query
def q_manifest_paths(spark, sf):
    return M.manifest_paths(D.manifest(spark, sf), "images/", "masks/")


@query
def q_manifest_join(spark, sf):
    j = M.manifest_join(D.manifest(spark, sf), D.masks(spark, sf))
    return j.select("img_name", "split", F.col("path_to_your_file").alias("folder"), "height", "width")


# --- images, scoring, losses, batching ---------------------------------------------------
def r6(c):
    return F.round(c, 6)


@query
def q_resize_bilinear(spark, sf):
    v = D.vectors(spark, sf).select("vec_id", "embedding")
    out = IM.resize_bilinear(v, "embedding", 8, 8, 15, 15, out="img")
    # an outer explode: a plain one has Spark push size(img) > 0 below, which resizes twice
    return out.select("vec_id", F.posexplode_outer("img").alias("p", "v")).where(F.col("p").isNotNull()).select(
        "vec_id", F.floor(F.col("p") / 15).cast("int").alias("y"), (F.col("p") % 15).cast("int").alias("x"), r6(F.col("v")).alias("v")
    )


@query
def q_resize_bytes(spark, sf):
    # 8 x 8 bytes, enlarged to 15 x 13 and shrunk to 5 x 3
    v = D.vectors(spark, sf)
    byte = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") + 1) * 128))).cast("int"))
    parts = []
    for name, h, w in (("large", 15, 13), ("small", 5, 3)):
        out = IM.resize_bytes(v.select("vec_id", byte.alias("img")), "img", 8, 8, h, w)
        px = out.select("vec_id", F.posexplode_outer("img").alias("p", "v")).where(F.col("p").isNotNull())
        parts.append(px.select("vec_id", F.lit(name).alias("size"), F.floor(F.col("p") / w).cast("int").alias("y"), (F.col("p") % w).cast("int").alias("x"), "v"))
    return parts[0].unionByName(parts[1])


@query
def q_normalize_bands(spark, sf):
    v = D.vectors(spark, sf)
    bands = F.array(*["embedding"] * 3)  # every band gets all 64 values
    mean, std = K.NORM_MULTISPECTRAL
    norm = v.select("vec_id", IM.normalize_bands(bands, mean, std).alias("bands"))
    return (
        norm.select("vec_id", F.posexplode_outer("bands").alias("band", "vals"))
        .select("vec_id", "band", F.posexplode_outer("vals").alias("i", "v"))
        .where(F.col("i").isNotNull())
        .select("vec_id", "band", "i", r6(F.col("v")).alias("v"))
    )


@query
def q_masked_mean_pool(spark, sf):
    v = D.vectors(spark, sf).select("label", F.col("embedding").alias("h"), F.when(F.col("vec_id") % 5 != 0, 1).otherwise(0).alias("mask"))
    pooled = S.masked_mean_pool(v, ["label"])
    return pooled.select("label", "dim", r6(F.col("pooled")).alias("pooled"))


def head_weights(spark, labels: int = 16, dims: int = 64, head: str = "patch"):
    """Deterministic head weights: w[j][i] = ((7i + 3j) % 11 - 5) / 10, b[j] = ((5j) % 7 - 3) / 20."""
    j = F.col("id")
    return spark.range(labels).select(
        F.lit(head).alias("head"),
        j.cast("int").alias("label"),
        F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: ((i * 7 + j * 3) % 11 - 5).cast("double") / 10).alias("w"),
        (((j * 5) % 7 - 3).cast("double") / 20).alias("b"),
    )


@query
def q_score_heads(spark, sf):
    W = S.head_matrix(head_weights(spark), "patch")
    v = D.vectors(spark, sf).select("vec_id", "embedding")
    scored = S.score_heads(v, "embedding", {"patch": W})
    return scored.select("vec_id", F.posexplode_outer("patch").alias("label", "score")).where(F.col("label").isNotNull()).select(
        "vec_id", "label", r6(F.col("score")).alias("score")
    )


@query
def q_softmax_ce(spark, sf):
    v = D.vectors(spark, sf)
    z = D.class_scores(F.col("embedding"))
    return v.select(
        "vec_id", F.floor(F.col("vec_id") / 32).alias("batch"), r6(S.softmax_ce(z, F.col("label"))).alias("loss")
    )


def _sig10(x):
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.lit(10.0) * x.cast("double")))


@query
def q_bce_loss(spark, sf):
    v = D.vectors(spark, sf)
    lab = F.col("label")
    p_patch = F.transform(F.slice("embedding", 1, 16), _sig10)
    y_patch = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda j: (j == lab).cast("int"))
    p_answ = F.transform(F.slice("embedding", 17, 48), _sig10)
    y_answ = F.transform(F.sequence(F.lit(0), F.lit(47)), lambda j: ((lab * 5 + j) % 7 == 0).cast("int"))
    rows = v.select(
        F.floor(F.col("vec_id") / 32).alias("batch"),
        S.bce(p_patch, y_patch).alias("lp"),
        S.bce(p_answ, y_answ).alias("la"),
    )
    b = rows.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.avg("lp").alias("lp"), F.avg("la").alias("la"))
    return b.select(
        "batch", "n", r6(F.col("lp")).alias("loss_patch"), r6(F.col("la")).alias("loss_answ"),
        r6(S.weighted_total(F.col("lp"), F.col("la"))).alias("loss"),
    )


@query
def q_epoch_metrics(spark, sf):
    v = D.vectors(spark, sf)
    rows = v.select(
        F.when(F.col("vec_id") % 5 == 0, "val").otherwise("train").alias("split"),
        F.floor(F.col("vec_id") / 32).alias("batch"),
        S.softmax_ce(D.class_scores(F.col("embedding")), F.col("label")).alias("loss"),
    )
    m = S.epoch_metrics(S.batch_losses(rows, ["split", "batch"]), ["split"])
    return m.select("split", r6(F.col("loss")).alias("loss"), r6(F.col("row_mean")).alias("row_mean"), "n_batches", "n_rows")


@query
def q_epoch_record(spark, sf):
    # ten batches of 32 rows are an epoch; every fifth batch is for validation
    v, lab, batch = D.vectors(spark, sf), F.col("label"), F.floor(F.col("vec_id") / 32)
    rows = v.select(
        F.floor(batch / 10).alias("epoch"),
        F.when(batch % 5 == 0, "val").otherwise("train").alias("split"),
        batch.alias("batch"),
        S.bce(F.transform(F.slice("embedding", 1, 16), _sig10), F.transform(F.sequence(F.lit(0), F.lit(15)), lambda j: (j == lab).cast("int"))).alias("lp"),
        S.bce(F.transform(F.slice("embedding", 17, 48), _sig10), F.transform(F.sequence(F.lit(0), F.lit(47)), lambda j: ((lab * 5 + j) % 7 == 0).cast("int"))).alias("la"),
    )
    batches = rows.groupBy("epoch", "split", "batch").agg(F.avg("lp").alias("lp"), F.avg("la").alias("la"))
    out = S.epoch_record(batches, "embeddings", a0=0.25, b0=0.75)
    return out.select("run", "epoch", r6(F.col("train_loss")).alias("train_loss"), r6(F.col("val_loss")).alias("val_loss"))


@query
def q_score_vqa(spark, sf):
    # a label's vectors are its tokens; both heads, 16 and 335 slots
    v = D.vectors(spark, sf).select("label", F.col("embedding").alias("h"), F.when(F.col("vec_id") % 5 != 0, 1).otherwise(0).alias("mask"))
    heads = {name: S.head_matrix(head_weights(spark, n, head=name), name) for name, n in (("patch", K.PATCH_SLOTS), ("answ", K.ANSWER_SLOTS))}
    scored = S.score_vqa(v, ["label"], heads)
    long = scored.select("label", F.explode_outer(F.array(*[F.struct(F.lit(n).alias("head"), F.col(n).alias("p")) for n in heads])).alias("s"))
    long = long.select("label", "s.head", F.posexplode_outer("s.p").alias("slot", "score")).where(F.col("slot").isNotNull())
    return long.select("label", "head", "slot", r6(F.col("score")).alias("score"))


@query
def q_train_heads(spark, sf):
    # both heads, 16 and 335 slots, two epochs; every fifth vector is held out
    slots = {"patch": K.PATCH_SLOTS, "answ": K.ANSWER_SLOTS}
    lab = F.col("label")
    rows = D.vectors(spark, sf).select(
        "embedding",
        F.transform(F.sequence(F.lit(0), F.lit(slots["patch"] - 1)), lambda j: (j == lab).cast("int")).alias("patch"),
        F.transform(F.sequence(F.lit(0), F.lit(slots["answ"] - 1)), lambda j: ((lab * 5 + j) % 7 == 0).cast("int")).alias("answ"),
        (F.col("vec_id") % 5 == 0).alias("val"),
    )
    start = {k: S.head_matrix(head_weights(spark, n, head=k), k) for k, n in slots.items()}
    _, record = T.train_heads(rows, "embedding", {k: k for k in slots}, start, {"patch": 0.25, "answ": 0.75}, epochs=2, rate=0.01, run="embeddings")
    return record.select("run", "epoch", r6(F.col("train_loss")).alias("train_loss"), r6(F.col("val_loss")).alias("val_loss"))


@query
def q_predicted_raster(spark, sf):
    # 44 maps of 8 x 8 logits: class c sees the 64 values rotated by c
    e = F.col("embedding")
    maps = F.transform(F.sequence(F.lit(1), F.lit(K.N_IDS)), lambda c: F.concat(F.slice(e, c, F.lit(65) - c), F.slice(e, 1, c - 1)))
    logits = D.vectors(spark, sf).select(F.col("vec_id").cast("string").alias("img_name"), maps.alias("logits"))
    return G.grid_area_arrow(IM.predicted_rasters(logits, 8, 8))


@query
def q_duplicate_images(spark, sf):
    # names cut by their last two digits: up to a hundred rasters share one
    sup = read_table(spark, sf, "supplier", "s_name")
    return G.duplicate_images(sup.select(F.expr("left(s_name, length(s_name) - 2)").alias("img_name")))


@query
def q_shuffle_batches(spark, sf):
    v = D.vectors(spark, sf).select("vec_id")
    out = B.shuffle_batches(v, 32, [(F.col("vec_id") * 7919) % 1000003, "vec_id"])
    return out.select("vec_id", "pos", "batch")


@query
def q_shuffle_epochs(spark, sf):
    # three epochs in batches of 32
    return B.shuffle_epochs(D.vectors(spark, sf).select("vec_id"), 32, 3, ["vec_id"], seed=7)


# --- pair encoding -----------------------------------------------------------------------
def _encode(spark, sf, max_length):
    conv = read_table(spark, sf, "conversations", "conv_id", "turn", "role", "text", spread_out=True)
    vocab = E.word_vocab(conv)
    enc = E.encode_pairs(E.conversation_pairs(conv), ["conv_id", "turn"], vocab, max_length=max_length)
    return enc.select(
        "conv_id",
        "turn",
        "len_a",
        "len_b",
        F.aggregate("input_ids", F.lit(0).cast("long"), lambda a, v: a + v).alias("id_sum"),
        F.aggregate("attention_mask", F.lit(0), lambda a, v: a + v).alias("mask_sum"),
        F.array_join("input_ids", ",").alias("ids"),
    )


@query
def q_encode_pairs(spark, sf):
    return _encode(spark, sf, K.MAX_LENGTH)


@query
def q_encode_pairs_cut(spark, sf):
    return _encode(spark, sf, 64)


# --- model fitting (no SQL oracle: iterative) --------------------------------------------
@query
def q_fit_heads(spark, sf):
    v = D.vectors(spark, sf)
    # every label that occurs; a label set is small by nature
    names = sorted(r["label"] for r in v.select("label").distinct().collect())
    ex = v.select("embedding", *[(F.col("label") == j).cast("int").alias(f"y{j}") for j in names])
    fits = ML.fit_heads(ex, "embedding", [f"y{j}" for j in names])
    return fits.select("label", "n", "positives", (F.col("loss") < F.col("prior_loss")).alias("beats_prior"))


@query
def q_fit_pixels(spark, sf):
    fits = ML.fit_pixels(ML.pixel_features(D.masks(spark, sf)))
    everything = Window.partitionBy()  # 44 rows, one per class id
    return fits.select("id", "code", "n", (F.sum("correct").over(everything) > F.max("n").over(everything)).alias("beats_majority"))


@query
def q_fit_forest(spark, sf):
    # pixels of every fifth image are held out
    px = ML.pixel_features(D.masks(spark, sf))
    held = F.substring("img_name", -1, 1).isin("0", "5")
    fits = ML.compare_pixel_models(px.where(~held), px.where(held))
    return fits.select("model", "n", "majority", (F.col("correct") > F.col("majority")).alias("beats_majority"))


@query
def q_vqa_examples(spark, sf):
    ex = X.build_examples(
        D.qa(spark, sf),
        G.grid_area(D.masks(spark, sf)),
        L.vocab_map(L.patch_vocab(spark)),
        L.vocab_map(L.answer_vocab(spark), K.PROTECTED_ANSWERS),
        missing="empty",
        empty="keep",
    )
    return ex.select(
        "index",
        "question_type",
        "len_a",
        "len_b",
        L.joined(F.col("input_ids")).alias("ids"),
        L.bits(F.col("attention_mask")).alias("mask"),
        L.bits(F.col("labels_patch").cast("array<int>")).alias("patch_bits"),
        L.bits(F.col("labels_answ").cast("array<int>")).alias("answ_bits"),
    )
