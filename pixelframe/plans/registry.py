"""Every registered query of the image engine: (spark, sf_dir) to a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model as m
from ..operators import augment, clustering, descriptors, draw, geometry, histogram, metrics, models, neighbours, point, sampling, selection, stencil, workflow
from ..sources import images as files
from ..sources.npy import read_npy, write_npy
from ..sources.scratch import scratch_path
from .oracle import ORACLES
from .twins import TWINS

ASYMMETRIC = [[1, 2, 0], [0, -1, 3], [2, 0, -4]]
LAYER = np.array([[[[1, 0, -1], [2, 0, -2], [1, 0, -1]]], [[[0, 1, 0], [1, -4, 1], [0, 1, 0]]]], dtype=float)
CLASSES = 10


def px(images: DataFrame, digits: int | None = None) -> DataFrame:
    """Rows of (image_id, ch, r, c, v) of image rows."""
    v = F.col("v") if digits is None else F.round("v", digits)
    return m.to_pixels(images).select("image_id", "ch", "r", "c", (v + 0.0).alias("v"))


def on(view: Callable, op: Callable[[DataFrame], DataFrame], digits: int | None = None) -> Callable:
    return lambda spark, sf_dir: px(op(view(spark, sf_dir)), digits)


def bins(rows: DataFrame, keys: list[str], column: str, digits: int | None = None) -> DataFrame:
    long = rows.select(*keys, F.posexplode_outer(column).alias("bin", "v")).filter("bin IS NOT NULL")
    return long.withColumn("v", F.round("v", digits) + 0.0) if digits is not None else long


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, features, split) of the embeddings; every fifth by md5 order is a query."""
    rows = m.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("features"))
    test = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 4), 16, 10).cast("int") % 5 == 0
    return rows.withColumn("split", F.when(test, "test").otherwise("train"))


def train_test(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = vectors(spark, sf_dir)
    return rows.filter("split = 'train'"), rows.filter("split = 'test'")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.table(spark, sf_dir, "labels").select(F.col("quality").alias("y_true"), F.col("toxic").alias("y_pred"))


def knn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = train_test(spark, sf_dir)
    return neighbours.predict(train, test, 13).join(test.select("id", F.col("label").alias("y_true")), "id")


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("class_name"))


def _sobel(spark, sf_dir):
    rows = stencil.sobel_gradients(m.gray8_u8(spark, sf_dir))
    return m.to_pixels(rows.withColumn("g", F.arrays_zip("gx", "gy", "magnitude", "angle")), "g").select("image_id", "r", "c", (F.col("v.gx") + 0.0).alias("gx"), (F.col("v.gy") + 0.0).alias("gy"), F.round("v.magnitude", 6).alias("magnitude"), F.round("v.angle", 6).alias("angle"))


def _histogram(spark, sf_dir):
    return bins(histogram.histogram(m.gray8_u8(spark, sf_dir), 16), ["image_id"], "counts").withColumnRenamed("v", "n")


def _statistics(spark, sf_dir):
    rows = histogram.pixel_statistics(m.rgb8_u8(spark, sf_dir))
    return rows.select("image_id", "ch", *[(F.round(c, 4) + 0.0).alias(c) for c in histogram.STATS])


def _moments(spark, sf_dir):
    """The statistics of a plain column by group: quantities by return flag, as values of a channel."""
    rows = m.table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.avg("l_quantity").alias("mean"), F.stddev_pop("l_quantity").alias("std"), F.min("l_quantity").alias("min"), F.max("l_quantity").alias("max"), F.sum(F.col("l_quantity") * F.col("l_quantity")).alias("energy"))
    return rows.select("l_returnflag", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max", "energy")])


def _features(spark, sf_dir):
    return bins(descriptors.feature_vectors(m.rgb8_u8(spark, sf_dir), 2), ["image_id"], "features", 6).withColumnRenamed("bin", "feature_idx")


def _selection_rows(spark, sf_dir):
    return vectors(spark, sf_dir).filter("split = 'train'").select("label", "features")


def _relevance(spark, sf_dir):
    return selection.relevance(_selection_rows(spark, sf_dir)).select("feature_idx", F.round("f_stat", 6).alias("f_stat"))


def _mrmr(spark, sf_dir):
    chosen = selection.mrmr(_selection_rows(spark, sf_dir), 10)
    return spark.createDataFrame([(k + 1, i) for k, i in enumerate(chosen)], "rank int, feature_idx int")


def _index64(spark):
    return spark.range(64).select(F.col("id").cast("int").alias("feature_idx"), F.concat(F.lit("fam"), F.expr("id div 16")).alias("family"))


def _chosen(spark, sf_dir):
    return _relevance(spark, sf_dir).orderBy(F.desc("f_stat"), "feature_idx").limit(10)


def _minibatches(train: DataFrame) -> int:
    """How many make about 32 rows each."""
    return max(1, -(-train.count() // 32))


def _softmax(spark, sf_dir):
    train, test = train_test(spark, sf_dir)
    net = models.SoftmaxModel(64, CLASSES)
    done = models.fit(net, train, test, models.adam(0.05), epochs=50, batches=_minibatches(train))
    return spark.createDataFrame(done.log, models.LOG_SCHEMA)


def _cnn(spark, sf_dir):
    train, test = train_test(spark, sf_dir)
    net = models.ConvModel(8, 8, CLASSES)
    done = models.fit(net, train, test, models.adam(0.02), epochs=15, clip=None, patience=5, batches=_minibatches(train))
    return metrics.summary(models.predict(test, net, done.weights), CLASSES)


def _probabilities(spark, sf_dir):
    rows = vectors(spark, sf_dir).withColumn("p", models.softmax_column("features"))
    return bins(rows.select(F.col("id").alias("image_id"), "p"), ["image_id"], "p", 6)


def _kmeans(spark, sf_dir):
    rows = clustering.kmeans_segment(m.gray8_u8(spark, sf_dir), 3, 100, 1e-4)
    return m.to_pixels(rows, "labels", "cluster").select("image_id", "r", "c", "cluster")


def _image_roundtrip(extension: str, most: int) -> Callable:
    """Images written as files and read again: how many values each has, and how many differ by more than `most`."""

    def run(spark, sf_dir):
        images, folder = m.rgb8_u8(spark, sf_dir), scratch_path(spark, "image-files")
        files.write_images(images, folder, extension)
        back = files.read_images(spark, folder).select(F.regexp_extract("origin", r"(\d+)\.[a-z]+$", 1).cast("long").alias("image_id"), F.col("data").alias("back"))
        wrong = F.aggregate(F.zip_with("data", "back", lambda a, b: (F.abs(a - b) > most).cast("int")), F.lit(0), lambda s, x: s + x)
        return images.join(back, "image_id").select("image_id", F.size("back").alias("n_values"), wrong.alias("n_wrong"))

    return run


def _labelled_folder(spark, sf_dir):
    folder, images = scratch_path(spark, "labelled"), m.gray8_u8(spark, sf_dir)
    files.write_labelled(images, folder, F.concat(F.lit("class_"), F.col("label").cast("string")))
    return files.labelled_files(spark, folder).groupBy("class_name", "label").agg(F.count(F.lit(1)).alias("n"))


def _class_names(spark, sf_dir):
    names = spark.range(CLASSES).select(F.col("id").cast("int").alias("label"), F.concat(F.lit("class_"), F.col("id").cast("string")).alias("class_name"))
    return vectors(spark, sf_dir).select("id", "label").join(F.broadcast(names), "label")


def _annotations_csv(spark, sf_dir):
    rows, path = annotations(spark, sf_dir), scratch_path(spark, "annotations")
    labels = rows.select("class_name").distinct().orderBy("class_name").collect()
    label = F.array_position(F.array(*[F.lit(r[0]) for r in labels]), F.col("class_name")).cast("int") - 1
    named = rows.select(F.format_string("%s/img%06d.png", "class_name", "id").alias("image_path"), "class_name", label.alias("label"))
    files.write_annotations(named, path)
    return files.read_annotations(spark, path)


def _training_log(spark, sf_dir):
    path, schema = scratch_path(spark, "training-log"), "epoch int, train_loss double"
    for part in ([1, 2, 3], [4, 5, 6]):
        files.append_log(spark.createDataFrame([(i, i / 4) for i in part], schema), path)
    return spark.read.schema(schema).csv(path, header=True)


def _index_json(spark, sf_dir):
    path = scratch_path(spark, "feature-index")
    files.write_json(descriptors.feature_index(spark), path)
    return files.read_json(spark, path).select(F.col("feature_idx").cast("int").alias("feature_idx"), "name", "family")


def _npy(spark, sf_dir):
    path = scratch_path(spark, "arrays")
    write_npy(m.gray8_u8(spark, sf_dir).select(F.concat(F.array(F.col("image_id").cast("double")), "data").alias("row")), "row", path)
    rows = read_npy(spark, path).select(F.get("data", F.lit(0)).cast("long").alias("image_id"), F.slice("data", 2, m.SIDE * m.SIDE).alias("data"))
    return bins(rows, ["image_id"], "data")


def layer(rows: int, columns: int) -> np.ndarray:
    """Weights by a rule, so that SQL can have the same."""
    f, k = np.indices((rows, columns))
    return ((f * 7 + k * 3) % 11 - 5) / 50.0


def _checkpoint(spark, sf_dir):
    path = scratch_path(spark, "checkpoint")
    models.save_checkpoint(spark, {"W": layer(32, CLASSES)}, 3, path)
    weights, _ = models.load_checkpoint(spark, path, {"W": np.zeros((1, 1))})
    return models.weight_table(spark, weights).select("param", F.col("idx")[0].alias("i"), F.col("idx")[1].alias("j"), "value")


def _cnn_forward(spark, sf_dir):
    net = models.ConvModel(m.SIDE, 2, CLASSES)
    weights = {"K": LAYER.reshape(2, 9), "k": np.array([0.1, -0.1]), "W": layer(32, CLASSES), "b": np.zeros(CLASSES)}
    rows = models.probabilities(vectors(spark, sf_dir), net, weights)
    return bins(rows.select(F.col("id").alias("image_id"), "p"), ["image_id"], "p", 6)


def _comparison(spark, sf_dir):
    rows = pairs(spark, sf_dir)
    swapped = rows.select(F.col("y_pred").alias("y_true"), F.col("y_true").alias("y_pred"))
    return metrics.model_comparison({"labels": rows, "swapped": swapped}, 2).select("model", F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


def totals(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_images"), F.sum(F.aggregate("data", F.lit(0.0), lambda a, v: a + v)).alias("total"))


g8, g8f, g8u, rgb, g64 = m.gray8_u8, m.gray8_f, m.gray8_01, m.rgb8_u8, m.gray64_u8

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    # point operators
    "to_float64": on(g8, point.to_float64, 6),
    "to_uint8": on(g8u, point.to_uint8),
    "normalize_minmax": on(g8, lambda x: point.normalize(x, "minmax", 0, 1, strict=False), 6),
    "normalize_zscore": on(g8, lambda x: point.normalize(x, "zscore", strict=False), 4),
    "normalize_fixed": on(g8, lambda x: point.normalize(x, "fixed", high=255), 6),
    "clip_pixels": on(g8, lambda x: point.clip_pixels(x, 50, 200)),
    "rgb_to_gray": on(rgb, point.rgb_to_gray),
    "gray_to_rgb": on(g8, point.gray_to_rgb),
    "threshold_global": on(g8, lambda x: point.threshold_global(x, 128)),
    "threshold_global_inv": on(g8, lambda x: point.threshold_global(x, 128, invert=True)),
    "bit_plane": on(g8, lambda x: point.bit_plane_slice(x, 5)),
    "brightness": on(g8, lambda x: point.brightness(x, 30)),
    "hflip": on(rgb, point.hflip),
    "channels_first": lambda s, d: bins(point.channels_first(rgb(s, d)), ["image_id"], "data"),
    "finite": on(g8f, point.finite, 6),
    "rectify": on(g8f, lambda x: point.rectify(x.withColumn("data", F.transform("data", lambda v: v * 300)))),
    "display_rescale": on(g8f, point.display_rescale, 4),
    "crop": on(rgb, lambda x: point.crop(x, 2, 1, 4, 5)),
    "salt_and_pepper": on(g8, lambda x: point.salt_and_pepper(x, 0.05, 3)),
    "one_hot": lambda s, d: bins(point.one_hot(m.table(s, d, "embeddings").select("vec_id", "label"), "label", CLASSES), ["vec_id"], "one_hot"),
    "column_subset": lambda s, d: bins(point.column_subset(m.table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")), "embedding", [7, 3, 60]), ["vec_id"], "embedding", 6),
    "validate_images": lambda s, d: point.validate_images(rgb(s, d), allow_rgb=False).groupBy("error").agg(F.count(F.lit(1)).alias("n")),
    # neighbourhood operators
    "pad_reflect": on(g8, lambda x: stencil.pad_image(x, 2, 3, "reflect")),
    "pad_constant": on(g8, lambda x: stencil.pad_image(x, 2, 3, "constant", 7)),
    "pad_replicate": on(g8, lambda x: stencil.pad_image(x, 2, 3, "replicate")),
    "convolve2d": on(g8, lambda x: stencil.convolve2d(x, ASYMMETRIC)),
    "spatial_filter_rgb": on(rgb, lambda x: stencil.spatial_filter(x, ASYMMETRIC)),
    "mean_filter": on(g8, lambda x: stencil.mean_filter(x, 3)),
    "gaussian_filter": on(g8, lambda x: stencil.gaussian_filter(x, 5, 1.0)),
    "median_filter": on(g8, lambda x: stencil.median_filter(x, 3)),
    "sobel": _sobel,
    "threshold_adaptive_mean": on(g8, lambda x: stencil.threshold_adaptive(x, 5, "mean", 2)),
    "threshold_adaptive_gauss": on(g8, lambda x: stencil.threshold_adaptive(x, 5, "gaussian", 2)),
    "canny": on(g8, lambda x: stencil.canny(x, 50, 150)),
    "lbp_codes": on(g8, stencil.lbp_codes),
    "conv_layer": on(g8, lambda x: stencil.cross_correlate(x, LAYER, [1.0, -1.0], 2, 1)),
    "maxpool": on(g8, lambda x: stencil.max_pool(x, 3, 2)),
    "relu": on(g8f, stencil.relu, 6),
    # geometry
    "resize_nearest": on(g8, lambda x: geometry.resize(x, 5, 13, "nearest")),
    "resize_bilinear": on(g8, lambda x: geometry.resize(x, 16, 12)),
    "rotate": on(g8, lambda x: geometry.rotate(x, 15)),
    "translate": on(g8, lambda x: geometry.translate(x, 1.5, -2)),
    # histograms and descriptors
    "histogram": _histogram,
    "color_histogram": lambda s, d: bins(histogram.color_histogram(rgb(s, d), 32), ["image_id", "ch"], "counts", 6),
    "pixel_statistics": _statistics,
    "column_moments": _moments,
    "otsu": lambda s, d: histogram.otsu_thresholds(g8(s, d)),
    "threshold_otsu": on(g8, histogram.threshold_otsu),
    "hist_equalize": on(g8, histogram.histogram_equalization),
    "lbp_descriptor": lambda s, d: bins(histogram.lbp_descriptor(g8(s, d), 64), ["image_id"], "counts", 6),
    "hog_descriptor": lambda s, d: bins(descriptors.hog_descriptor(g8(s, d), 2), ["image_id"], "hog", 4),
    "hog_signed": lambda s, d: bins(descriptors.hog_descriptor(g8(s, d), 2, signed=True), ["image_id"], "hog", 4),
    "sobel_stats": lambda s, d: descriptors.sobel_stats(g8(s, d)).select("image_id", *[F.round(c, 4).alias(c) for c in ("mag_mean", "mag_std", "mag_max")]),
    "spatial_color": lambda s, d: bins(descriptors.spatial_color_histogram(rgb(s, d), m.SIDE, m.SIDE), ["image_id", "quadrant", "ch"], "counts", 6),
    "foreground_by_label": lambda s, d: histogram.foreground_by_label(g8(s, d)).select("label", "n_images", F.round("foreground", 6).alias("foreground")),
    "feature_vector": _features,
    "feature_index": lambda s, d: descriptors.feature_index(s),
    # selection
    "mrmr_relevance": _relevance,
    "mrmr_topk": _mrmr,
    "unselected_features": lambda s, d: selection.unselected(_index64(s), _chosen(s, d)),
    "features_by_name": lambda s, d: selection.named(descriptors.feature_index(s), "fam1", "_R").select("feature_idx", "name"),
    "chosen_features": lambda s, d: selection.members(_index64(s), _chosen(s, d)),
    "family_counts": lambda s, d: selection.family_counts(_index64(s), _chosen(s, d)),
    # nearest neighbours and evaluation
    "knn_neighbours": lambda s, d: neighbours.nearest(*train_test(s, d), 5).select("id", "rank", "train_id", "label", F.round("distance", 6).alias("distance")),
    "knn_predict": lambda s, d: neighbours.predict(*train_test(s, d), 13),
    "knn_sweep": lambda s, d: neighbours.sweep(*train_test(s, d), list(range(1, 16, 2))).select("k", F.round("accuracy", 6).alias("accuracy")),
    "knn_best_k": lambda s, d: metrics.best_by(neighbours.sweep(*train_test(s, d), list(range(1, 16, 2))), "k", "accuracy").select("best_k", F.round("accuracy", 6).alias("accuracy")),
    "confusion_matrix": lambda s, d: metrics.confusion_matrix(knn_pairs(s, d), CLASSES),
    "class_report": lambda s, d: metrics.class_report(pairs(s, d), 2).select("cls", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")]),
    "metrics_summary": lambda s, d: metrics.summary(pairs(s, d), 2).select(*[F.round(c, 6).alias(c) for c in ("accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_precision", "weighted_recall", "weighted_f1")]),
    "per_class_accuracy": lambda s, d: metrics.per_class_accuracy(pairs(s, d), 2).select("cls", F.round("accuracy", 6).alias("accuracy")),
    "model_comparison": _comparison,
    "class_names": _class_names,
    "report_json": lambda s, d: metrics.report_json(pairs(s, d), 2, "labels"),
    # sampling
    "class_distribution": lambda s, d: sampling.class_distribution(annotations(s, d), "class_name"),
    "stratified_downsample": lambda s, d: sampling.stratified_downsample(annotations(s, d), "id", "class_name"),
    "stratified_split": lambda s, d: sampling.stratified_split(annotations(s, d), "id", "class_name"),
    "sample_exact": lambda s, d: sampling.sample_exact(annotations(s, d), "id", 100),
    "shuffle_order": lambda s, d: sampling.ranked(annotations(s, d), "id", ["class_name"]).select("id", "class_name", "rank", "total"),
    "head_rows": lambda s, d: sampling.head(annotations(s, d), "id", 7),
    "tail_rows": lambda s, d: sampling.tail(annotations(s, d), "id", 7),
    "random_choice": lambda s, d: annotations(s, d).select("id", sampling.choice("id", 5, "augment").alias("choice")),
    "rename_plan": lambda s, d: sampling.rename_plan(annotations(s, d).select("class_name", F.format_string("img%06d", "id").alias("name"), F.lit(".png").alias("ext"))),
    # augmentation, clustering, drawing
    "augment": on(g8, lambda x: augment.augmented(x, 40).drop("change"), 6),
    "augment_panel": lambda s, d: totals(augment.panel(g8(s, d)), "change"),
    "feature_panel": lambda s, d: bins(augment.feature_panel(g8(s, d)), ["image_id", "change", "family"], "values", 6),
    "with_augmented": lambda s, d: totals(augment.with_augmented(g8(s, d), 40), "change"),
    "kmeans_segment": _kmeans,
    "draw_point": on(g8, lambda x: draw.draw_point(x, 3, 4, 255, 2)),
    "draw_line": on(g8, lambda x: draw.draw_line(x, 0, 1, 7, 5, 255)),
    "draw_rectangle": on(g8, lambda x: draw.draw_rectangle(x, 1, 2, 5, 4, 200)),
    "draw_rectangle_filled": on(rgb, lambda x: draw.draw_rectangle(x, 5, 5, 9, 9, (10, 20, 30), filled=True, channels=3)),
    "draw_polygon": on(g8, lambda x: draw.draw_polygon(x, [(1, 1), (6, 2), (3, 7)], 255, filled=True)),
    "draw_text": on(g64, lambda x: draw.draw_text(x, "SPARK", 4, 5, 1, 255)),
    # models and files
    "softmax_probs": _probabilities,
    "softmax_train": _softmax,
    "cnn_train": _cnn,
    "cnn_forward": _cnn_forward,
    "image_roundtrip": _image_roundtrip(".png", 0),
    "jpeg_roundtrip": _image_roundtrip(".jpg", 32),
    "labelled_folder": _labelled_folder,
    "annotations_csv": _annotations_csv,
    "training_log_csv": _training_log,
    "feature_index_json": _index_json,
    "npy_roundtrip": _npy,
    "checkpoint_roundtrip": _checkpoint,
    # workflows
    "preprocess": on(g8, lambda x: workflow.preprocess(x, 12, 12)),
    "annotated_splits": lambda s, d: workflow.annotated_splits(annotations(s, d), "id", "class_name"),
    "showcase": lambda s, d: totals(workflow.showcase(rgb(s, d)), "panel"),
}

ORACLES = {k: v for k, v in (ORACLES | TWINS).items() if k in QUERIES}
