"""Small hand-made cases: shapes, borders, ties and argument errors."""

import numpy as np
import pytest

from pixelframe.functions.checks import checked_kernel
from pixelframe.model import IMAGE_SCHEMA, to_images, to_pixels
from pixelframe.operators import clustering, draw, geometry, histogram, metrics, models, neighbours, point, sampling, selection, stencil
from pixelframe.sources import images as files
from pixelframe.sources.npy import read_npy


def image(spark, values, dtype="u8"):
    a = np.asarray(values, float)
    h, w = a.shape[:2]
    return spark.createDataFrame([(1, 0, h, w, a.shape[2] if a.ndim == 3 else 1, dtype, a.ravel().tolist())], IMAGE_SCHEMA)


def data(rows):
    r = rows.first()
    a = np.array(r["data"]).reshape(r["height"], r["width"], r["n_channels"])
    return a[:, :, 0] if r["n_channels"] == 1 else a


@pytest.fixture(scope="module")
def ramp():
    return np.arange(20).reshape(4, 5) ** 2 % 251


def test_identity_kernel_keeps_image(spark, ramp):
    assert (data(stencil.spatial_filter(image(spark, ramp), [[0, 0, 0], [0, 1, 0], [0, 0, 0]])) == ramp).all()


def test_kernel_is_turned(spark):
    impulse = np.zeros((3, 3))
    impulse[1, 1] = 1
    kernel = [[1, 2, 3], [4, 5, 6], [7, 8, 9]]
    assert (data(stencil.convolve2d(image(spark, impulse), kernel, "constant")) == np.array(kernel)).all()


@pytest.mark.parametrize("mode,numpy_mode", [("reflect", "reflect"), ("replicate", "edge"), ("constant", "constant")])
def test_padding(spark, ramp, mode, numpy_mode):
    assert (data(stencil.pad_image(image(spark, ramp), 2, 1, mode)) == np.pad(ramp, ((2, 2), (1, 1)), mode=numpy_mode)).all()


def test_one_pixel_and_null_images(spark):
    assert data(stencil.median_filter(image(spark, [[9]]))).tolist() == [[9]]
    empty = spark.createDataFrame([(1, 0, 2, 2, 1, "u8", None)], IMAGE_SCHEMA)
    assert stencil.mean_filter(empty).first()["data"] is None
    assert to_pixels(empty).count() == 0
    assert point.validate_images(empty).first()["error"] == "no data"


def test_median_and_mean(spark, ramp):
    p = np.pad(ramp, 1, mode="reflect")
    windows = np.lib.stride_tricks.sliding_window_view(p, (3, 3)).reshape(4, 5, 9)
    assert (data(stencil.median_filter(image(spark, ramp))) == np.median(windows, axis=2)).all()
    assert (data(stencil.mean_filter(image(spark, ramp))) == np.rint(windows.sum(axis=2) / 9)).all()


def test_lbp_ties_count(spark):
    assert data(stencil.lbp_codes(image(spark, [[5] * 3] * 3))).tolist() == [[255] * 3] * 3


def test_rounding_is_half_even(spark):
    half = image(spark, [[0.5 / 255, 1.5 / 255, 2.5 / 255]], "f64")
    assert data(point.to_uint8(half)).tolist() == [[0, 2, 2]]


def test_constant_image_cannot_be_normalised(spark):
    with pytest.raises(Exception, match="without spread"):
        point.normalize(image(spark, [[7, 7]])).collect()
    assert point.normalize(image(spark, [[7, 7]]), strict=False).count() == 0


def test_otsu_takes_first_of_equals(spark):
    assert histogram.otsu_thresholds(image(spark, [[0, 0, 255, 255]])).first()["threshold"] == 0


def test_equalising_a_constant_image(spark):
    assert data(histogram.histogram_equalization(image(spark, [[9, 9]]))).tolist() == [[0, 0]]


def test_upscaling_has_dark_border(spark):
    out = data(geometry.resize(image(spark, [[100, 100], [100, 100]]), 4, 4))
    assert (out[0] == 0).all() and (out[:, 0] == 0).all() and (out[1:, 1:] == 100).all()


def test_zero_moves_keep_image(spark, ramp):
    assert (data(geometry.rotate(image(spark, ramp), 0)) == ramp).all()
    assert (data(geometry.translate(image(spark, ramp), 0, 0)) == ramp).all()


def test_canny_finds_a_step(spark):
    step = np.zeros((8, 8))
    step[:, 4:] = 255
    edges = data(stencil.canny(image(spark, step), 30, 90))
    assert set(np.unique(edges)) == {0, 255} and edges[:, 3:5].any(axis=1).all() and not edges[:, :2].any()


def test_kmeans_separates(spark):
    rows = clustering.kmeans_segment(image(spark, [[1, 2, 200, 201]]), 2, 3)
    assert rows.first()["labels"] == [0, 0, 1, 1] and data(rows).tolist() == [[2, 2, 200, 200]]


def test_kmeans_runs_until_centres_rest(spark):
    values = np.floor(np.random.default_rng(16).uniform(0, 256, 400))
    now, steps, shift = [values.min()], 0, 1.0
    while len(now) < 4:
        now.append(values[np.abs(values[:, None] - now).min(axis=1).argmax()])
    while shift >= 1e-4:
        labels = np.abs(values[:, None] - now).argmin(axis=1)
        new = [values[labels == j].mean() for j in range(4)]
        shift, now, steps = np.linalg.norm(np.subtract(new, now)), new, steps + 1
    assert steps > 10
    got = clustering.kmeans_segment(image(spark, [values.tolist()]), 4).first()
    assert got["labels"] == labels.tolist() and np.allclose([c[0] for c in got["centres"]], now)


def test_drawing(spark):
    blank = np.zeros((5, 5))
    assert data(draw.draw_line(image(spark, blank), 0, 0, 4, 4, 9)).diagonal().tolist() == [9] * 5
    assert data(draw.draw_line(image(spark, blank), -3, 2, -1, 2, 9))[2, 0] == 9  # clamped
    assert data(draw.draw_point(image(spark, blank), 9, 9, 9)).sum() == 0  # cut
    with pytest.raises(TypeError):
        draw.draw_point(image(spark, blank), 1, 1, (1, 2, 3))
    with pytest.raises(ValueError):
        draw.draw_polygon(image(spark, blank), [(1, 1)], 9)


@pytest.mark.parametrize("bad", [[], [[1, 2]], [[1], [2, 3]]])
def test_bad_kernels(bad):
    with pytest.raises(ValueError):
        checked_kernel(bad)


@pytest.mark.parametrize(
    "call",
    [
        lambda x: point.clip_pixels(x, 5, 1),
        lambda x: point.bit_plane_slice(x, 8),
        lambda x: stencil.canny(x, 90, 30),
        lambda x: stencil.threshold_adaptive(x, 4),
        lambda x: stencil.gaussian_filter(x, 3, 0),
        lambda x: stencil.pad_image(x, -1, 0),
        lambda x: geometry.resize(x, 0, 3),
        lambda x: geometry.rotate(x, 3, "cubic"),
        lambda x: point.threshold_global(x, 3, 0),
        lambda x: point.normalize(x, "other"),
    ],
)
def test_bad_arguments(spark, call):
    with pytest.raises(ValueError):
        call(image(spark, [[1, 2]]))


def test_pixels_round_trip(spark):
    rgb = np.arange(24).reshape(2, 4, 3)
    assert (data(to_images(to_pixels(image(spark, rgb)), "u8")) == rgb).all()


def test_png_round_trip(spark, tmp_path):
    rgb = np.arange(24).reshape(2, 4, 3) * 10
    files.write_images(image(spark, rgb), str(tmp_path / "out"))
    assert (data(files.read_images(spark, str(tmp_path / "out"))) == rgb).all()
    gray = files.read_images(spark, str(tmp_path / "out"), as_gray=True)
    assert gray.first()["n_channels"] == 1
    with pytest.raises(ValueError):
        files.write_images(image(spark, rgb), str(tmp_path / "x"), ".gif")


def test_npy(spark, tmp_path):
    a = np.arange(24, dtype=np.uint8).reshape(4, 3, 2)
    np.save(tmp_path / "a.npy", a)
    rows = read_npy(spark, str(tmp_path / "a.npy")).orderBy("row").collect()
    assert [r["data"] for r in rows] == a.reshape(4, 6).astype(float).tolist() and rows[0]["shape"] == [3, 2]


def test_labelled_files(spark, tmp_path):
    for name in ("dog/a.png", "cat/b.png", "cat/c.png"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    rows = files.labelled_files(spark, str(tmp_path)).collect()
    assert sorted((r["class_name"], r["label"]) for r in rows) == [("cat", 0), ("cat", 0), ("dog", 1)]


def test_knn_ties_take_smallest(spark):
    train = spark.createDataFrame([(1, 2, [0.0]), (2, 1, [2.0])], "id long, label int, features array<double>")
    query = spark.createDataFrame([(9, 0, [1.0])], "id long, label int, features array<double>")
    assert neighbours.predict(train, query, 2).first()["y_pred"] == 1
    with pytest.raises(ValueError):
        neighbours.nearest(train.limit(0), query, 1)


def test_metrics_without_support(spark):
    pairs = spark.createDataFrame([(0, 0), (0, 0)], "y_true int, y_pred int")
    rows = {r["cls"]: r["f1"] for r in metrics.class_report(pairs, 2).collect()}
    assert rows == {0: 1.0, 1: 0.0}


def test_split_is_whole(spark):
    rows = spark.range(103).selectExpr("id", "id % 3 as k")
    counts = {r["split"]: r["count"] for r in sampling.stratified_split(rows, "id", "k").groupBy("split").count().collect()}
    assert sum(counts.values()) == 103 and counts["train"] == 82
    with pytest.raises(ValueError):
        sampling.stratified_split(rows, "id", "k", (0.5, 0.1, 0.1))


def test_mrmr_avoids_copies(spark):
    r = np.random.default_rng(0)
    y = r.integers(0, 2, 200)
    a, b = y + 0.3 * r.standard_normal(200), y + 0.3 * r.standard_normal(200)
    rows = spark.createDataFrame([(int(k), [float(u), float(u) + 1e-9, float(v), float(n)]) for k, u, v, n in zip(y, a, b, r.standard_normal(200))], "label int, features array<double>")
    chosen = selection.mrmr(rows, 2)
    assert 2 in chosen and len({0, 1} & set(chosen)) == 1  # of the two copies only one


def test_models_learn(spark):
    r = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, int(i % 2), [float(i % 2) + 0.1 * float(v) for v in r.standard_normal(4)]) for i in range(80)], "id long, label int, features array<double>")
    net = models.SoftmaxModel(4, 2)
    done = models.fit(net, rows, rows, models.adam(0.1), epochs=25)
    assert metrics.accuracy(models.predict(rows, net, done.weights)).first()[0] > 0.95


def test_minibatches_are_whole_and_need_no_job_each(spark, monkeypatch):
    """Every row once an epoch, all minibatches but the last of one size, over several blocks; copies too."""

    class Counting:
        """Loss: the sum of the rows' ids; right: 1 for each minibatch of 10 rows; gradient: the rows."""

        weights = {"W": np.zeros(2)}

        def gradients(self, weights, x, labels):
            assert len(x) == len(labels) and (x[:, 1] == 7).all()
            return float(x[:, 0].sum()), int(len(x) == 10), {"W": np.array([float(len(x)), 0.0])}

    rows = spark.createDataFrame([(i, 0, [float(i // 3), 7.0]) for i in range(203)], "id long, label int, features array<double>")
    total = sum(i // 3 for i in range(203))
    for bytes_a_block in (16 * 30, 16 << 20):
        monkeypatch.setattr(models, "BLOCK_BYTES", bytes_a_block)
        spark.sparkContext.setJobGroup("minibatches", "minibatches")
        steps = models.Rule(1.0, lambda state, w, g: ((state or 0) + 1, w + g / g[0]))
        done = models.fit(Counting(), rows, rows.limit(10), steps, epochs=3, decay=0.0, clip=None, batches=21)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("minibatches"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert [r[1] * 203 for r in done.log] == pytest.approx([total] * 3) and [r[3] * 203 for r in done.log] == pytest.approx([20] * 3)
        assert done.weights["W"][0] == 63  # 21 steps an epoch
        assert jobs < 3 * 21


@pytest.mark.parametrize("net", [models.SoftmaxModel(16, 3), models.ConvModel(4, 2, 3)])
def test_minibatch_steps_follow_each_other(spark, monkeypatch, net):
    """Weights equal those of a plain loop over the same order of rows; large minibatches are summed over tasks."""
    r = np.random.default_rng(4)
    x, y = r.standard_normal((90, 16)), r.integers(0, 3, 90)
    rows = spark.createDataFrame([(i, int(k), v.tolist()) for i, (k, v) in enumerate(zip(y, x))], "id long, label int, features array<double>")
    key = models._dealt(rows)
    dealt = [(a["id"], a["key"]) for a in rows.select("id", models.F.xxhash64(key).alias("key")).collect()]
    base = np.array([i for i, _ in sorted(dealt, key=lambda a: a[1])])
    first, rule = net.weights, models.adam(0.01)
    w, state = models.flattened(first), None
    decayed = models.flattened({k: np.full(v.shape, float(k in ("W", "K"))) for k, v in first.items()})
    for epoch in (1, 2):
        order = base[np.random.default_rng((epoch, 0)).permutation(90)]
        for at in range(0, 90, 9):
            mine = order[at : at + 9]
            g = models.flattened(net.gradients(models.shaped(w, first), x[mine], y[mine])[2])
            state, w = rule.step(state, w, np.clip(g / 9 + 1e-3 * decayed * w, -1, 1))
    done = models.fit(net, rows, rows, rule, epochs=2, batches=10)
    assert np.allclose(models.flattened(done.weights), w)
    monkeypatch.setattr(models, "BLOCK_BYTES", 8)
    far = models.fit(net, rows, rows, rule, epochs=2, batches=2)
    assert far.log[1][1] < far.log[0][1] + 0.5 and all(np.isfinite(v).all() for v in far.weights.values())


def test_softmax_steps_are_those_of_its_gradients():
    """Over runs of minibatches, with a short one last; the loss and right answers too."""
    r = np.random.default_rng(5)
    net, size = models.SoftmaxModel(6, 3), 4
    x, y = r.standard_normal((size * models.RUN * 2 + 3, 6)), r.integers(0, 3, size * models.RUN * 2 + 3)
    w, state, loss, right, rule = models.flattened(net.weights), None, 0.0, 0, models.adam(0.01)
    flat = w.copy()
    for at in range(0, len(y), size):
        a, b, g = net.gradients(models.shaped(w, net.weights), x[at : at + size], y[at : at + size])
        state, w = rule.step(state, w, models.flattened(g) / len(y[at : at + size]))
        loss, right = loss + a, right + b
    _, a, b = net.steps(flat, None, x, y, size, lambda state, w, g, n: rule.step(state, w, g / n))
    assert np.allclose(flat, w) and np.isclose(a, loss) and b == right


def test_stored_features_are_exact():
    """Features that 4 bytes hold take 4, others 8; NaN and values beyond a float's range too."""
    for values, size in (([[0.5, -2.0], [3.0, 1e10]], 4), ([[0.1, 1.0]], 8), ([[1e300, 1.0]], 8), ([[float("nan"), 1.0]], 8)):
        rows = models.pa.table({"label": models.pa.array([1] * len(values), models.pa.int32()), "features": values})
        labels, features = models._chunk(rows)
        x, y = models._numbers({"labels": labels, "features": features}, 2)
        assert len(features) == size * 2 * len(values) and np.array_equal(x, values, equal_nan=True) and y.tolist() == [1] * len(values)


def test_conv_gradients():
    net = models.ConvModel(4, 2, 3)
    r = np.random.default_rng(2)
    x, y = r.standard_normal((5, 16)), np.array([0, 1, 2, 1, 0])
    _, _, g = net.gradients(net.weights, x, y)
    for name in net.weights:
        w = {k: v.copy() for k, v in net.weights.items()}
        w[name].flat[0] += 1e-6
        up = net.gradients(w, x, y)[0]
        w[name].flat[0] -= 2e-6
        assert abs((up - net.gradients(w, x, y)[0]) / 2e-6 - g[name].flat[0]) < 1e-4


def test_jpeg_files_are_read_back_nearly(spark, tmp_path):
    r, c = np.indices((19, 13))
    smooth = np.stack([r * 9, c * 15, (r + c) * 6], axis=2) % 256
    rows = spark.createDataFrame([(1, 0, 19, 13, 3, "u8", smooth.ravel().astype(float).tolist()), (2, 0, 19, 13, 1, "u8", smooth[:, :, 0].ravel().astype(float).tolist()), (3, 0, 1, 1, 1, "f64", [0.5])], IMAGE_SCHEMA)
    files.write_images(rows, str(tmp_path / "out"), ".JPG")
    back = {x["origin"].rsplit("/", 1)[1]: x for x in files.read_images(spark, str(tmp_path / "out")).collect()}
    assert sorted(back) == ["1.jpg", "2.jpg", "3.jpg"] and back["1.jpg"]["n_channels"] == 3 and back["3.jpg"]["data"] == [127.0]
    assert np.abs(np.array(back["1.jpg"]["data"]) - smooth.ravel()).max() <= 16
    assert np.abs(np.array(back["2.jpg"]["data"]) - smooth[:, :, 0].ravel()).max() <= 6
    with pytest.raises(ValueError):
        files.write_images(rows, str(tmp_path / "x"), ".gif")
    with pytest.raises(ValueError):
        files.write_images(rows, str(tmp_path / "x"), ".jpg", 96)


def test_tables_of_files(spark, tmp_path):
    rows = spark.createDataFrame([("a/1.png", "a", 0), ("b/2, 3.png", "b", 1), (None, "c", None)], files.ANNOTATIONS)
    files.write_annotations(rows, str(tmp_path / "csv"))
    assert sorted(map(str, files.read_annotations(spark, str(tmp_path / "csv")).collect())) == sorted(map(str, rows.collect()))
    for k in (1, 2):
        files.append_log(spark.createDataFrame([(k, 0.5)], "epoch int, train_loss double"), str(tmp_path / "log"))
    assert spark.read.csv(str(tmp_path / "log"), header=True).count() == 2
    files.write_json(rows, str(tmp_path / "json"))
    assert files.read_json(spark, str(tmp_path / "json")).count() == 3


def test_arrays_are_written_by_task(spark, tmp_path):
    from pixelframe.sources.npy import write_npy

    write_npy(spark.range(10, numPartitions=3).selectExpr("array(cast(id as double), 1.5D) AS row"), "row", str(tmp_path / "out"))
    found = read_npy(spark, str(tmp_path / "out")).orderBy("row").collect()
    assert [r["row"] for r in found] == list(range(10)) and sorted(r["data"][0] for r in found) == list(map(float, range(10)))


def test_checkpoints(spark, tmp_path):
    weights = {"W": np.arange(6.0).reshape(2, 3), "b": np.array([0.25])}
    models.save_checkpoint(spark, weights, 7, str(tmp_path / "net"))
    found, epoch = models.load_checkpoint(spark, str(tmp_path / "net"), {})
    assert epoch == 7 and all((found[k] == weights[k]).all() for k in weights)
    said = []
    assert models.load_checkpoint(spark, str(tmp_path / "none"), weights, said.append) == (weights, 0) and said
    table = models.weight_table(spark, weights).collect()
    assert len(table) == 7 and {tuple(r["idx"]): r["value"] for r in table if r["param"] == "W"}[(1, 2)] == 5.0


def test_optimisers_follow_their_formulas():
    g, w = np.array([0.5, -2.0]), np.array([1.0, 1.0])
    assert np.allclose(models.descent(0.1).step(None, w, g)[1], w - 0.1 * g)
    rule, state, now, m, v = models.adam(0.01), None, w, 0, 0
    for t in range(1, 4):
        state, now = rule.step(state, now, g)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.01 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    assert np.allclose(now, w)
    weights = {"b": np.array([7.0]), "W": np.arange(4.0).reshape(2, 2)}
    assert all((models.shaped(models.flattened(weights), weights)[k] == weights[k]).all() for k in weights)


def test_reports(spark):
    pairs = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "y_true int, y_pred int")
    assert {r["cls"]: r["accuracy"] for r in metrics.per_class_accuracy(pairs, 2).collect()} == {0: 0.5, 1: 1.0}
    rows = metrics.model_comparison({"a": pairs, "b": pairs.filter("y_true = 1")}, 2).collect()
    assert [r["model"] for r in rows] == ["a", "b"] and rows[1]["accuracy"] == 1.0


def test_images_of_many_shapes_in_one_batch(spark):
    r = np.random.default_rng(4)
    shapes = [(3, 4, 1), (5, 2, 3), (3, 4, 1), (0, 4, 1), (1, 1, 1)]
    rows = [(k, 0, h, w, n, "u8" if k % 2 else "f64", r.integers(0, 256, h * w * n).astype(float).tolist()) for k, (h, w, n) in enumerate(shapes)]
    rows += [(8, 0, 2, 2, 1, "u8", [1.0]), (9, 0, 2, 2, 1, "u8", None)]
    table = spark.createDataFrame(rows, IMAGE_SCHEMA).coalesce(1)
    for op in (lambda x: stencil.gaussian_filter(x), lambda x: geometry.rotate(x, 20), lambda x: geometry.resize(x, 2, 3)):
        together = {x["image_id"]: x for x in op(table).collect()}
        for k in (0, 1, 2, 4):
            assert op(table.filter(f"image_id = {k}")).first() == together[k]
        assert together[8]["data"] is None and together[9]["data"] is None


def test_hysteresis_against_a_flood():
    r = np.random.default_rng(1)
    strong, weak = r.random((6, 12, 12, 1)) > 0.97, r.random((6, 12, 12, 1)) > 0.5
    weak |= strong
    got = stencil.reached(strong, weak)
    for s, w, g in zip(strong[..., 0], weak[..., 0], got[..., 0]):
        keep, left = set(map(tuple, np.argwhere(s))), list(map(tuple, np.argwhere(s)))
        while left:
            y, x = left.pop()
            for p in [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                if 0 <= p[0] < 12 and 0 <= p[1] < 12 and w[p] and p not in keep:
                    keep.add(p)
                    left.append(p)
        assert keep == set(map(tuple, np.argwhere(g)))


def test_neighbours_over_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "TRAIN_ROWS", 7)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 5)
    r = np.random.default_rng(2)
    x = r.integers(0, 4, (40, 3)).astype(float)  # with ties
    rows = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)], "id long, label int, features array<double>")
    got = {}
    for n in neighbours.nearest(rows.filter("id < 25"), rows.filter("id >= 25"), 4).orderBy("id", "rank").collect():
        got.setdefault(n["id"], []).append(n["train_id"])
    for i in range(25, 40):
        d = np.sqrt(((x[:25] - x[i]) ** 2).sum(axis=1))
        assert got[i] == np.lexsort((np.arange(25), d))[:4].tolist()


def test_names_are_numbered_in_order(spark, monkeypatch):
    monkeypatch.setattr(sampling, "SPLITS", 5)
    table = spark.range(60).selectExpr("if(id % 10 = 0, 'b', 'a') AS class_name", "concat('n', id) AS name", "'.png' AS ext")
    got = {r["old_path"]: r["new_path"] for r in sampling.rename_plan(table).collect()}
    for c, ids in (("a", [i for i in range(60) if i % 10]), ("b", range(0, 60, 10))):
        for k, name in enumerate(sorted(f"n{i}" for i in ids)):
            assert got[f"{c}/{name}.png"] == f"{c}/{c}_{k + 1:04d}.png"


def test_workflows(spark, tmp_path):
    from pixelframe.operators import workflow

    ramp = np.arange(48.0).reshape(4, 4, 3) * 5
    images = spark.createDataFrame([(1, 0, 4, 4, 3, "u8", ramp.ravel().tolist()), (2, 1, 4, 4, 1, "u8", [float(k * 9) for k in range(16)]), (3, 1, 4, 4, 1, "u8", [7.0] * 16)], IMAGE_SCHEMA)
    files.write_images(images, str(tmp_path / "x"))
    read = files.read_images(spark, str(tmp_path / "x"))
    paths = spark.createDataFrame([(r["origin"], "c", k) for k, r in enumerate(read.select("origin").orderBy("origin").collect())], files.ANNOTATIONS)
    assert sorted(r["label"] for r in workflow.process_split(paths, read, 4, 4).collect()) == [0, 1]  # the flat image is left out
    done = {r["label"]: r for r in workflow.process_split(paths, read, 16, 16).collect()}  # enlarging gives it a dark border
    assert sorted(done) == [0, 1, 2] and all(r["n_channels"] == 3 and r["height"] == 16 and min(r["data"]) == 0 and max(r["data"]) == 255 for r in done.values())
    rows = workflow.extract_split(workflow.process_split(paths, read, 16, 16), 4).collect()
    assert {r["label"] for r in rows} == {0, 1, 2} and {len(r["features"]) for r in rows} == {703}
    shown = workflow.showcase(images.filter("n_channels = 3")).groupBy("panel").count().collect()
    assert {r["panel"]: r["count"] for r in shown} == {"blurred": 1, "edges": 1, "segments": 1, "equalised": 1, "annotated": 1}


def test_features_of_a_stream(spark, tmp_path):
    from pixelframe.streaming import ingest

    images = spark.createDataFrame([(k, k % 2, 2, 2, 1, "u8", [float(k)] * 4) for k in range(6)] + [(9, 0, 2, 2, 1, "u8", None)], IMAGE_SCHEMA)
    images.repartition(3).write.parquet(str(tmp_path / "in"))
    query = ingest.write_stream(ingest.edge_features(ingest.image_stream(spark, str(tmp_path / "in"), 1)), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination(120)
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.count() == 6 and found.filter("mag_max <> 0").count() == 0


def test_brightness_of_a_stream_by_window(spark, tmp_path):
    from pixelframe.streaming import ingest

    rows = spark.createDataFrame([("2024-01-01 00:01:00", 0, [2.0, 4.0]), ("2024-01-01 00:02:00", 0, [6.0, 8.0]), ("2024-01-01 02:00:00", 1, [1.0])], "at string, label int, data array<double>").selectExpr("cast(at AS timestamp) AS at", "label", "data")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = ingest.write_stream(ingest.brightness_by_label(stream, "at"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination(120)
    # the first window is closed by the watermark of the last row
    assert [(r["label"], r["brightness"], r["n_images"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(0, 5.0, 2)]


def test_files_that_are_no_images(spark, tmp_path):
    (tmp_path / "bad.png").write_bytes(b"no image")
    files.write_images(image(spark, [[1, 2], [3, 4]]), str(tmp_path))
    rows = {r["error"] is None: r for r in files.read_images(spark, str(tmp_path)).collect()}
    assert rows[True]["data"] == [1, 2, 3, 4] and rows[False]["data"] is None and "bad.png" in rows[False]["error"]
    assert files.read_images(spark, str(tmp_path), as_gray=True, drop_invalid=True).count() == 1
    with pytest.raises(TypeError):
        files.read_images(spark, 3)
