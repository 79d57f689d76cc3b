"""DuckDB SQL for composed and iterative queries: features, selection, clustering, augmentation, a network, text and files."""

from __future__ import annotations

from .oracle import BYTE, LBP, LBP_CODES, REPORT, RELEVANCE, SAMPLED, clamped, convolved, gathered, gauss, hog, moments, pixels, rotation, sql

SIDE = 8


def shares(source: str, keys: str, n_bins: int, at: str, top: float = 256) -> str:
    """(image_id, bin, v): shares of equal bins over [0, top), at the place in the vector that `at` gives."""
    of = ", ".join(f"i.{k}" for k in keys.split(", "))
    same = " AND ".join(f"h.{k} = i.{k}" for k in keys.split(", "))
    counts = f"SELECT {keys}, least(floor(v * {n_bins} / {top}), {n_bins - 1}) AS b, count(*) AS n FROM {source} GROUP BY ALL"
    return f"SELECT i.image_id, {at} AS bin, coalesce(h.n, 0) / sum(coalesce(h.n, 0)) OVER (PARTITION BY {of}) AS v FROM (SELECT DISTINCT {keys} FROM {source}) i CROSS JOIN generate_series(0, {n_bins - 1}) g(b) LEFT JOIN ({counts}) h ON {same} AND h.b = g.b"


# the vector: colour 0..95, statistics 96..119, gradients 120..443, their statistics 444..446, patterns 447..510, quarters 511..702
GRAY = "grayc AS (SELECT image_id, 0 AS ch, r, c, round_even(sum(CASE ch WHEN 0 THEN 0.299::DOUBLE * v ELSE 0 END) + sum(CASE ch WHEN 1 THEN 0.587::DOUBLE * v ELSE 0 END) + sum(CASE ch WHEN 2 THEN 0.114::DOUBLE * v ELSE 0 END), 0) AS v FROM rgb8 GROUP BY image_id, r, c), unit AS (SELECT image_id, ch, r, c, v / 255 AS v FROM grayc)"
PATTERNS = f"codesc AS (SELECT d.image_id, d.ch, d.r, d.c, sum(CASE WHEN s.v >= d.v THEN k.bit ELSE 0 END) AS v FROM grayc d CROSS JOIN {LBP} JOIN grayc s ON s.image_id = d.image_id AND s.r = {clamped('d.r + k.dr', SIDE)} AND s.c = {clamped('d.c + k.dc', SIDE)} GROUP BY 1, 2, 3, 4)"
QUARTERS = "quarters AS (SELECT image_id, (r // 4) * 2 + c // 4 AS quadrant, ch, v FROM rgb8)"
FEATURES = " UNION ALL ".join(
    [
        shares("rgb8", "image_id, ch", 32, "i.ch * 32 + g.b"),
        "SELECT s.image_id, 96 + s.ch * 8 + k.i - 1, k.v FROM mom s JOIN ent e USING (image_id, ch), unnest([mean, sd, lo, hi, skew, kurt, energy, h]) WITH ORDINALITY AS k(v, i)",
        "SELECT image_id, 120 + ((yy * 3 + xx) * 4 + cy * 2 + cx) * 9 + b, z FROM three",
        "SELECT image_id, 444 + k.i - 1, k.v FROM (SELECT image_id, avg(magnitude) AS a, stddev_pop(magnitude) AS b, max(magnitude) AS c FROM sobel GROUP BY 1), unnest([a, b, c]) WITH ORDINALITY AS k(v, i)",
        shares("codesc", "image_id", 64, "447 + g.b"),
        shares("quarters", "image_id, quadrant, ch", 16, "511 + (i.quadrant * 3 + i.ch) * 16 + g.b"),
    ]
)


def nearest(v: str, centres: str) -> str:
    d = [f"(({v}) - {centres}[{k}]) * (({v}) - {centres}[{k}])" for k in (1, 2, 3)]
    return f"CASE WHEN {d[0]} <= {d[1]} AND {d[0]} <= {d[2]} THEN 1 WHEN {d[1]} <= {d[2]} THEN 2 ELSE 3 END"


# three centres: the darkest value, the farthest from it, the farthest from both; each row of km is one update of one image
MEANS = "[" + ", ".join(f"coalesce(list_avg(list_filter(vals, lambda v: {nearest('v', 'now')} = {k})), now[{k}])" for k in (1, 2, 3)) + "]"
KMEANS = f"""flatv AS (SELECT image_id, list(v ORDER BY r, c) AS vals FROM gray8 GROUP BY 1),
one AS (SELECT image_id, vals, list_min(vals) AS a FROM flatv),
two AS (SELECT *, list_transform(vals, lambda v: (v - a) * (v - a)) AS gap FROM one),
three_ AS (SELECT image_id, vals, a, vals[list_position(gap, list_max(gap))] AS b FROM two),
four AS (SELECT *, list_transform(vals, lambda v: least((v - a) * (v - a), (v - b) * (v - b))) AS gap FROM three_),
km AS (SELECT image_id, vals, [a, b, vals[list_position(gap, list_max(gap))]] AS before, [a, b, vals[list_position(gap, list_max(gap))]] AS now, 0 AS step, false AS done FROM four
  UNION ALL SELECT image_id, vals, now, new, step + 1, sqrt((new[1] - now[1]) * (new[1] - now[1]) + (new[2] - now[2]) * (new[2] - now[2]) + (new[3] - now[3]) * (new[3] - now[3])) < 1e-4
  FROM (SELECT image_id, vals, now, step, {MEANS} AS new FROM km WHERE step < 100 AND NOT done))"""

# greedy choice of ten features, one table for each step
CORRELATED = f"{RELEVANCE}, numbered AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS f FROM embeddings WHERE CAST('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 4) AS INTEGER) % 5 <> 0), corr AS (SELECT a.f AS i, b.f AS j, abs(corr(a.v, b.v)) AS c FROM numbered a JOIN numbered b USING (vec_id) GROUP BY 1, 2)"
STEPS = ", ".join(
    ["s1 AS (SELECT 1 AS rank, feature_idx FROM rel ORDER BY f_stat DESC, feature_idx LIMIT 1)"]
    + [
        f"s{k} AS (SELECT * FROM s{k - 1} UNION ALL SELECT {k}, feature_idx FROM (SELECT r.feature_idx, any_value(r.f_stat) / greatest(avg(c.c), 1e-3) AS q FROM rel r JOIN corr c ON c.i = r.feature_idx JOIN s{k - 1} s ON s.feature_idx = c.j WHERE r.feature_idx NOT IN (SELECT feature_idx FROM s{k - 1}) GROUP BY 1 ORDER BY q DESC, feature_idx LIMIT 1))"
        for k in range(2, 11)
    ]
)

MOVED = "a.r - {ty}::DOUBLE", "b.c - {tx}::DOUBLE"


def changed(rotate: float, shift: tuple[int, int], blur: tuple[int, float], bright: int) -> dict[str, str]:
    """SQL of (image_id, ch, r, c, v) for each change of gray images."""
    return {
        "rotate": gathered(SIDE, SIDE, *rotation(rotate)),
        "translate": gathered(SIDE, SIDE, MOVED[0].format(ty=shift[1]), MOVED[1].format(tx=shift[0])),
        "blur": f"SELECT image_id, ch, r, c, {BYTE} AS v FROM ({convolved('gray8', gauss(*blur))})",
        "bright": f"SELECT image_id, ch, r, c, least(255, v + {bright}) AS v FROM gray8",
        "flip": f"SELECT image_id, ch, r, {SIDE - 1} - c AS c, v FROM gray8",
    }


TRAINED = changed(15, (10, 10), (3, 1.0), 40)
SHOWN = {"orig": "SELECT image_id, ch, r, c, v FROM gray8"} | changed(17, (5, 10), (5, 1.0), 30)
DRAWN = "drawn AS (SELECT vec_id AS image_id, CAST('0x' || substr(md5('augment' || vec_id), 1, 8) AS BIGINT) % 5 AS k FROM embeddings ORDER BY md5('augment' || vec_id), vec_id LIMIT 40)"
AUGMENTED = " UNION ALL ".join(f"SELECT x.* FROM ({x}) x JOIN drawn d USING (image_id) WHERE d.k = {k}" for k, x in enumerate(TRAINED.values()))

# fixed values: the word drawn by draw_text, seven rows of five bits for each letter and one of space
WORD = """
.####.####...###..####..#...#
#.....#...#.#...#.#...#.#..#.
#.....#...#.#...#.#...#.#.#..
.###..####..#...#.####..##...
....#.#.....#####.#.#...#.#..
....#.#.....#...#.#..#..#..#.
####..#.....#...#.#...#.#...#
""".split()
INK = ", ".join(f"({5 + r}, {4 + c})" for r, row in enumerate(WORD) for c, x in enumerate(row) if x == "#")

# fixed values: the layers of cnn_forward, by the rules that the query uses
FILTERS = [[[1, 0, -1], [2, 0, -2], [1, 0, -1]], [[0, 1, 0], [1, -4, 1], [0, 1, 0]]]
TAPS = ", ".join(f"({o}, {y - 1}, {x - 1}, {w}::DOUBLE)" for o, k in enumerate(FILTERS) for y, row in enumerate(k) for x, w in enumerate(row))
FORWARD = f"""act AS (SELECT d.image_id, k.o, d.r, d.c, greatest(sum(k.w * coalesce(s.v, 0)) + CASE k.o WHEN 0 THEN 0.1::DOUBLE ELSE -0.1::DOUBLE END, 0) AS v FROM gray8_f d CROSS JOIN (VALUES {TAPS}) AS k(o, dy, dx, w) LEFT JOIN gray8_f s ON s.image_id = d.image_id AND s.r = d.r + k.dy AND s.c = d.c + k.dx GROUP BY 1, 2, 3, 4),
pooled AS (SELECT image_id, ((r // 2) * 4 + c // 2) * 2 + o AS f, max(v) AS v FROM act GROUP BY 1, 2),
scored AS (SELECT image_id, g.k, sum(v * (((f * 7 + g.k * 3) % 11 - 5) / 50.0::DOUBLE)) AS z FROM pooled CROSS JOIN generate_series(0, 9) g(k) GROUP BY 1, 2),
high AS (SELECT *, exp(z - max(z) OVER (PARTITION BY image_id)) AS e FROM scored)"""

INDEX = """SELECT CAST(row_number() OVER (ORDER BY part, a, b, c) - 1 AS INTEGER) AS feature_idx, name, family FROM (
SELECT 1 AS part, i AS a, b, 0 AS c, 'fam1a_colorhist_' || x || '_bin' || printf('%02d', b) AS name, 'fam1a' AS family FROM unnest(['R', 'G', 'B']) WITH ORDINALITY AS t(x, i), generate_series(0, 31) g(b)
UNION ALL SELECT 2, i, j, 0, 'fam1b_pixelstat_' || s || '_' || x, 'fam1b' FROM unnest(['R', 'G', 'B']) WITH ORDINALITY AS t(x, i), unnest(['mean', 'std', 'min', 'max', 'skewness', 'kurtosis', 'energy', 'entropy']) WITH ORDINALITY AS u(s, j)
UNION ALL SELECT 3, b, 0, 0, 'fam2a_hog_' || printf('%04d', b), 'fam2a' FROM generate_series(0, 323) g(b)
UNION ALL SELECT 4, j, 0, 0, 'fam2b_sobel_' || s, 'fam2b' FROM unnest(['mag_mean', 'mag_std', 'mag_max']) WITH ORDINALITY AS u(s, j)
UNION ALL SELECT 5, b, 0, 0, 'fam3_lbp_bin' || printf('%02d', b), 'fam3' FROM generate_series(0, 63) g(b)
UNION ALL SELECT 6, q, i, b, 'fam4_spatial_q' || q || '_' || x || '_bin' || printf('%02d', b), 'fam4' FROM generate_series(0, 3) h(q), unnest(['R', 'G', 'B']) WITH ORDINALITY AS t(x, i), generate_series(0, 15) g(b))"""

SCORES = "(SELECT avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END) FROM labels)"
MEANS_OF = "avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1, sum(precision * support) / sum(support) AS weighted_precision, sum(recall * support) / sum(support) AS weighted_recall, sum(f1 * support) / sum(support) AS weighted_f1"

TWINS: dict[str, str] = {
    "feature_vector": sql(
        f"SELECT CAST(image_id AS BIGINT) AS image_id, CAST(bin AS INTEGER) AS feature_idx, round(CAST(v AS DOUBLE), 6) + 0.0 AS v FROM ({FEATURES})",
        f"{GRAY}, {moments('rgb8')}, {hog('unit')}, {PATTERNS}, {QUARTERS}",
    ),
    "feature_index": INDEX,
    "features_by_name": f"SELECT feature_idx, name FROM ({INDEX}) WHERE name LIKE 'fam1%' AND name LIKE '%\\_R%' ESCAPE '\\'",
    "chosen_features": f"WITH {RELEVANCE} SELECT CAST(i AS INTEGER) AS feature_idx, 'fam' || (i // 16) AS family FROM generate_series(0, 63) g(i) WHERE i IN (SELECT feature_idx FROM chosen)",
    "mrmr_topk": f"WITH {CORRELATED}, {STEPS} SELECT CAST(rank AS INTEGER) AS rank, CAST(feature_idx AS INTEGER) AS feature_idx FROM s10",
    "kmeans_segment": sql(
        f"SELECT CAST(image_id AS BIGINT) AS image_id, CAST((i - 1) // 8 AS INTEGER) AS r, CAST((i - 1) % 8 AS INTEGER) AS c, CAST(cluster - 1 AS INTEGER) AS cluster FROM (SELECT image_id, unnest(list_transform(vals, lambda v: {nearest('v', 'before')})) AS cluster, generate_subscripts(vals, 1) AS i FROM (SELECT * FROM km QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY step DESC) = 1))",
        KMEANS,
    ),
    "augment": pixels("v", f"({AUGMENTED})", digits=6, ctes=DRAWN),
    "augment_panel": sql(" UNION ALL ".join(f"SELECT '{k}' AS change, count(DISTINCT image_id) AS n_images, CAST(sum(v) AS DOUBLE) AS total FROM ({x})" for k, x in SHOWN.items())),
    "feature_panel": sql(
        " UNION ALL ".join(
            f"SELECT CAST(image_id AS BIGINT) AS image_id, '{change}' AS change, '{family}' AS family, CAST(bin AS INTEGER) AS bin, round(CAST(v AS DOUBLE), 6) + 0.0 AS v FROM ({shares(source, keys, n, 'g.b')})"
            for change, suffix in (("orig", ""), ("rotate", "_turned"))
            for family, source, keys, n in (("colour", "gray8" + suffix, "image_id", 32), ("patterns", "codes" + suffix, "image_id", 64))
        ),
        f"gray8_turned AS ({TRAINED['rotate']}), {LBP_CODES}, {LBP_CODES.replace('codes AS', 'codes_turned AS').replace('gray8', 'gray8_turned')}",
    ),
    "with_augmented": sql(
        " UNION ALL ".join(["SELECT 'none' AS change, count(DISTINCT image_id) AS n_images, CAST(sum(v) AS DOUBLE) AS total FROM gray8"] + [f"SELECT '{name}', count(DISTINCT image_id), CAST(sum(v) AS DOUBLE) FROM ({x}) JOIN drawn USING (image_id) WHERE k = {k} HAVING count(*) > 0" for k, (name, x) in enumerate(TRAINED.items())]),
        DRAWN,
    ),
    "draw_text": pixels(f"CASE WHEN (r, c) IN ({INK}) THEN 255 ELSE v END", "gray64"),
    "cnn_forward": sql("SELECT CAST(image_id AS BIGINT) AS image_id, CAST(k AS INTEGER) AS bin, round(e / sum(e) OVER (PARTITION BY image_id), 6) + 0.0 AS v FROM high", FORWARD),
    "report_json": f"""WITH {REPORT}, means AS (SELECT {MEANS_OF} FROM report), cells AS (SELECT a.i AS t, b.i AS p, count(l.quality) AS n FROM generate_series(0, 1) a(i) CROSS JOIN generate_series(0, 1) b(i) LEFT JOIN labels l ON l.quality = a.i AND l.toxic = b.i GROUP BY 1, 2)
SELECT CAST(to_json({{'model': 'labels', 'overall_metrics': (SELECT {{'accuracy': round(CAST({SCORES} AS DOUBLE), 6), 'macro_precision': round(macro_precision, 6), 'macro_recall': round(macro_recall, 6), 'macro_f1': round(macro_f1, 6), 'weighted_precision': round(weighted_precision, 6), 'weighted_recall': round(weighted_recall, 6), 'weighted_f1': round(weighted_f1, 6)}} FROM means),
'class_metrics': (SELECT list({{'cls': cls, 'support': support, 'precision': round(precision, 6), 'recall': round(recall, 6), 'f1': round(f1, 6)}} ORDER BY cls) FROM report),
'confusion_matrix': (SELECT list(cells ORDER BY t) FROM (SELECT t, list(n ORDER BY p) AS cells FROM cells GROUP BY t))}}) AS VARCHAR) AS report""",
    "per_class_accuracy": f"WITH {REPORT} SELECT cls, round(recall, 6) AS accuracy FROM report",
    "model_comparison": " UNION ALL ".join(
        f"SELECT '{name}' AS model, (SELECT round(avg(CASE WHEN {t} = {p} THEN 1.0 ELSE 0.0 END), 6) FROM labels) AS accuracy, (SELECT round(avg(f1), 6) FROM (WITH {REPORT.replace('quality', '@').replace('toxic', p).replace('@', t)} SELECT f1 FROM report)) AS macro_f1"
        for name, t, p in (("labels", "quality", "toxic"), ("swapped", "toxic", "quality"))
    ),
    "class_names": "SELECT vec_id AS id, label, 'class_' || label AS class_name FROM embeddings",
    "annotations_csv": f"WITH x AS (SELECT lang || '/img' || printf('%06d', doc_id) || '.png' AS image_path, lang AS class_name, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS label FROM documents) SELECT * FROM x",
    "training_log_csv": "SELECT CAST(i AS INTEGER) AS epoch, i / 4.0::DOUBLE AS train_loss FROM generate_series(1, 6) g(i)",
    "feature_index_json": INDEX,
    "npy_roundtrip": sql("SELECT CAST(image_id AS BIGINT) AS image_id, CAST(r * 8 + c AS INTEGER) AS bin, v FROM gray8"),
    "checkpoint_roundtrip": "SELECT 'W' AS param, CAST(f AS INTEGER) AS i, CAST(k AS INTEGER) AS j, ((f * 7 + k * 3) % 11 - 5) / 50.0::DOUBLE AS value FROM generate_series(0, 31) a(f) CROSS JOIN generate_series(0, 9) b(k)",
    "labelled_folder": sql("SELECT 'class_' || label AS class_name, CAST(dense_rank() OVER (ORDER BY 'class_' || label) - 1 AS INTEGER) AS label, count(*) AS n FROM embeddings GROUP BY embeddings.label"),
    "jpeg_roundtrip": sql("SELECT CAST(image_id AS BIGINT) AS image_id, CAST(count(*) AS INTEGER) AS n_values, CAST(0 AS INTEGER) AS n_wrong FROM rgb8 GROUP BY 1"),
    "preprocess": sql(
        "SELECT CAST(image_id AS BIGINT) AS image_id, CAST(ch AS INTEGER) AS ch, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, round_even(round((v - lo) / (hi - lo) * 255, 9), 0) AS v FROM scaled CROSS JOIN generate_series(0, 2) k(ch) WHERE hi > lo",
        f"big AS ({gathered(12, 12, '(a.r + 0.5::DOUBLE) * (8 / 12.0::DOUBLE) - 0.5::DOUBLE', '(b.c + 0.5::DOUBLE) * (8 / 12.0::DOUBLE) - 0.5::DOUBLE')}), scaled AS (SELECT image_id, r, c, v, min(v) OVER w AS lo, max(v) OVER w AS hi FROM big WINDOW w AS (PARTITION BY image_id))",
    ),
    "annotated_splits": f"WITH counts AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), kept AS (SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {SAMPLED}, doc_id) <= (SELECT min(n) FROM counts)), x AS (SELECT doc_id AS id, lang AS class_name, row_number() OVER (PARTITION BY lang ORDER BY {SAMPLED}, doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM kept) SELECT id, class_name, CASE WHEN k <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN k <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM x",
}
