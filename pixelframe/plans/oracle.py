"""DuckDB SQL for the registered queries, written over pixel rows and independent of the Spark plans."""

from __future__ import annotations

VIEWS = """
raw AS (SELECT vec_id AS image_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
gray8_f AS (SELECT image_id, 0 AS ch, i // 8 AS r, i % 8 AS c, v, label FROM raw),
gray8_01 AS (SELECT image_id, ch, r, c, label, coalesce((v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0), 0) AS v FROM gray8_f WINDOW w AS (PARTITION BY image_id)),
gray8 AS (SELECT image_id, ch, r, c, label, round_even(v * 255, 0) AS v FROM gray8_01),
rgb8 AS (SELECT i.image_id, k.ch, p.i // 8 AS r, p.i % 8 AS c, coalesce(g.v, 0) AS v FROM (SELECT DISTINCT image_id // 3 AS image_id FROM gray8) i CROSS JOIN generate_series(0, 2) k(ch) CROSS JOIN generate_series(0, 63) p(i) LEFT JOIN gray8 g ON g.image_id = i.image_id * 3 + k.ch AND g.r = p.i // 8 AND g.c = p.i % 8),
mosaic AS (SELECT i.image_id, 0 AS ch, k.r, p.c, coalesce(g.v, 0) AS v FROM (SELECT DISTINCT image_id // 64 AS image_id FROM raw) i CROSS JOIN generate_series(0, 63) k(r) CROSS JOIN generate_series(0, 63) p(c) LEFT JOIN raw g ON g.image_id = i.image_id * 64 + k.r AND g.i = p.c),
gray64 AS (SELECT image_id, ch, r, c, round_even(coalesce((v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0), 0) * 255, 0) AS v FROM mosaic WINDOW w AS (PARTITION BY image_id))
"""
PIXEL = "CAST(image_id AS BIGINT) AS image_id, CAST(ch AS INTEGER) AS ch, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c"


def sql(body: str, ctes: str = "") -> str:
    return f"WITH RECURSIVE {VIEWS}{', ' + ctes if ctes else ''}\n{body}"


def pixels(value: str, source: str, where: str = "", digits: int | None = None, ctes: str = "") -> str:
    v = f"CAST({value} AS DOUBLE)"
    v = f"round({v}, {digits})" if digits is not None else v
    return sql(f"SELECT {PIXEL}, {v} + 0.0 AS v FROM {source} {where}", ctes)


def mirrored(i: str, n: int) -> str:
    p = 2 * (n - 1)
    m = f"((({i}) % {p} + {p}) % {p})"
    return f"CASE WHEN {m} < {n} THEN {m} ELSE {p} - {m} END"


def clamped(i: str, n: int) -> str:
    return f"greatest(0, least({n - 1}, {i}))"


def kernel(rows: list[list[float]]) -> str:
    h, w = len(rows) // 2, len(rows[0]) // 2
    values = ", ".join(f"({i - h}, {j - w}, {x}::DOUBLE)" for i, row in enumerate(rows) for j, x in enumerate(row))
    return f"(VALUES {values}) AS k(dr, dc, w)"


def convolved(source: str, rows: list[list[float]], n: int = 8) -> str:
    return (
        f"SELECT d.image_id, d.ch, d.r, d.c, any_value(d.v) AS own, sum(k.w * s.v) AS v FROM {source} d CROSS JOIN {kernel(rows)} "
        f"JOIN {source} s ON s.image_id = d.image_id AND s.ch = d.ch AND s.r = {mirrored('d.r - k.dr', n)} AND s.c = {mirrored('d.c - k.dc', n)} GROUP BY 1, 2, 3, 4"
    )


def neighbours(source: str, size: int, n: int = 8) -> str:
    h = size // 2
    return (
        f"SELECT d.image_id, d.ch, d.r, d.c, list(s.v ORDER BY s.v) AS near FROM {source} d CROSS JOIN (SELECT a.i AS dr, b.i AS dc FROM generate_series({-h}, {h}) a(i), generate_series({-h}, {h}) b(i)) k "
        f"JOIN {source} s ON s.image_id = d.image_id AND s.ch = d.ch AND s.r = {mirrored('d.r + k.dr', n)} AND s.c = {mirrored('d.c + k.dc', n)} GROUP BY 1, 2, 3, 4"
    )


def gauss(size: int, sigma: float) -> list[list[float]]:
    import math

    h = size // 2
    w = [[math.exp(-(x * x + y * y) / (2 * sigma * sigma)) for x in range(-h, h + 1)] for y in range(-h, h + 1)]
    total = sum(map(sum, w))
    return [[x / total for x in row] for row in w]


BYTE = "greatest(0, least(255, round_even(round(v, 9), 0)))"
ASYMMETRIC = [[1, 2, 0], [0, -1, 3], [2, 0, -4]]
SOBEL_X = [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]]
SOBEL_Y = [[-1, -2, -1], [0, 0, 0], [1, 2, 1]]
ONES3, ONES5 = [[1] * 3] * 3, [[1] * 5] * 5
LBP = "(VALUES (-1, -1, 1), (-1, 0, 2), (-1, 1, 4), (0, 1, 8), (1, 1, 16), (1, 0, 32), (1, -1, 64), (0, -1, 128)) AS k(dr, dc, bit)"
LBP_CODES = f"codes AS (SELECT d.image_id, d.ch, d.r, d.c, sum(CASE WHEN s.v >= d.v THEN k.bit ELSE 0 END) AS v FROM gray8 d CROSS JOIN {LBP} JOIN gray8 s ON s.image_id = d.image_id AND s.r = {clamped('d.r + k.dr', 8)} AND s.c = {clamped('d.c + k.dc', 8)} GROUP BY 1, 2, 3, 4)"
def gradient(source: str) -> str:
    """CTEs up to sobel: gradients of the images of source, with magnitude and angle."""
    return (
        f"gx AS ({convolved(source, SOBEL_X)}), gy AS ({convolved(source, SOBEL_Y)}), grad AS (SELECT gx.image_id, gx.r, gx.c, gx.v AS gx, gy.v AS gy, sqrt(gx.v * gx.v + gy.v * gy.v) AS magnitude, degrees(atan2(gy.v + 0.0, gx.v + 0.0)) AS turn FROM gx JOIN gy USING (image_id, r, c)), sobel AS (SELECT image_id, r, c, gx, gy, magnitude, CASE WHEN turn < 0 THEN turn + 180 WHEN turn >= 180 THEN turn - 180 ELSE turn END AS angle FROM grad)"
    )


GRADIENT = gradient("gray8")
OTSU = """counted AS (SELECT image_id, CAST(v AS INTEGER) AS b, count(*) AS n FROM gray8 GROUP BY 1, 2),
spine AS (SELECT i.image_id, g.b, coalesce(n, 0) AS n FROM (SELECT DISTINCT image_id FROM gray8) i CROSS JOIN generate_series(0, 255) g(b) LEFT JOIN counted USING (image_id, b)),
cum AS (SELECT image_id, b, sum(n) OVER w AS n0, sum(n * b) OVER w AS m, sum(n) OVER (PARTITION BY image_id) AS n, sum(n * b) OVER (PARTITION BY image_id) AS mu FROM spine WINDOW w AS (PARTITION BY image_id ORDER BY b ROWS UNBOUNDED PRECEDING)),
var AS (SELECT image_id, b, coalesce((mu::DOUBLE * n0 - m::DOUBLE * n) * (mu::DOUBLE * n0 - m::DOUBLE * n) / nullif(n0::DOUBLE * (n - n0), 0), 0) AS s FROM cum),
otsu AS (SELECT image_id, b AS t FROM var QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY s DESC, b) = 1)"""
SAMPLED = "md5(CAST(doc_id AS VARCHAR))"
VECTORS = "vec AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS f, CAST('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 4) AS INTEGER) % 5 = 0 AS test FROM embeddings), flat AS (SELECT id, label, test, unnest(f) AS v, generate_subscripts(f, 1) AS i FROM vec), dist AS (SELECT q.id, t.id AS train_id, t.label, sqrt(sum((q.v - t.v) * (q.v - t.v))) AS distance FROM flat q JOIN flat t ON q.i = t.i AND q.test AND NOT t.test GROUP BY 1, 2, 3), near AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, train_id) AS rank FROM dist)"
VOTES = "votes AS (SELECT id, k, label, count(*) AS n FROM near JOIN ks ON rank <= k GROUP BY 1, 2, 3), pred AS (SELECT id, k, label AS y_pred FROM votes QUALIFY row_number() OVER (PARTITION BY id, k ORDER BY n DESC, label) = 1)"
SWEEP = f"{VECTORS}, ks AS (SELECT k FROM generate_series(1, 15, 2) g(k)), {VOTES}, acc AS (SELECT k, avg(CASE WHEN y_pred = vec.label THEN 1.0 ELSE 0.0 END) AS accuracy FROM pred JOIN vec USING (id) GROUP BY k)"
RELEVANCE = "flat AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS feature_idx FROM embeddings WHERE CAST('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 4) AS INTEGER) % 5 <> 0), by_class AS (SELECT feature_idx, label, count(*) AS n, avg(v) AS mean FROM flat GROUP BY 1, 2), whole AS (SELECT feature_idx, avg(v) AS mean, count(*) AS n FROM flat GROUP BY 1), between_ AS (SELECT feature_idx, sum(b.n * (b.mean - w.mean) * (b.mean - w.mean)) / (count(*) - 1) AS s, count(*) AS k FROM by_class b JOIN whole w USING (feature_idx) GROUP BY 1), within_ AS (SELECT f.feature_idx, sum((f.v - b.mean) * (f.v - b.mean)) AS s, count(*) AS n FROM flat f JOIN by_class b USING (feature_idx, label) GROUP BY 1), rel AS (SELECT CAST(feature_idx AS INTEGER) AS feature_idx, round(coalesce(b.s / nullif(w.s / (w.n - b.k), 0), 0), 6) AS f_stat FROM between_ b JOIN within_ w USING (feature_idx)), chosen AS (SELECT * FROM rel ORDER BY f_stat DESC, feature_idx LIMIT 10)"
REPORT = "cls AS (SELECT unnest([0, 1]) AS cls), rep AS (SELECT cls, count(*) FILTER (quality = cls) AS support, count(*) FILTER (toxic = cls) AS predicted, count(*) FILTER (quality = cls AND toxic = cls) AS tp FROM cls CROSS JOIN labels GROUP BY cls), pr AS (SELECT cls, support, coalesce(tp / nullif(predicted, 0), 0)::DOUBLE AS precision, coalesce(tp / nullif(support, 0), 0)::DOUBLE AS recall FROM rep), report AS (SELECT cls, support, precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM pr)"


def gathered(height: int, width: int, y: str, x: str, nearest: bool = False) -> str:
    """Inverse-mapped samples of gray8: y and x are the source place of (r, c)."""
    places = f"SELECT i.image_id, 0 AS ch, a.r, b.c, ({y}) AS y, ({x}) AS x FROM (SELECT DISTINCT image_id FROM gray8) i CROSS JOIN generate_series(0, {height - 1}) a(r) CROSS JOIN generate_series(0, {width - 1}) b(c)"
    if nearest:
        return f"SELECT p.image_id, p.ch, p.r, p.c, coalesce(s.v, 0) AS v FROM ({places}) p LEFT JOIN gray8 s ON s.image_id = p.image_id AND s.r = round_even(p.y, 0) AND s.c = round_even(p.x, 0)"
    corners = "(VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS k(a, b)"
    weight = "(CASE WHEN k.a = 1 THEN p.y - floor(p.y) ELSE 1 - (p.y - floor(p.y)) END) * (CASE WHEN k.b = 1 THEN p.x - floor(p.x) ELSE 1 - (p.x - floor(p.x)) END)"
    inside = "p.y >= 0 AND p.y < 8 AND p.x >= 0 AND p.x < 8"
    return f"SELECT p.image_id, p.ch, p.r, p.c, CASE WHEN any_value({inside}) THEN greatest(0, least(255, round_even(round(coalesce(sum(s.v * {weight}), 0), 9), 0))) ELSE 0 END AS v FROM ({places}) p CROSS JOIN {corners} LEFT JOIN gray8 s ON s.image_id = p.image_id AND s.r = least(7, floor(p.y) + k.a) AND s.c = least(7, floor(p.x) + k.b) GROUP BY 1, 2, 3, 4"


def rotation(angle: float) -> tuple[str, str]:
    import math

    t = math.radians(-angle)
    cos, sin = f"{math.cos(t)!r}::DOUBLE", f"({math.sin(t)!r}::DOUBLE)"
    return f"{cos} * (a.r - 3.5::DOUBLE) - {sin} * (b.c - 3.5::DOUBLE) + 3.5::DOUBLE", f"{sin} * (a.r - 3.5::DOUBLE) + {cos} * (b.c - 3.5::DOUBLE) + 3.5::DOUBLE"


def padded(place: str | None, constant: int = 0) -> str:
    source = place if place else "i"
    r, c = ("a.r - 2", "b.c - 3")
    at = (mirrored(r, 8), mirrored(c, 8)) if source == "mirror" else (clamped(r, 8), clamped(c, 8)) if source == "clamp" else (r, c)
    return f"(SELECT i.image_id, 0 AS ch, a.r, b.c, coalesce(s.v, {constant}) AS v FROM (SELECT DISTINCT image_id FROM gray8) i CROSS JOIN generate_series(0, 11) a(r) CROSS JOIN generate_series(0, 13) b(c) LEFT JOIN gray8 s ON s.image_id = i.image_id AND s.r = {at[0]} AND s.c = {at[1]})"


def dense(source: str, keys: str, n_bins: int, top: float = 256, as_share: bool = True) -> str:
    """Counts of gray or colour values by bin, with all bins."""
    on_keys = " AND ".join(f"h.{k} = i.{k}" for k in keys.split(", "))
    counts = f"SELECT {keys}, least(floor(v * {n_bins} / {top}), {n_bins - 1}) AS b, count(*) AS n FROM {source} GROUP BY ALL"
    value = f"round(coalesce(h.n, 0) / sum(coalesce(h.n, 0)) OVER (PARTITION BY {', '.join('i.' + k for k in keys.split(', '))}), 6)" if as_share else "coalesce(h.n, 0)"
    cast = ", ".join(f"CAST(i.{k} AS {'BIGINT' if k == 'image_id' else 'INTEGER'}) AS {k}" for k in keys.split(", "))
    return f"SELECT {cast}, CAST(g.b AS INTEGER) AS bin, {value} AS {'v' if as_share else 'n'} FROM (SELECT DISTINCT {keys} FROM {source}) i CROSS JOIN generate_series(0, {n_bins - 1}) g(b) LEFT JOIN ({counts}) h ON {on_keys} AND h.b = g.b"


def moments(source: str) -> str:
    """CTEs mom and ent: population moments and the entropy of each channel."""
    return (
        f"base AS (SELECT *, avg(v) OVER w AS mean, stddev_pop(v) OVER w AS sd FROM {source} WINDOW w AS (PARTITION BY image_id, ch)), mom AS (SELECT image_id, ch, any_value(mean) AS mean, any_value(sd) AS sd, min(v) AS lo, max(v) AS hi, coalesce(avg(power((v - mean) / nullif(sd, 0), 3)), 0) AS skew, coalesce(avg(power((v - mean) / nullif(sd, 0), 4)) - 3, 0) AS kurt, sum(v * v) AS energy FROM base GROUP BY 1, 2), ent AS (SELECT image_id, ch, -sum(n / t * log2(n / t)) AS h FROM (SELECT image_id, ch, v, count(*) AS n, sum(count(*)) OVER (PARTITION BY image_id, ch) AS t FROM {source} GROUP BY 1, 2, 3) GROUP BY 1, 2)"
    )


def hog(source: str, width: int = 20) -> str:
    """CTEs up to three: block-normalised gradient histograms of cells of two pixels."""
    return f"""{gradient(source)},
votes AS (SELECT image_id, r // 2 AS cy, c // 2 AS cx, CAST(floor(angle / {width}) AS INTEGER) % 9 AS b, magnitude * (1 - (angle / {width} - floor(angle / {width}))) AS v FROM sobel
  UNION ALL SELECT image_id, r // 2, c // 2, (CAST(floor(angle / {width}) AS INTEGER) + 1) % 9, magnitude * (angle / {width} - floor(angle / {width})) FROM sobel),
cells AS (SELECT image_id, cy, cx, b, sum(v) AS v FROM votes GROUP BY ALL),
places AS (SELECT i.image_id, y.i AS yy, x.i AS xx, a.i AS cy, d.i AS cx, g.i AS b FROM (SELECT DISTINCT image_id FROM {source}) i, generate_series(0, 2) y(i), generate_series(0, 2) x(i), generate_series(0, 1) a(i), generate_series(0, 1) d(i), generate_series(0, 8) g(i)),
blocks AS (SELECT p.*, coalesce(c.v, 0) AS v FROM places p LEFT JOIN cells c ON c.image_id = p.image_id AND c.cy = p.yy + p.cy AND c.cx = p.xx + p.cx AND c.b = p.b),
one AS (SELECT *, coalesce(v / nullif(sqrt(sum(v * v) OVER (PARTITION BY image_id, yy, xx)), 0), v) AS u FROM blocks),
two AS (SELECT *, least(u, 0.2) AS t FROM one),
three AS (SELECT *, coalesce(t / nullif(sqrt(sum(t * t) OVER (PARTITION BY image_id, yy, xx)), 0), t) AS z FROM two)"""


HOG = hog("gray8")

CANNY = f"""blur AS (SELECT image_id, ch, r, c, {BYTE} AS v FROM ({convolved('gray8', gauss(5, 1.4), 8)})),
cx AS ({convolved('blur', SOBEL_X, 8)}), cy AS ({convolved('blur', SOBEL_Y, 8)}),
cg AS (SELECT cx.image_id, cx.r, cx.c, sqrt(cx.v * cx.v + cy.v * cy.v) AS mag, degrees(atan2(cy.v + 0.0, cx.v + 0.0)) AS t FROM cx JOIN cy USING (image_id, r, c)),
binned AS (SELECT image_id, r, c, mag, CAST(floor(((CASE WHEN t < 0 THEN t + 180 WHEN t >= 180 THEN t - 180 ELSE t END) + 22.5) / 45) AS INTEGER) % 4 AS q FROM cg),
steps AS (SELECT * FROM (VALUES (0, 0, 1), (1, 1, 1), (2, 1, 0), (3, 1, -1)) AS s(q, dr, dc)),
thin AS (SELECT b.image_id, b.r, b.c, CASE WHEN b.mag >= o.mag AND b.mag >= p.mag THEN b.mag ELSE 0 END AS mag FROM binned b JOIN steps s USING (q)
  JOIN binned o ON o.image_id = b.image_id AND o.r = {clamped('b.r + s.dr', 8)} AND o.c = {clamped('b.c + s.dc', 8)}
  JOIN binned p ON p.image_id = b.image_id AND p.r = {clamped('b.r - s.dr', 8)} AND p.c = {clamped('b.c - s.dc', 8)}),
edge AS (SELECT image_id, r, c FROM thin WHERE mag >= 150 UNION SELECT t.image_id, t.r, t.c FROM edge e CROSS JOIN (VALUES (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)) AS o(dr, dc) JOIN thin t ON t.image_id = e.image_id AND t.r = e.r + o.dr AND t.c = e.c + o.dc WHERE t.mag >= 50)"""

FIXED_LAYER = [[[1, 0, -1], [2, 0, -2], [1, 0, -1]], [[0, 1, 0], [1, -4, 1], [0, 1, 0]]]
LAYER_VALUES = ", ".join(f"({o}, {i}, {j}, {x}::DOUBLE)" for o, k in enumerate(FIXED_LAYER) for i, row in enumerate(k) for j, x in enumerate(row))

ORACLES: dict[str, str] = {
    "to_float64": pixels("v / 255", "gray8", digits=6),
    "to_uint8": pixels("v", "gray8"),
    "normalize_minmax": pixels("(v - lo) / (hi - lo)", "(SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi FROM gray8 WINDOW w AS (PARTITION BY image_id))", "WHERE hi > lo", 6),
    "normalize_zscore": pixels("(v - mean) / sd", "(SELECT *, avg(v) OVER w AS mean, stddev_pop(v) OVER w AS sd FROM gray8 WINDOW w AS (PARTITION BY image_id))", "WHERE sd > 0", 4),
    "normalize_fixed": pixels("v / 255", "gray8", digits=6),
    "clip_pixels": pixels("greatest(50, least(200, v))", "gray8"),
    "rgb_to_gray": pixels("v", "(SELECT image_id, 0 AS ch, r, c, round_even(sum(CASE ch WHEN 0 THEN 0.299::DOUBLE * v ELSE 0 END) + sum(CASE ch WHEN 1 THEN 0.587::DOUBLE * v ELSE 0 END) + sum(CASE ch WHEN 2 THEN 0.114::DOUBLE * v ELSE 0 END), 0) AS v FROM rgb8 GROUP BY image_id, r, c)"),
    "gray_to_rgb": pixels("v", "(SELECT image_id, unnest([0, 1, 2]) AS ch, r, c, v FROM gray8)"),
    "threshold_global": pixels("CASE WHEN v > 128 THEN 255 ELSE 0 END", "gray8"),
    "threshold_global_inv": pixels("CASE WHEN v <= 128 THEN 255 ELSE 0 END", "gray8"),
    "bit_plane": pixels("CASE WHEN (CAST(v AS INTEGER) // 32) % 2 = 1 THEN 255 ELSE 0 END", "gray8"),
    "brightness": pixels("least(255, v + 30)", "gray8"),
    "hflip": pixels("v", "(SELECT image_id, ch, r, 7 - c AS c, v FROM rgb8)"),
    "channels_first": sql("SELECT CAST(image_id AS BIGINT) AS image_id, CAST(ch * 64 + r * 8 + c AS INTEGER) AS bin, v FROM rgb8"),
    "finite": pixels("CASE WHEN isfinite(v) THEN v ELSE 0 END", "gray8_f", digits=6),
    "rectify": pixels("floor(least(255, abs(v * 300)))", "gray8_f"),
    "display_rescale": pixels("(v - lo) / (hi - lo + 1e-8)", "(SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi FROM gray8_f WINDOW w AS (PARTITION BY image_id))", digits=4),
    "crop": pixels("v", "(SELECT image_id, ch, r - 2 AS r, c - 1 AS c, v FROM rgb8 WHERE r BETWEEN 2 AND 5 AND c BETWEEN 1 AND 5)"),
    "salt_and_pepper": pixels("CASE WHEN h < 0.05 THEN 255 WHEN h < 0.1 THEN 0 ELSE v END", "(SELECT *, CAST('0x' || substr(md5('3-' || image_id || '-' || (r * 8 + c)), 1, 6) AS INTEGER) / 16777216.0::DOUBLE AS h FROM gray8)"),
    "one_hot": "SELECT vec_id, CAST(k AS INTEGER) AS bin, CAST(label = k AS INTEGER) AS v FROM embeddings CROSS JOIN generate_series(0, 9) g(k)",
    "column_subset": "SELECT vec_id, CAST(bin AS INTEGER) AS bin, round(embedding[k.place]::DOUBLE, 6) + 0.0 AS v FROM embeddings CROSS JOIN (VALUES (0, 8), (1, 4), (2, 61)) AS k(bin, place)",
    "validate_images": sql("SELECT 'colour is not allowed' AS error, count(DISTINCT image_id) AS n FROM rgb8"),
    "pad_reflect": pixels("v", padded("mirror")),
    "pad_constant": pixels("v", padded(None, 7)),
    "pad_replicate": pixels("v", padded("clamp")),
    "convolve2d": pixels("v", f"({convolved('gray8', ASYMMETRIC)})"),
    "spatial_filter_rgb": pixels(BYTE, f"({convolved('rgb8', ASYMMETRIC)})"),
    "mean_filter": pixels("round_even(round(v / 9, 9), 0)", f"({convolved('gray8', ONES3)})"),
    "gaussian_filter": pixels(BYTE, f"({convolved('gray8', gauss(5, 1.0))})"),
    "median_filter": pixels("near[5]", f"({neighbours('gray8', 3)})"),
    "sobel": sql("SELECT CAST(image_id AS BIGINT) AS image_id, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, gx + 0.0 AS gx, gy + 0.0 AS gy, round(magnitude, 6) AS magnitude, round(angle, 6) AS angle FROM sobel", GRADIENT),
    "threshold_adaptive_mean": pixels("CASE WHEN own > round(v / 25, 9) - 2 THEN 255 ELSE 0 END", f"({convolved('gray8', ONES5)})"),
    "threshold_adaptive_gauss": pixels("CASE WHEN own > round(v, 9) - 2 THEN 255 ELSE 0 END", f"({convolved('gray8', gauss(5, 0.3 * ((5 - 1) / 2 - 1) + 0.8))})"),
    "canny": sql("SELECT CAST(g.image_id AS BIGINT) AS image_id, CAST(0 AS INTEGER) AS ch, CAST(g.r AS INTEGER) AS r, CAST(g.c AS INTEGER) AS c, CASE WHEN e.r IS NULL THEN 0.0::DOUBLE ELSE 255.0::DOUBLE END AS v FROM gray8 g LEFT JOIN edge e ON e.image_id = g.image_id AND e.r = g.r AND e.c = g.c", CANNY),
    "lbp_codes": pixels("v", "codes", ctes=LBP_CODES),
    "conv_layer": pixels("v", f"(SELECT d.image_id, k.o AS ch, d.r, d.c, sum(k.w * coalesce(s.v, 0)) + (CASE k.o WHEN 0 THEN 1 ELSE -1 END) AS v FROM (SELECT i.image_id, a.r, b.c FROM (SELECT DISTINCT image_id FROM gray8) i, generate_series(0, 3) a(r), generate_series(0, 3) b(c)) d CROSS JOIN (VALUES {LAYER_VALUES}) AS k(o, i, j, w) LEFT JOIN gray8 s ON s.image_id = d.image_id AND s.r = d.r * 2 + k.i - 1 AND s.c = d.c * 2 + k.j - 1 GROUP BY 1, 2, 3, 4)"),
    "maxpool": pixels("v", "(SELECT d.image_id, 0 AS ch, a.r, b.c, max(d.v) AS v FROM gray8 d JOIN generate_series(0, 2) a(r) ON d.r BETWEEN a.r * 2 AND a.r * 2 + 2 JOIN generate_series(0, 2) b(c) ON d.c BETWEEN b.c * 2 AND b.c * 2 + 2 GROUP BY 1, 2, 3, 4)"),
    "relu": pixels("greatest(v, 0)", "gray8_f", digits=6),
    "resize_nearest": pixels("v", f"({gathered(5, 13, '(a.r + 0.5::DOUBLE) * (8 / 5.0::DOUBLE) - 0.5::DOUBLE', '(b.c + 0.5::DOUBLE) * (8 / 13.0::DOUBLE) - 0.5::DOUBLE', True)})"),
    "resize_bilinear": pixels("v", f"({gathered(16, 12, '(a.r + 0.5::DOUBLE) * (8 / 16.0::DOUBLE) - 0.5::DOUBLE', '(b.c + 0.5::DOUBLE) * (8 / 12.0::DOUBLE) - 0.5::DOUBLE')})"),
    "rotate": pixels("v", f"({gathered(8, 8, *rotation(15))})"),
    "translate": pixels("v", f"({gathered(8, 8, 'a.r + 2.0::DOUBLE', 'b.c - 1.5::DOUBLE')})"),
    "histogram": sql(dense("gray8", "image_id", 16, as_share=False)),
    "color_histogram": sql(dense("rgb8", "image_id, ch", 32)),
    "pixel_statistics": sql(
        "SELECT CAST(s.image_id AS BIGINT) AS image_id, CAST(s.ch AS INTEGER) AS ch, round(mean, 4) AS mean, round(sd, 4) AS std, lo AS min, hi AS max, round(skew, 4) + 0.0 AS skewness, round(kurt, 4) + 0.0 AS kurtosis, round(energy, 4) AS energy, round(h, 4) + 0.0 AS entropy FROM mom s JOIN ent e USING (image_id, ch)",
        moments("rgb8"),
    ),
    "column_moments": "SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std, min(l_quantity) AS min, max(l_quantity) AS max, round(sum(l_quantity * l_quantity), 6) AS energy FROM lineitem GROUP BY 1",
    "otsu": sql("SELECT CAST(image_id AS BIGINT) AS image_id, CAST(t AS INTEGER) AS threshold FROM otsu", OTSU),
    "threshold_otsu": pixels("CASE WHEN v > t THEN 255 ELSE 0 END", "gray8 JOIN otsu USING (image_id)", ctes=OTSU),
    "hist_equalize": pixels(
        "greatest(0, least(255, round_even(round(255 * (x - lo) / greatest(1 - lo, 1e-9), 9), 0)))",
        "(SELECT g.image_id, g.ch, g.r, g.c, e.x, e.lo FROM gray8 g JOIN (SELECT image_id, b, n0::DOUBLE / n AS x, min(n0::DOUBLE / n) FILTER (n0 > 0) OVER (PARTITION BY image_id) AS lo FROM cum) e ON e.image_id = g.image_id AND e.b = g.v)",
        ctes=OTSU,
    ),
    "lbp_descriptor": sql(dense("codes", "image_id", 64), LBP_CODES),
    "hog_descriptor": sql("SELECT CAST(image_id AS BIGINT) AS image_id, CAST(((yy * 3 + xx) * 4 + cy * 2 + cx) * 9 + b AS INTEGER) AS bin, round(z, 4) + 0.0 AS v FROM three", HOG),
    "hog_signed": sql("SELECT CAST(image_id AS BIGINT) AS image_id, CAST(((yy * 3 + xx) * 4 + cy * 2 + cx) * 9 + b AS INTEGER) AS bin, round(z, 4) + 0.0 AS v FROM three", hog("gray8", 40)),
    "sobel_stats": sql("SELECT CAST(image_id AS BIGINT) AS image_id, round(avg(magnitude), 4) AS mag_mean, round(stddev_pop(magnitude), 4) AS mag_std, round(max(magnitude), 4) AS mag_max FROM sobel GROUP BY 1", GRADIENT),
    "spatial_color": sql(dense("quarters", "image_id, quadrant, ch", 16), "quarters AS (SELECT image_id, (r // 4) * 2 + c // 4 AS quadrant, ch, v FROM rgb8)"),
    "foreground_by_label": sql("SELECT CAST(label AS INTEGER) AS label, count(DISTINCT image_id) AS n_images, round(avg(CASE WHEN v > t THEN 1.0 ELSE 0.0 END), 6) AS foreground FROM gray8 JOIN otsu USING (image_id) GROUP BY label", OTSU),
    "mrmr_relevance": f"WITH {RELEVANCE} SELECT feature_idx, f_stat FROM rel",
    "unselected_features": f"WITH {RELEVANCE} SELECT CAST(i AS INTEGER) AS feature_idx FROM generate_series(0, 63) g(i) WHERE i NOT IN (SELECT feature_idx FROM chosen)",
    "family_counts": f"WITH {RELEVANCE} SELECT 'fam' || (i // 16) AS family, count(feature_idx) AS n FROM generate_series(0, 63) g(i) LEFT JOIN chosen ON feature_idx = i GROUP BY 1",
    "knn_neighbours": f"WITH {VECTORS} SELECT id, CAST(rank AS INTEGER) AS rank, train_id, label, round(distance, 6) AS distance FROM near WHERE rank <= 5",
    "knn_predict": f"WITH {VECTORS}, ks AS (SELECT 13 AS k), {VOTES} SELECT id, y_pred FROM pred",
    "knn_sweep": f"WITH {SWEEP} SELECT CAST(k AS INTEGER) AS k, round(accuracy, 6) AS accuracy FROM acc",
    "knn_best_k": f"WITH {SWEEP} SELECT CAST(k AS INTEGER) AS best_k, round(accuracy, 6) AS accuracy FROM acc ORDER BY accuracy DESC, k LIMIT 1",
    "confusion_matrix": f"WITH {VECTORS}, ks AS (SELECT 13 AS k), {VOTES} SELECT CAST(a.i AS INTEGER) AS y_true, CAST(b.i AS INTEGER) AS y_pred, count(p.id) AS n FROM generate_series(0, 9) a(i) CROSS JOIN generate_series(0, 9) b(i) LEFT JOIN (SELECT pred.id, vec.label AS y_true, y_pred FROM pred JOIN vec USING (id)) p ON p.y_true = a.i AND p.y_pred = b.i GROUP BY 1, 2",
    "class_report": f"WITH {REPORT} SELECT cls, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM report",
    "metrics_summary": f"WITH {REPORT} SELECT (SELECT round(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END), 6) FROM labels) AS accuracy, round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1, round(sum(precision * support) / sum(support), 6) AS weighted_precision, round(sum(recall * support) / sum(support), 6) AS weighted_recall, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM report",
    "class_distribution": "SELECT lang AS class_name, count(*) AS n FROM documents GROUP BY 1",
    "stratified_downsample": f"SELECT doc_id AS id, lang AS class_name FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {SAMPLED}, doc_id) <= (SELECT min(n) FROM (SELECT count(*) AS n FROM documents GROUP BY lang))",
    "stratified_split": f"WITH x AS (SELECT doc_id AS id, lang AS class_name, row_number() OVER (PARTITION BY lang ORDER BY {SAMPLED}, doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT id, class_name, CASE WHEN k <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN k <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM x",
    "sample_exact": f"SELECT doc_id AS id, lang AS class_name FROM documents ORDER BY {SAMPLED}, doc_id LIMIT 100",
    "shuffle_order": f"SELECT doc_id AS id, lang AS class_name, row_number() OVER (PARTITION BY lang ORDER BY {SAMPLED}, doc_id) AS rank, count(*) OVER (PARTITION BY lang) AS total FROM documents",
    "head_rows": "SELECT doc_id AS id, lang AS class_name FROM documents ORDER BY doc_id LIMIT 7",
    "tail_rows": "SELECT doc_id AS id, lang AS class_name FROM documents ORDER BY doc_id DESC LIMIT 7",
    "random_choice": "SELECT doc_id AS id, CAST(CAST('0x' || substr(md5('augment' || doc_id), 1, 8) AS BIGINT) % 5 AS INTEGER) AS choice FROM documents",
    "rename_plan": "SELECT lang || '/' || name || '.png' AS old_path, lang || '/' || lang || '_' || printf('%04d', k) || '.png' AS new_path FROM (SELECT lang, printf('img%06d', doc_id) AS name, row_number() OVER (PARTITION BY lang ORDER BY printf('img%06d', doc_id)) AS k FROM documents)",
    "draw_point": pixels("CASE WHEN (r - 4) * (r - 4) + (c - 3) * (c - 3) <= 4 THEN 255 ELSE v END", "gray8"),
    "draw_line": pixels("CASE WHEN EXISTS (SELECT 1 FROM line WHERE y = r AND x = c) THEN 255 ELSE v END", "gray8", ctes="line AS (SELECT 0 AS x, 1 AS y, 3 AS e UNION ALL SELECT x + CASE WHEN 2 * e >= -4 THEN 1 ELSE 0 END, y + CASE WHEN 2 * e <= 7 THEN 1 ELSE 0 END, e + CASE WHEN 2 * e >= -4 THEN -4 ELSE 0 END + CASE WHEN 2 * e <= 7 THEN 7 ELSE 0 END FROM line WHERE NOT (x = 7 AND y = 5))"),
    "draw_rectangle": pixels("CASE WHEN r BETWEEN 2 AND 5 AND c BETWEEN 1 AND 5 AND (r IN (2, 5) OR c IN (1, 5)) THEN 200 ELSE v END", "gray8"),
    "draw_rectangle_filled": pixels("CASE WHEN r >= 5 AND c >= 5 THEN 10 * (ch + 1) ELSE v END", "rgb8"),
    "draw_polygon": pixels(
        "CASE WHEN EXISTS (SELECT 1 FROM spans s WHERE s.y = r AND c BETWEEN s.a AND s.b) THEN 255 ELSE v END",
        "gray8",
        ctes="edges AS (SELECT * FROM (VALUES (1, 1, 6, 2), (6, 2, 3, 7), (3, 7, 1, 1)) AS e(ax, ay, bx, by_)), cuts AS (SELECT y, ax + (y - ay) * (bx - ax)::DOUBLE / (by_ - ay) AS x FROM edges JOIN generate_series(0, 7) g(y) ON y >= least(ay, by_) AND y < greatest(ay, by_)), pairs AS (SELECT y, x, row_number() OVER (PARTITION BY y ORDER BY x) - 1 AS k FROM cuts), spans AS (SELECT y, floor(min(x)) AS a, ceil(max(x)) AS b FROM pairs GROUP BY y, k // 2)",
    ),
    "softmax_probs": sql("SELECT CAST(image_id AS BIGINT) AS image_id, CAST(i AS INTEGER) AS bin, round(exp(v - hi) / sum(exp(v - hi)) OVER (PARTITION BY image_id), 6) + 0.0 AS v FROM (SELECT *, max(v) OVER (PARTITION BY image_id) AS hi FROM raw)"),
    "image_roundtrip": sql("SELECT CAST(image_id AS BIGINT) AS image_id, CAST(count(*) AS INTEGER) AS n_values, CAST(0 AS INTEGER) AS n_wrong FROM rgb8 GROUP BY 1"),
}
