"""Drawing: shapes become sets of places on the driver, and an image's values change where its place is in them.

Shapes are literals of the query, so drawing is a projection.  Points are cut
at the border; strokes and rectangles are clamped to it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checks import whole
from ..functions.pixels import clamp, each_pixel, half_even


def _colour(color, channels: int) -> list[float]:
    if channels == 1:
        if isinstance(color, Sequence):
            raise TypeError("a gray image needs one value as colour")
        return [float(color)]
    if not isinstance(color, Sequence) or len(color) != 3:
        raise ValueError("a colour image needs three values as colour")
    return [float(v) for v in color]


def _painted(images: DataFrame, inside, color, channels: int, *reads: str) -> DataFrame:
    """Colour where inside(r, c) holds."""
    values = F.array(*[F.lit(v) for v in _colour(color, channels)])
    old = lambda r, c, ch: F.get("data", (r * F.col("width") + c) * F.col("n_channels") + ch)
    value = lambda r, c, ch: F.when(inside(r, c), F.get(values, ch)).otherwise(old(r, c, ch))
    return images.withColumn("data", each_pixel(value, F.col("height"), F.col("width"), F.col("n_channels"), "data", *reads))


def draw_point(images: DataFrame, x: int, y: int, color, radius: int = 1, channels: int = 1) -> DataFrame:
    whole(radius, "radius", 1)
    return _painted(images, lambda r, c: (r - y) * (r - y) + (c - x) * (c - x) <= radius * radius, color, channels)


def line_places(x0: int, y0: int, x1: int, y1: int) -> list[tuple[int, int]]:
    """(x, y) of a digital line with both ends, by whole-number error terms."""
    x0, y0, x1, y1 = int(x0), int(y0), int(x1), int(y1)
    dx, dy = abs(x1 - x0), -abs(y1 - y0)
    step_x, step_y = (1 if x0 < x1 else -1), (1 if y0 < y1 else -1)
    out, error = [(x0, y0)], dx + dy
    while (x0, y0) != (x1, y1):
        twice = 2 * error
        if twice >= dy:
            error, x0 = error + dy, x0 + step_x
        if twice <= dx:
            error, y0 = error + dx, y0 + step_y
        out.append((x0, y0))
    return out


def _stroke(images: DataFrame, places: list[tuple[int, int]], thickness: int, color, channels: int) -> DataFrame:
    """A square of the given side at each place, clamped to the image."""
    off = -(whole(thickness, "thickness", 1) // 2)
    wide = sorted({(x + off + i, y + off + j) for x, y in places for i in range(thickness) for j in range(thickness)})
    keys = F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for x, y in wide])
    codes = F.transform(keys, lambda p: clamp(p["y"], 0, 1 << 30).cast("int"))  # rows below 0 are clamped here, the rest below
    spots = F.zip_with(keys, codes, lambda p, y: F.least(y, F.col("height") - 1) * F.col("width") + F.least(F.greatest(p["x"], F.lit(0)), F.col("width") - 1))
    return _painted(images.withColumn("_spots", spots), lambda r, c: F.array_contains("_spots", r * F.col("width") + c), color, channels, "_spots").drop("_spots")


def draw_line(images: DataFrame, x0: int, y0: int, x1: int, y1: int, color, thickness: int = 1, channels: int = 1) -> DataFrame:
    return _stroke(images, line_places(x0, y0, x1, y1), thickness, color, channels)


def draw_rectangle(images: DataFrame, x: int, y: int, width: int, height: int, color, thickness: int = 1, filled: bool = False, channels: int = 1) -> DataFrame:
    whole(width, "width", 1), whole(height, "height", 1)
    right, below = x + width - 1, y + height - 1
    if filled:
        top, left = F.least(F.lit(max(y, 0)), F.col("height") - 1), F.least(F.lit(max(x, 0)), F.col("width") - 1)
        return _painted(images, lambda r, c: (r >= top) & (r <= max(below, 0)) & (c >= left) & (c <= max(right, 0)), color, channels)
    corners = [(x, y), (right, y), (right, below), (x, below)]
    places = [p for a, b in zip(corners, corners[1:] + corners[:1]) for p in line_places(*a, *b)]
    return _stroke(images, places, thickness, color, channels)


def draw_polygon(images: DataFrame, points: Sequence[tuple[int, int]], color, thickness: int = 1, filled: bool = False, channels: int = 1) -> DataFrame:
    """Closed outline, or the even-odd inside by rows: spans from the floor of an entry to the ceiling of the exit."""
    if len(points) < 2:
        raise ValueError("a polygon needs at least two points")
    edges = list(zip(points, [*points[1:], points[0]]))
    if not filled:
        return _stroke(images, [p for a, b in edges for p in line_places(*a, *b)], thickness, color, channels)
    spans: list[tuple[int, int, int]] = []
    for row in range(min(y for _, y in points), max(y for _, y in points) + 1):
        cuts = sorted(ax + (row - ay) * (bx - ax) / (by - ay) for (ax, ay), (bx, by) in edges if min(ay, by) <= row < max(ay, by))
        spans += [(row, math.floor(a), math.ceil(b)) for a, b in zip(cuts[::2], cuts[1::2]) if math.ceil(b) >= 0]
    if not spans:
        return images
    table = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(a).alias("a"), F.lit(b).alias("b")) for r, a, b in spans])
    inside = lambda r, c: F.exists("_spans", lambda s: (s["r"] == r) & (c >= s["a"]) & (c <= s["b"]))
    return _painted(images.withColumn("_spans", table), inside, color, channels, "_spans").drop("_spans")


# fixed values: a 5x7 font, seven rows of five bits for each character
FONT = {
    " ": (0, 0, 0, 0, 0, 0, 0), "-": (0, 0, 0, 31, 0, 0, 0), ".": (0, 0, 0, 0, 0, 12, 12), ":": (0, 12, 12, 0, 12, 12, 0), "!": (4, 4, 4, 4, 4, 0, 4),
    "0": (14, 17, 19, 21, 25, 17, 14), "1": (4, 12, 4, 4, 4, 4, 14), "2": (14, 17, 1, 2, 4, 8, 31), "3": (31, 2, 4, 2, 1, 17, 14), "4": (2, 6, 10, 18, 31, 2, 2),
    "5": (31, 16, 30, 1, 1, 17, 14), "6": (6, 8, 16, 30, 17, 17, 14), "7": (31, 1, 2, 4, 8, 8, 8), "8": (14, 17, 17, 14, 17, 17, 14), "9": (14, 17, 17, 15, 1, 2, 12),
    "A": (14, 17, 17, 17, 31, 17, 17), "B": (30, 17, 17, 30, 17, 17, 30), "C": (14, 17, 16, 16, 16, 17, 14), "D": (28, 18, 17, 17, 17, 18, 28), "E": (31, 16, 16, 30, 16, 16, 31),
    "F": (31, 16, 16, 30, 16, 16, 16), "G": (14, 17, 16, 23, 17, 17, 15), "H": (17, 17, 17, 31, 17, 17, 17), "I": (14, 4, 4, 4, 4, 4, 14), "J": (7, 2, 2, 2, 2, 18, 12),
    "K": (17, 18, 20, 24, 20, 18, 17), "L": (16, 16, 16, 16, 16, 16, 31), "M": (17, 27, 21, 21, 17, 17, 17), "N": (17, 17, 25, 21, 19, 17, 17), "O": (14, 17, 17, 17, 17, 17, 14),
    "P": (30, 17, 17, 30, 16, 16, 16), "Q": (14, 17, 17, 17, 21, 18, 13), "R": (30, 17, 17, 30, 20, 18, 17), "S": (15, 16, 16, 14, 1, 1, 30), "T": (31, 4, 4, 4, 4, 4, 4),
    "U": (17, 17, 17, 17, 17, 17, 14), "V": (17, 17, 17, 17, 17, 10, 4), "W": (17, 17, 17, 21, 21, 21, 10), "X": (17, 17, 10, 4, 10, 17, 17), "Y": (17, 17, 17, 10, 4, 4, 4), "Z": (31, 1, 2, 4, 8, 16, 31),
}
UNKNOWN_GLYPH = (31, 17, 17, 17, 17, 17, 31)


def draw_text(images: DataFrame, text: str, x: int, y: int, font_scale: int = 1, color=255, alpha: float = 1.0, channels: int = 1) -> DataFrame:
    """Text in the built-in font, top left at (x, y), blended by alpha; places outside are left out."""
    if not isinstance(text, str):
        raise TypeError("text must be a string")
    scale = whole(font_scale, "font_scale", 1)
    places = sorted(
        {
            (y + r * scale + i, x + (6 * k + c) * scale + j)
            for k, ch in enumerate(text.upper())
            for r, bits in enumerate(FONT.get(ch, UNKNOWN_GLYPH))
            for c in range(5)
            if bits >> (4 - c) & 1
            for i in range(scale)
            for j in range(scale)
        }
    )
    if not places:
        return images
    values = F.array(*[F.lit(v) for v in _colour(color, channels)])
    spots = F.array(*[F.when((F.lit(r) >= 0) & (F.lit(r) < F.col("height")) & (F.lit(c) >= 0) & (F.lit(c) < F.col("width")), F.lit(r) * F.col("width") + c) for r, c in places])

    def value(r: Column, c: Column, ch: Column) -> Column:
        old = F.get("data", (r * F.col("width") + c) * F.col("n_channels") + ch)
        new = clamp(half_even(F.get(values, ch) * alpha + old * (1 - alpha)), 0, 255)
        return F.when(F.array_contains("_spots", r * F.col("width") + c), new).otherwise(old)

    return images.withColumn("_spots", F.filter(spots, lambda s: s.isNotNull())).withColumn("data", each_pixel(value, F.col("height"), F.col("width"), F.col("n_channels"), "data", "_spots")).drop("_spots")
