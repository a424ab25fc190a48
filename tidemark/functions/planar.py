"""Planar geometry as column expressions.

A point is struct<x, y>, a line is array<struct<x, y>>, a ring is a closed line; everything stays inside Catalyst.
NULL goes in, NULL comes out; a zero-length segment has no direction and gives NULL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str
AXES = ("closest", "vertical", "horizontal", "horizontal-right-aligned")


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is made once, by a transform over one element; written into an expression it would be made again at each mention."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def point(x: ColumnOrName, y: ColumnOrName) -> Column:
    return F.struct(col(x).cast("double").alias("x"), col(y).cast("double").alias("y"))


def distance(a: Column, b: Column) -> Column:
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    return F.sqrt(dx * dx + dy * dy)


def shift_point(a: Column, b: Column, offset: ColumnOrName | float) -> Column:
    """a moved towards b, never past it; a negative offset moves away without bound; a itself where both are equal."""
    offset = F.lit(float(offset)) if isinstance(offset, int | float) else col(offset)
    d = distance(a, b)
    share = bound(d, lambda n: F.when(n == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.try_divide(offset, n))))
    return bound(share, lambda s: point(a["x"] + (b["x"] - a["x"]) * s, a["y"] + (b["y"] - a["y"]) * s))


def angle(a: Column, b: Column) -> Column:
    """Degrees anticlockwise from east, in (-180, 180]."""
    return F.degrees(F.atan2(b["y"] - a["y"], b["x"] - a["x"]))


def bearing(a: Column, b: Column) -> Column:
    """Degrees clockwise from north, in [0, 360)."""
    return F.pmod(F.lit(90.0) - angle(a, b), F.lit(360.0))


def point_at(p: Column, degrees: Column, dist: Column) -> Column:
    return point(p["x"] + dist * F.cos(F.radians(degrees)), p["y"] + dist * F.sin(F.radians(degrees)))


def rotation_angle(a: Column, b: Column, axis: str = "closest") -> Column:
    """Degrees (anticlockwise positive) that turn a-b onto an axis; 0 where it lies on one already."""
    if axis not in AXES:
        raise ValueError(f"axis must be one of {AXES}, not {axis!r}")
    t = bearing(a, b)
    past = t - F.floor(t / 90) * 90  # degrees into the quadrant
    quadrant = F.floor(t / 90)
    if axis == "closest":
        turn = F.when(past < 45, past).otherwise(past - 90)
    elif axis == "horizontal":
        turn = F.when(quadrant % 2 == 0, past - 90).otherwise(past)
    elif axis == "vertical":
        turn = F.when(quadrant < 2, t).when(quadrant == 2, t - 270).otherwise(t - 360)
    else:
        turn = F.when(quadrant == 0, t + 90).when(quadrant == 3, t - 270).otherwise(t - 270)
    return F.when((a["x"] == b["x"]) | (a["y"] == b["y"]), F.lit(0.0)).otherwise(turn)


# lines


def first(line: ColumnOrName) -> Column:
    return F.get(col(line), F.lit(0))


def last(line: ColumnOrName) -> Column:
    return F.try_element_at(col(line), F.lit(-1))


def segments(line: ColumnOrName) -> Column:
    """array<struct<a, b>> of neighbouring vertices."""
    line = col(line)
    n = F.greatest(F.size(line) - 1, F.lit(0))
    return F.arrays_zip(F.slice(line, F.lit(1), n).alias("a"), F.slice(line, F.lit(2), n).alias("b"))


def length(line: ColumnOrName) -> Column:
    return F.aggregate(segments(line), F.lit(0.0), lambda t, s: t + distance(s["a"], s["b"]))


def is_closed(line: ColumnOrName) -> Column:
    return first(line) == last(line)


def sinuosity(line: ColumnOrName) -> Column:
    """Length over the distance of the ends; NULL for a closed or empty line."""
    return length(line) / F.nullif(distance(first(line), last(line)), F.lit(0.0))


def bounds(line: ColumnOrName) -> Column:
    """struct<xmin, ymin, xmax, ymax>."""
    xs, ys = F.transform(col(line), lambda p: p["x"]), F.transform(col(line), lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def fractal_dimension(line: ColumnOrName) -> Column:
    """ln(length) over ln(diagonal of the bounds); NULL where the diagonal is 0 or 1."""
    b = bounds(line)
    w, h = b["xmax"] - b["xmin"], b["ymax"] - b["ymin"]
    d = F.sqrt(w * w + h * h)
    return F.when(d > 0, F.try_divide(F.ln(length(line)), F.ln(d)))


def crosses_antimeridian(line: ColumnOrName) -> Column:
    return F.exists(segments(line), lambda s: F.abs(s["b"]["x"] - s["a"]["x"]) > 180)


def extend_line(line: ColumnOrName, offset: Column, side: str = "both") -> Column:
    """The line with a vertex more at either end (or one of them), offset farther on."""
    line = col(line)
    if side not in ("both", "start", "end"):
        raise ValueError(f"side must be both, start or end, not {side!r}")
    head = F.array(shift_point(F.get(line, F.lit(0)), F.get(line, F.lit(1)), -offset)) if side != "end" else None
    tail = F.array(shift_point(F.try_element_at(line, F.lit(-1)), F.try_element_at(line, F.lit(-2)), -offset)) if side != "start" else None
    return F.concat(*[x for x in (head, line, tail) if x is not None])


def extend_transect(line: ColumnOrName, total: float, side: str = "both") -> Column:
    """Two-vertex line of that total length; each side named gets half of what is missing, so one side alone reaches half of it.  A longer line is an error."""
    missing = (F.lit(float(total)) - length(line)) / 2
    longer = extend_line(line, F.when(missing < 0, F.raise_error(F.lit("transects can only be extended")).cast("double")).otherwise(missing), side)
    return F.array(first(longer), last(longer))


def offset_segment(a: Column, b: Column, dist: Column | float) -> Column:
    """a-b moved sideways; to its left for a positive distance."""
    d = F.lit(float(dist)) if isinstance(dist, int | float) else dist
    away = lambda n: F.struct((-(b["y"] - a["y"]) / n * d).alias("x"), ((b["x"] - a["x"]) / n * d).alias("y"))
    moved = lambda o: F.array(point(a["x"] + o["x"], a["y"] + o["y"]), point(b["x"] + o["x"], b["y"] + o["y"]))
    return bound(bound(distance(a, b), lambda n: away(F.nullif(n, F.lit(0.0)))), moved)


def offset_rectangle(a: Column, b: Column, dist: Column | float) -> Column:
    """Closed ring dist to the left and right of a-b."""
    sides = F.struct(offset_segment(a, b, dist).alias("left"), offset_segment(a, b, -dist).alias("right"))
    return bound(sides, lambda s: F.array(first(s["left"]), last(s["left"]), last(s["right"]), first(s["right"]), first(s["left"])))


def area(ring: ColumnOrName) -> Column:
    """Shoelace area of a closed ring, without sign."""
    twice = F.aggregate(segments(ring), F.lit(0.0), lambda t, s: t + s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"])
    return F.abs(twice) / 2


def centroid(ring: ColumnOrName) -> Column:
    """Centroid of a closed ring of some area."""
    cross = lambda s: s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]
    total = lambda f: F.aggregate(segments(ring), F.lit(0.0), lambda t, s: t + f(s))
    six = F.nullif(total(cross) * 3, F.lit(0.0))
    return point(total(lambda s: (s["a"]["x"] + s["b"]["x"]) * cross(s)) / six, total(lambda s: (s["a"]["y"] + s["b"]["y"]) * cross(s)) / six)


def measures(line: ColumnOrName) -> Column:
    """Distance along the line of each vertex."""
    steps = F.transform(segments(line), lambda s: distance(s["a"], s["b"]))
    start = F.array(F.lit(0.0))
    return F.aggregate(steps, start, lambda t, d: F.concat(t, F.array(F.element_at(t, -1) + d)))


def interpolate(line: ColumnOrName, at: Column, along: ColumnOrName | None = None) -> Column:
    """Point of the line at that distance from its start, held within the line; along: its measures, where a column has them."""
    line = col(line)
    if along is None:
        return bound(measures(line), lambda m: interpolate(line, at, m))
    along = col(along)

    def before(held: Column) -> Column:
        k = F.size(F.filter(F.slice(along, F.lit(1), F.greatest(F.size(line) - 1, F.lit(1))), lambda m: m <= held)) - 1
        return F.struct(held.alias("held"), k.alias("k"))

    step = lambda s: F.struct(F.get(line, s["k"]).alias("a"), F.get(line, s["k"] + 1).alias("b"), (s["held"] - F.get(along, s["k"])).alias("d"))
    held = F.greatest(F.lit(0.0), F.least(at, F.try_element_at(along, F.lit(-1))))
    return bound(bound(bound(held, before), step), lambda s: shift_point(s["a"], s["b"], s["d"]))


def project(a: Column, b: Column, p: Column) -> Column:
    """Distance from a of the point of segment a-b that is nearest to p."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    along = F.try_divide((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy, dx * dx + dy * dy)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), along)) * F.sqrt(dx * dx + dy * dy)


def transect_origins(total: ColumnOrName, spacing: float) -> Column:
    """Distances along a line of that length at which transects start, centred.

    One fewer where the rest is under half a spacing; the middle where that leaves none; no origin at all on a line under half a spacing.
    """
    total = col(total).cast("double")
    whole = F.floor(total / spacing).cast("int")
    rest = total - whole * spacing
    n = F.when(rest < spacing * 0.5, whole - 1).otherwise(whole)
    start = (total - n * spacing) * 0.5
    many = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda k: start + k * spacing)
    return F.when(n == 0, F.array(total / 2)).when(n < 0, F.array().cast("array<double>")).otherwise(many)


def transect(before: Column, origin: Column, after: Column, total: float) -> Column:
    """Line across before-after through origin, half the length on either side, its left side first."""
    n = F.nullif(distance(before, after), F.lit(0.0))
    ux, uy = (after["x"] - before["x"]) / n * (total / 2), (after["y"] - before["y"]) / n * (total / 2)
    return F.array(point(origin["x"] - uy, origin["y"] + ux), point(origin["x"] + uy, origin["y"] - ux))


def box_ring(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Ring of a box from its lower right corner, anticlockwise."""
    return F.array(point(xmax, ymin), point(xmax, ymax), point(xmin, ymax), point(xmin, ymin), point(xmax, ymin))


def geojson_polygon(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    ring = F.transform(box_ring(xmin, ymin, xmax, ymax), lambda p: F.array(p["x"], p["y"]))
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))
