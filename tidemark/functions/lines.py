"""Parts, splits and moves of lines, and bounds of nested coordinates, as column expressions (see planar for the types)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.planar import ColumnOrName, bound, col, distance, first, interpolate, last, measures, offset_segment, point, project, segments

Line = Column


def part(line: ColumnOrName, start: Column, end: Column, along: ColumnOrName) -> Line:
    """What lies between two distances from the start; along: the measures of the line, a column made before."""
    line, along = col(line), col(along)

    def between(s: Column) -> Column:
        inner = F.filter(F.arrays_zip(line.alias("p"), along.alias("m")), lambda v: (v["m"] > s["start"]) & (v["m"] < s["end"]))
        return F.concat(F.array(interpolate(line, s["start"], along)), F.transform(inner, lambda v: v["p"]), F.array(interpolate(line, s["end"], along)))

    return bound(F.struct(start.alias("start"), end.alias("end")), between)


def split_every(line: ColumnOrName, step: float, along: ColumnOrName, tolerance: float = 0.1) -> Column:
    """array of lines of that length, the last with what is left; a rest within the tolerance stays with the piece before it."""
    total = F.try_element_at(col(along), F.lit(-1))
    n = F.greatest(F.ceil((total - tolerance) / step).cast("int"), F.lit(1))
    piece = lambda s, k: part(line, k * step, F.when(k == s["n"] - 1, s["total"]).otherwise((k + 1) * step), along)
    return bound(F.struct(total.alias("total"), n.alias("n")), lambda s: F.transform(F.sequence(F.lit(0), s["n"] - 1), lambda k: piece(s, k)))


def locate(line: ColumnOrName, along: ColumnOrName, p: Column) -> Column:
    """struct<away, at>: the distance of a place from the line, and the distance along it of the nearest point (the first of equals)."""
    steps = F.arrays_zip(segments(line).alias("s"), F.slice(col(along), F.lit(1), F.greatest(F.size(col(along)) - 1, F.lit(0))).alias("m"))

    def nearest(x: Column) -> Column:
        a, b = x["s"]["a"], x["s"]["b"]

        def there(s: Column) -> Column:
            foot = point(a["x"] + (b["x"] - a["x"]) * s["share"], a["y"] + (b["y"] - a["y"]) * s["share"])
            return F.struct(bound(foot, lambda f: distance(f, p)).alias("away"), (x["m"] + s["at"]).alias("at"))

        share = lambda at: F.struct(at.alias("at"), F.coalesce(F.try_divide(at, distance(a, b)), F.lit(0.0)).alias("share"))
        return bound(bound(F.coalesce(project(a, b, p), F.lit(0.0)), share), there)

    return F.array_min(F.transform(steps, nearest))


def split_at(line: ColumnOrName, places: ColumnOrName, along: ColumnOrName, tolerance: float = 0.1) -> Column:
    """array of lines between those places (an array of points) that lie within the tolerance of the line; ends and others do not split."""
    total = F.try_element_at(col(along), F.lit(-1))
    found = F.transform(col(places), lambda p: locate(line, along, p))
    at = F.transform(F.filter(found, lambda f: (f["away"] <= tolerance) & (f["at"] > tolerance) & (f["at"] < total - tolerance)), lambda f: f["at"])
    cuts = F.concat(F.array(F.lit(0.0)), F.array_sort(F.array_distinct(at)), F.array(total))
    return bound(cuts, lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda k: part(line, F.element_at(c, k), F.element_at(c, k + 1), along)))


def with_measures(df, line: str, name: str = "along"):
    """df with the measures of a line in a column, so that they are made once."""
    return df.withColumn(name, measures(line))


def parallel(line: ColumnOrName, dist: float) -> Line:
    """The line moved sideways, left for a positive distance; neighbouring segments meet at the crossing of their moved carriers, straight ones where their ends are."""
    line = col(line)
    if not dist:
        return line
    moved = F.transform(segments(line), lambda s: F.struct(offset_segment(s["a"], s["b"], dist).alias("o")))
    moved = F.filter(moved, lambda m: m["o"][0]["x"].isNotNull())

    def corner(m: Column, n: Column) -> Column:
        a, b, c, d = m["o"][0], m["o"][1], n["o"][0], n["o"][1]
        ux, uy, vx, vy = b["x"] - a["x"], b["y"] - a["y"], d["x"] - c["x"], d["y"] - c["y"]
        cross = ux * vy - uy * vx
        t = bound(cross, lambda x: F.try_divide((c["x"] - a["x"]) * vy - (c["y"] - a["y"]) * vx, F.when(F.abs(x) > 1e-12, x)))
        return bound(t, lambda s: F.coalesce(F.when(s.isNotNull(), point(a["x"] + ux * s, a["y"] + uy * s)), b))

    def joined(m: Column) -> Line:
        n = F.greatest(F.size(m) - 1, F.lit(0))
        corners = F.zip_with(F.slice(m, F.lit(1), n), F.slice(m, F.lit(2), n), corner)
        return F.concat(F.array(first(m)["o"][0]), corners, F.array(last(m)["o"][1]))

    return bound(moved, joined)


def landward(line: ColumnOrName, origin: Column) -> Line:
    """From the first vertex to the origin."""
    return F.array(first(line), origin)


def midpoint(line: ColumnOrName, along: ColumnOrName) -> Column:
    return interpolate(line, F.try_element_at(col(along), F.lit(-1)) / 2, along)


def coords_bbox(coords: ColumnOrName) -> Column:
    """[min, min, max, max] of an array of [x, y]."""

    def edges(c: Column) -> Column:
        pick = lambda f, k: f(F.transform(c, lambda p: p[k]))
        return F.array(pick(F.array_min, 0), pick(F.array_min, 1), pick(F.array_max, 0), pick(F.array_max, 1))

    return bound(col(coords), edges)


#: Depth of the coordinates of a GeoJSON geometry: fixed values.
DEPTHS = {"Point": 0, "LineString": 1, "MultiPoint": 1, "Polygon": 2, "MultiLineString": 2, "MultiPolygon": 3}


def geojson_bbox(text: ColumnOrName) -> Column:
    """[min, min, max, max] of a GeoJSON geometry; another type is an error, unreadable text NULL."""

    def box(g: Column) -> Column:
        kind = g["kind"]
        out = F.when(kind.isNotNull(), F.raise_error(F.concat(F.lit("no such geometry type: "), kind)).cast("array<double>"))
        for name, depth in DEPTHS.items():
            c = F.from_json(g["coordinates"], "array<" * (depth + 1) + "double" + ">" * (depth + 1))
            flat = F.array(c) if depth == 0 else c
            for _ in range(depth - 1):
                flat = F.flatten(flat)
            out = F.when(kind == name, coords_bbox(flat)).otherwise(out)
        return out

    parts = lambda t: F.struct(F.get_json_object(t, "$.type").alias("kind"), F.get_json_object(t, "$.coordinates").alias("coordinates"))
    return bound(bound(col(text), parts), box)


def antimeridian_near(lon: ColumnOrName, degrees: float) -> Column:
    """Within so many degrees of longitude of the antimeridian."""
    return 180 - F.abs(col(lon)) <= degrees


def regular_buffer(p: Column, radius: float, quarter: int = 16) -> Column:
    """Ring of a circle about a point, with that many segments to a quarter; in a plane, so points are taken to one before."""
    turn = 3.141592653589793 / 2 / quarter
    return F.transform(F.sequence(F.lit(0), F.lit(4 * quarter)), lambda k: point(p["x"] + radius * F.cos((k % (4 * quarter)) * turn), p["y"] - radius * F.sin((k % (4 * quarter)) * turn)))


def split_box(xmin: Column, xmax: Column) -> Column:
    """array<struct<xmin, xmax>> of a box's longitudes, which may run past -180 or 180: what lies within, then what comes in on the other side."""
    part = lambda a, b: F.struct(a.cast("double").alias("xmin"), b.cast("double").alias("xmax"))
    inside = part(F.greatest(xmin, F.lit(-180.0)), F.least(xmax, F.lit(180.0)))
    return F.when(xmin < -180, F.array(inside, part(xmin + 360, F.lit(180.0)))).when(xmax > 180, F.array(inside, part(F.lit(-180.0), xmax - 360))).otherwise(F.array(inside))
