"""Plane geometry as columns: boxes, rings, and the two reference systems known in closed form."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6378137.0
ORIGIN = 20037508.342789244


def to_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude to spherical Mercator; null beyond the poles."""
    north = RADIUS * F.log(F.tan(math.pi / 4 + F.radians(y) / 2))
    return RADIUS * F.radians(x), F.when(F.abs(y) < 90, north)


def to_degrees(x: Column, y: Column) -> tuple[Column, Column]:
    """Spherical Mercator to longitude and latitude."""
    return F.degrees(x / RADIUS), F.degrees(2 * F.atan(F.exp(y / RADIUS)) - math.pi / 2)


def transform(x: Column, y: Column, source: int, target: int) -> tuple[Column, Column]:
    """Between EPSG 4326 and 3857; any other pair gives nulls."""
    if source == target and source in (4326, 3857):
        return x, y
    if (source, target) == (4326, 3857):
        return to_mercator(x, y)
    if (source, target) == (3857, 4326):
        return to_degrees(x, y)
    nothing = F.lit(None).cast("double")
    return nothing, nothing


def boxes_meet(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Whether two boxes (xmin, ymin, xmax, ymax) share a point, borders included."""
    return (a[0] <= b[2]) & (a[2] >= b[0]) & (a[1] <= b[3]) & (a[3] >= b[1])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, as the lambda variable of a one-element array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ring_edges(ring: Column) -> Column:
    """Edges (x1, y1, x2, y2) of a ring given as an array of points, closed if it isn't."""
    return let(
        ring,
        lambda r: F.transform(
            r,
            lambda p, i: F.struct(
                p["x"].alias("x1"), p["y"].alias("y1"),
                F.get(r, (i + 1) % F.size(r))["x"].alias("x2"), F.get(r, (i + 1) % F.size(r))["y"].alias("y2"),
            ),
        ),
    )


def in_ring(x: Column, y: Column, edges: Column) -> Column:
    """Even-odd rule over a ring's edges."""

    def crosses(e: Column) -> Column:
        straddles = (e["y1"] > y) != (e["y2"] > y)
        # Divides only where the edge isn't level.
        at = e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0))
        return F.when(straddles & (x < at), 1).otherwise(0)

    return F.aggregate(edges, F.lit(0), lambda a, e: a + crosses(e)) % 2 == 1


def edge_meets_box(e: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Whether a segment and a box share a point: overlapping extents and corners on both sides of its line."""
    extents = (
        (F.least(e["x1"], e["x2"]) <= xmax) & (F.greatest(e["x1"], e["x2"]) >= xmin)
        & (F.least(e["y1"], e["y2"]) <= ymax) & (F.greatest(e["y1"], e["y2"]) >= ymin)
    )

    def side(cx: Column, cy: Column) -> Column:
        return (e["x2"] - e["x1"]) * (cy - e["y1"]) - (e["y2"] - e["y1"]) * (cx - e["x1"])

    corners = [side(cx, cy) for cx in (xmin, xmax) for cy in (ymin, ymax)]
    return extents & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0)


def ring_meets_box(edges: Column, box: tuple[Column, Column, Column, Column]) -> Column:
    """Whether a polygon and a box share a point: an edge touches the box, or the box lies inside."""

    def meets(own: Column) -> Column:
        touches = F.exists(own, lambda e: edge_meets_box(e, *box))
        return touches | in_ring((box[0] + box[2]) / 2, (box[1] + box[3]) / 2, own)

    return let(edges, meets)


def ring_area(edges: Column) -> Column:
    """Area by the shoelace formula, in squared units of the coordinates."""
    return F.abs(F.aggregate(edges, F.lit(0.0), lambda a, e: a + e["x1"] * e["y2"] - e["x2"] * e["y1"])) / 2


def points(coords: list[tuple[float, float]]) -> Column:
    """A literal ring."""
    return F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in coords))


def wkt_ring(wkt: Column) -> Column:
    """The points of the first ring of a WKT polygon; null if there is none."""
    inner = F.regexp_extract(wkt, r"(?i)POLYGON\s*\(+([^()]*)\)", 1)
    pairs = F.filter(F.split(F.trim(inner), r"\s*,\s*"), lambda p: p != "")
    parsed = F.transform(
        pairs,
        lambda p: F.struct(
            F.get(F.split(F.trim(p), r"\s+"), F.lit(0)).try_cast("double").alias("x"), F.get(F.split(F.trim(p), r"\s+"), F.lit(1)).try_cast("double").alias("y")
        ),
    )
    return let(parsed, lambda r: F.when(F.size(r) > 0, r))


def box_wkt(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """A box as WKT, six decimals, from the lower left corner round to it again."""
    corner = [(xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax), (xmin, ymin)]
    return F.format_string("POLYGON ((" + ",".join(["%f %f"] * 5) + "))", *(c for pair in corner for c in pair))


def geotransform(xmin: Column, ymin: Column, xmax: Column, ymax: Column, width: int, height: int) -> Column:
    """Affine coefficients of a north-up raster of this size over a box."""
    return F.array(xmin, (xmax - xmin) / width, F.lit(0.0), ymax, F.lit(0.0), (ymin - ymax) / height)


def resolution(xmin: Column, ymin: Column, xmax: Column, ymax: Column, width: int, height: int) -> Column:
    """The coarser of the two pixel sizes."""
    return F.greatest((xmax - xmin) / width, (ymax - ymin) / height)


def pixel_window(low: Column, high: Column, origin: Column, step: Column, count: int) -> tuple[Column, Column]:
    """Offset and number (at least one) of pixels that an extent covers on one axis, within the raster."""
    a, b = F.floor((low - origin) / step + 0.5), F.floor((high - origin) / step + 0.5)
    first, last = F.least(a, b), F.greatest(a, b)
    offset = F.least(F.greatest(first, F.lit(0)), F.lit(count - 1))
    return offset.cast("int"), F.least(F.greatest(last - first, F.lit(1)), count - offset).cast("int")


def clamp_pixel(coord: Column, count: int) -> Column:
    """The pixel that holds a coordinate, clamped to the raster."""
    return F.least(F.greatest(F.floor(coord + 1e-10), F.lit(0)), F.lit(count - 1)).cast("int")


def segmentized(edges: Column, longest: float) -> Column:
    """Points along a ring's edges, none farther apart than ``longest``."""

    def along(e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        n = F.greatest(F.ceil(F.hypot(dx, dy) / longest), F.lit(1)).cast("int")
        return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct((e["x1"] + dx * k / n).alias("x"), (e["y1"] + dy * k / n).alias("y")))

    return F.flatten(F.transform(edges, along))


def envelope(ring: Column) -> Column:
    """The box of a ring's points."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def without_repeats(ring: Column, tolerance: float = 0.0) -> Column:
    """A ring without points that lie within ``tolerance`` of the one before."""
    return let(
        ring,
        lambda r: F.filter(
            r, lambda p, i: (i == 0) | (F.hypot(p["x"] - F.get(r, i - 1)["x"], p["y"] - F.get(r, i - 1)["y"]) > tolerance)
        ),
    )


def split_dateline(box: tuple[Column, Column, Column, Column]) -> Column:
    """A box over the antimeridian (west side positive, east side negative after its shift) as two boxes.

    A box from a negative to a positive longitude is taken to go the other way round; others stay.
    """
    xmin, ymin, xmax, ymax = box
    one = lambda a, b: F.struct(a.alias("xmin"), ymin.alias("ymin"), b.alias("xmax"), ymax.alias("ymax"))
    both = F.array(one(xmax, F.lit(180.0)), one(F.lit(-180.0), xmin))
    return F.when((xmin < 0) & (xmax > 0), both).otherwise(F.array(one(xmin, xmax)))


def lossy_transform(ring: Column, source: int, target: int) -> Column:
    """A ring's points in another system, without those that can't be carried over."""

    def move(p: Column) -> Column:
        x, y = transform(p["x"], p["y"], source, target)
        return F.struct(x.alias("x"), y.alias("y"))

    return F.filter(F.transform(ring, move), lambda p: p["x"].isNotNull() & p["y"].isNotNull())


def hull(ring: Column) -> Column:
    """The convex hull of a ring's points, from the leftmost round to the left.

    Points in order of x and y; one pass per side keeps a chain that only turns left.
    """

    def side(points_: Column) -> Column:
        def add(chain: Column, p: Column) -> Column:
            def trimmed(c: Column) -> Column:
                n = F.size(c)
                a, b = F.get(c, n - 2), F.get(c, n - 1)
                turn = (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])
                return F.when((n >= 2) & (turn <= 0), F.slice(c, 1, n - 1)).otherwise(c)

            cut = F.aggregate(F.sequence(F.lit(1), F.size(chain) + 1), chain, lambda c, _: trimmed(c))
            return F.array_append(cut, p)

        return F.aggregate(points_, F.array().cast("array<struct<x:double,y:double>>"), add)

    def joined(p: Column) -> Column:
        lower, upper = side(p), side(F.reverse(p))
        return F.concat(F.slice(lower, 1, F.size(lower) - 1), F.slice(upper, 1, F.size(upper) - 1))

    return let(F.sort_array(F.array_distinct(ring)), lambda p: F.when(F.size(p) > 2, joined(p)).otherwise(p))
