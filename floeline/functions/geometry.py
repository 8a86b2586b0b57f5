"""Boxes, sizes and polygons."""

from pyspark.sql import Column, functions as F

from floeline.functions.numbers import half_even


def rescale_area(area: Column, from_w: Column, from_h: Column, to_w: Column, to_h: Column) -> Column:
    """Pixel area at another resolution, halves to even."""
    scale = (to_h * to_w) / F.greatest(F.lit(1), from_h * from_w)
    return half_even(area * scale)


def rescale_edge(edge: Column, from_side: Column, to_side: Column) -> Column:
    return half_even(edge * (to_side / from_side))


def mirror_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column) -> tuple[Column, Column]:
    """New left and right edge after a horizontal flip; an incomplete box stays as it is."""
    whole = x1.isNotNull() & y1.isNotNull() & x2.isNotNull() & y2.isNotNull()

    def flip(edge: Column) -> Column:
        return F.greatest(F.lit(0), F.least(width, width - edge))

    return F.when(whole, flip(x2)).otherwise(x1), F.when(whole, flip(x1)).otherwise(x2)


def fit_longest_side(width: Column, height: Column, limit: int) -> tuple[Column, Column]:
    """Shrink so that the longer side is `limit`; never enlarge, at least one pixel."""
    longest = F.greatest(width, height)
    keep = (F.lit(limit) <= 0) | (longest <= limit)
    scale = F.lit(float(limit)) / longest

    def fit(side: Column) -> Column:
        return F.when(keep, side).otherwise(F.greatest(F.lit(1), half_even(side * scale)))

    return fit(width), fit(height)


def fit_box(width: Column, height: Column, max_width: int, max_height: int) -> tuple[Column, Column]:
    """Shrink into a box; never enlarge, at least one pixel."""
    scale = F.least(F.lit(float(max_width)) / width, F.lit(float(max_height)) / height, F.lit(1.0))

    def fit(side: Column) -> Column:
        return F.when(scale >= 1.0, side).otherwise(F.greatest(F.lit(1), half_even(side * scale)))

    return fit(width), fit(height)


def inside(x: Column, y: Column, edges: Column) -> Column:
    """Even-odd rule over an array of (x1, y1, x2, y2) edges; no edges means outside."""

    def crosses(edge: Column) -> Column:
        spans = (edge["y1"] > y) != (edge["y2"] > y)
        at = (edge["x2"] - edge["x1"]) * (y - edge["y1"]) / (edge["y2"] - edge["y1"]) + edge["x1"]
        return F.when(spans, x < at).otherwise(F.lit(False))

    parity = F.aggregate(edges, F.lit(False), lambda odd, edge: odd != crosses(edge))
    return F.coalesce(parity, F.lit(False))


def outline(edges: Column, width: float, height: float, reach: float) -> Column:
    """What `near` needs of (x1, y1, x2, y2) edges in a frame of width x height; made once for each outline, not for each point.

    Beside start, direction and squared length of an edge it has the box outside which nothing is within `reach` pixels,
    drawn a pixel wider than that, so that rounding can't matter.
    """
    w, h, margin = F.lit(float(width)), F.lit(float(height)), F.lit(float(reach + 1))

    def prepared(edge: Column) -> Column:
        x1, y1, x2, y2 = edge["x1"] * w, edge["y1"] * h, edge["x2"] * w, edge["y2"] * h
        dx, dy = x2 - x1, y2 - y1
        parts = {
            "x1": x1, "y1": y1, "dx": dx, "dy": dy, "square": dx * dx + dy * dy,
            "left": F.least(x1, x2) - margin, "right": F.greatest(x1, x2) + margin,
            "top": F.least(y1, y2) - margin, "bottom": F.greatest(y1, y2) + margin,
        }
        return F.struct(*[part.alias(name) for name, part in parts.items()])

    return F.transform(edges, prepared)


def near(x: Column, y: Column, outline: Column, width: float, height: float, reach: float) -> Column:
    """Whether a normalised point lies within `reach` pixels of an edge of the `outline` of the same frame; no edges means no."""
    px, py = x * F.lit(float(width)), y * F.lit(float(height))

    def beside(edge: Column) -> Column:
        return (px >= edge["left"]) & (px <= edge["right"]) & (py >= edge["top"]) & (py <= edge["bottom"])

    def offset(edge: Column) -> Column:
        along = F.try_divide((px - edge["x1"]) * edge["dx"] + (py - edge["y1"]) * edge["dy"], edge["square"])
        at = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(along, F.lit(0.0))))
        return F.struct(
            (px - (edge["x1"] + at * edge["dx"])).alias("x"), (py - (edge["y1"] + at * edge["dy"])).alias("y")
        )

    offsets = F.transform(F.filter(outline, beside), offset)
    found = F.exists(offsets, lambda o: o["x"] * o["x"] + o["y"] * o["y"] <= F.lit(float(reach * reach)))
    return F.coalesce(found, F.lit(False))
