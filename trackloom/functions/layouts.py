"""Box layouts of other trackers as projections, there and back, and outlines of boxes as data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackloom.functions.geometry import corners, wrap_pi

_BOX = ("cx", "cy", "cz", "l", "w", "h", "rot_z")

#: What each layout's numbers are, in order. camera: height, width, length, then right, down, ahead, and the angle.
LAYOUTS = {
    "camera": ("h", "w", "l", "-cy", "-cz", "cx", "rot_z"),
    "record": ("cx", "cy", "cz", "w", "l", "h", "rot_z"),
    "scored": ("cx", "cy", "cz", "rot_z", "l", "w", "h", "score"),
    "row": ("cx", "cy", "cz", "l", "w", "h", "rot_z"),
}


def to_layout(name: str) -> Column:
    """The columns of a box (and its score) as an array of numbers."""
    one = lambda c: -F.col(c[1:]) if c[0] == "-" else F.col(c)
    return F.array(*(one(c).cast("double") for c in LAYOUTS[name]))


def from_layout(name: str, numbers: Column) -> dict[str, Column]:
    """Columns of a box from such an array; an array of another length is an error."""
    order = LAYOUTS[name]
    right = F.when(F.size(numbers) == len(order), numbers).otherwise(F.raise_error(F.concat(F.lit(f"{name} has {len(order)} numbers, not "), F.size(numbers).cast("string"))).cast("array<double>"))
    return {c.lstrip("-"): -F.get(right, F.lit(i)) if c[0] == "-" else F.get(right, F.lit(i)) for i, c in enumerate(order)}


def area(l: Column, w: Column) -> Column:  # noqa: E741
    return F.abs(l * w)


def signed_area(points: Column) -> Column:
    """Of a polygon as an array of (x, y); positive counter-clockwise."""

    def of(p: Column) -> Column:
        after = F.concat(F.slice(p, F.lit(2), F.size(p)), F.slice(p, F.lit(1), F.lit(1)))
        return F.aggregate(F.zip_with(p, after, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda a, x: a + x) / 2

    return F.get(F.transform(F.array(points), of), F.lit(0))  # so that the points are made once, not for each use


def new_height(cz: Column, h: Column, wanted: Column) -> Column:
    """The centre's height of a box whose height changes and whose bottom stays."""
    return cz - h / 2 + wanted / 2


def outline(view: str) -> Column:
    """A box as seen along an axis, as an array of four points: 'xy' turned, 'xz' and 'yz' upright around the turned box."""
    seen = corners(F.col("cx"), F.col("cy"), F.col("l"), F.col("w"), F.col("rot_z"))
    if view == "xy":
        return seen
    axis = {"xz": "x", "yz": "y"}[view]
    ends = F.transform(seen, lambda p: p[axis])
    low, high = F.array_min(ends), F.array_max(ends)
    bottom, top = F.col("cz") - F.col("h") / 2, F.col("cz") + F.col("h") / 2
    return F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in ((low, bottom), (high, bottom), (high, top), (low, top))))


def edges() -> Column:
    """The twelve edges of a box as an array of (x0, y0, z0, x1, y1, z1): bottom, top, uprights."""
    seen = corners(F.col("cx"), F.col("cy"), F.col("l"), F.col("w"), F.col("rot_z"))
    low, high = F.col("cz") - F.col("h") / 2, F.col("cz") + F.col("h") / 2
    made = [(i, z, (i + 1) % 4, z) for z in (low, high) for i in range(4)] + [(i, low, i, high) for i in range(4)]
    return F.array(*(F.struct(seen[i]["x"].alias("x0"), seen[i]["y"].alias("y0"), z.alias("z0"), seen[j]["x"].alias("x1"), seen[j]["y"].alias("y1"), t.alias("z1")) for i, z, j, t in made))


def heading_segment(length: float) -> dict[str, Column]:
    """From the centre ahead."""
    return {"x0": F.col("cx"), "y0": F.col("cy"), "x1": F.col("cx") + length * F.cos("rot_z"), "y1": F.col("cy") + length * F.sin("rot_z")}


__all__ = ["LAYOUTS", "area", "edges", "from_layout", "heading_segment", "new_height", "outline", "signed_area", "to_layout", "wrap_pi"]
