"""Box geometry as column expressions: angles, axes, poses, rectangles and their overlap."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2 * math.pi


def wrap_2pi(a: Column) -> Column:
    """To [0, 2 pi], with the sign of the divisor: a tiny negative angle becomes exactly 2 pi."""
    r = a % TWO_PI
    return F.when(r < 0, r + TWO_PI).otherwise(r)


def wrap_pi(a: Column) -> Column:
    """To [-pi, pi)."""
    return wrap_2pi(a + math.pi) - math.pi


def export_axes(cx: Column, cy: Column, cz: Column, h: Column, rot_z: Column) -> dict[str, Column]:
    """Box centre to the axes of track files: y down, z ahead, the bottom's centre."""
    return {"x": -cy, "y": -cz + h / 2, "z": cx, "yaw": wrap_2pi(-rot_z)}


def import_axes(x: Column, y: Column, z: Column, h: Column, yaw: Column) -> dict[str, Column]:
    """The inverse of export_axes()."""
    return {"cx": z, "cy": -x, "cz": -(y - h / 2), "rot_z": wrap_pi(-yaw)}


def quaternion_of_yaw(yaw: Column) -> dict[str, Column]:
    return {"qx": F.lit(0.0), "qy": F.lit(0.0), "qz": F.sin(yaw / 2), "qw": F.cos(yaw / 2)}


def yaw_of_quaternion(qx: Column, qy: Column, qz: Column, qw: Column) -> Column:
    """0 for a quaternion without length."""
    norm = F.sqrt(qx * qx + qy * qy + qz * qz + qw * qw)
    x, y, z, w = (q / norm for q in (qx, qy, qz, qw))
    return F.when(norm < 1e-12, 0.0).otherwise(F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z)))


def rotated(qx: Column, qy: Column, qz: Column, qw: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """A point turned by a quaternion; one without length turns nothing."""
    norm = F.sqrt(qx * qx + qy * qy + qz * qz + qw * qw)
    a, b, c, w = (F.when(norm < 1e-12, float(q is qw)).otherwise(q / norm) for q in (qx, qy, qz, qw))
    return (
        (1 - 2 * (b * b + c * c)) * x + 2 * (a * b - c * w) * y + 2 * (a * c + b * w) * z,
        2 * (a * b + c * w) * x + (1 - 2 * (a * a + c * c)) * y + 2 * (b * c - a * w) * z,
        2 * (a * c - b * w) * x + 2 * (b * c + a * w) * y + (1 - 2 * (a * a + b * b)) * z,
    )


def unit_clip(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def frames_of_seconds(seconds: Column, fps: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(seconds * fps).cast("int"))


def bottom(cz: Column, h: Column) -> Column:
    return cz - h / 2


def corners(cx: Column, cy: Column, l: Column, w: Column, rot_z: Column) -> Column:  # noqa: E741
    """The four corners of a box seen from above, counter-clockwise."""
    c, s = F.cos(rot_z), F.sin(rot_z)
    signs = ((0.5, 0.5), (-0.5, 0.5), (-0.5, -0.5), (0.5, -0.5))
    return F.array(*(F.struct((cx + a * l * c - b * w * s).alias("x"), (cy + a * l * s + b * w * c).alias("y")) for a, b in signs))


def association_cost(iou: Column, dist: Column, misses: Column, weight: float = 10.0, per_miss: float = 0.1, most: int = 10) -> Column:
    return (1 - iou) * weight + dist + per_miss * F.least(F.greatest(misses, F.lit(0)), F.lit(most))


def evidence(score: Column, floor: float, power: float) -> Column:
    return F.pow(unit_clip((score - floor) / (1 - floor)), F.lit(power))


def gain(dt: Column, tau: float) -> Column:
    return 1 - F.exp(-dt / tau)


def mahalanobis2(dx: Column, dy: Column, sxx: Column, sxy: Column, syy: Column) -> Column:
    """Squared distance under a 2 x 2 covariance."""
    det = sxx * syy - sxy * sxy
    return (syy * dx * dx - 2 * sxy * dx * dy + sxx * dy * dy) / det


def fps_of(step_ms: Column) -> Column:
    return F.when(step_ms < 1e-9, 0.0).otherwise(1000.0 / step_ms)


def fps_band(fps: Column, good: float = 10.0, fair: float = 8.0) -> Column:
    return F.when(fps >= good, "green").when(fps >= fair, "orange").otherwise("red")


def _corner_arrays(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x, y, l, w, t = b.T  # noqa: E741
    c, s = np.cos(t), np.sin(t)
    a = np.array([0.5, -0.5, -0.5, 0.5])[None] * l[:, None]
    d = np.array([0.5, 0.5, -0.5, -0.5])[None] * w[:, None]
    return x[:, None] + a * c[:, None] - d * s[:, None], y[:, None] + a * s[:, None] + d * c[:, None]


def rectangle_overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of n pairs of turned rectangles (cx, cy, l, w, rot_z); 0 for one without area.

    The common polygon's points are corners of one inside the other and crossings of edges; sorted by angle around
    their centre they give its area.
    """
    n = len(a)
    if not n:
        return np.zeros(0)
    shift = a[:, :2].copy()
    a, b = a.copy(), b.copy()
    a[:, :2] -= shift
    b[:, :2] -= shift
    pa, pb = _corner_arrays(a), _corner_arrays(b)

    def inside(p, box):
        c, s = np.cos(box[:, 4])[:, None], np.sin(box[:, 4])[:, None]
        dx, dy = p[0] - box[:, :1], p[1] - box[:, 1:2]
        return (np.abs(dx * c + dy * s) <= box[:, 2:3] / 2 + 1e-9) & (np.abs(dy * c - dx * s) <= box[:, 3:4] / 2 + 1e-9)

    # every edge of one with every edge of the other: (n, edge of a, edge of b)
    x1, y1, x2, y2 = pa[0][:, :, None], pa[1][:, :, None], pb[0][:, None], pb[1][:, None]
    after = [1, 2, 3, 0]
    dx, dy, ex, ey = x1[:, after] - x1, y1[:, after] - y1, x2[:, :, after] - x2, y2[:, :, after] - y2
    det = dx * ey - dy * ex
    crossing = np.abs(det) >= 1e-12
    safe = np.where(crossing, det, 1.0)
    t, u = ((x2 - x1) * ey - (y2 - y1) * ex) / safe, ((x2 - x1) * dy - (y2 - y1) * dx) / safe
    crossing &= (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    x, y = np.hstack([pa[0], pb[0], (x1 + t * dx).reshape(n, 16)]), np.hstack([pa[1], pb[1], (y1 + t * dy).reshape(n, 16)])
    ok = np.hstack([inside(pa, b), inside(pb, a), crossing.reshape(n, 16)])
    k = np.maximum(ok.sum(axis=1), 1)
    mx, my = np.where(ok, x, 0).sum(axis=1) / k, np.where(ok, y, 0).sum(axis=1) / k
    x, y = np.where(ok, x - mx[:, None], 0.0), np.where(ok, y - my[:, None], 0.0)
    order = np.argsort(np.where(ok, np.arctan2(y, x), np.inf), axis=1)
    x, y, ok = (np.take_along_axis(v, order, axis=1) for v in (x, y, ok))
    x, y = np.where(ok, x, x[:, :1]), np.where(ok, y, y[:, :1])
    common = 0.5 * np.abs((x * np.roll(y, -1, axis=1) - y * np.roll(x, -1, axis=1)).sum(axis=1))
    common = np.where(k >= 3, common, 0.0)
    total = np.abs(a[:, 2] * a[:, 3]) + np.abs(b[:, 2] * b[:, 3]) - common
    return np.clip(np.where(total > 0, common / np.where(total > 0, total, 1), 0.0), 0.0, 1.0)


def _overlap(ax: pd.Series, ay: pd.Series, al: pd.Series, aw: pd.Series, at: pd.Series, bx: pd.Series, by: pd.Series, bl: pd.Series, bw: pd.Series, bt: pd.Series) -> pd.Series:
    return pd.Series(rectangle_overlap(np.column_stack([ax, ay, al, aw, at]).astype(float), np.column_stack([bx, by, bl, bw, bt]).astype(float)))


def bev_iou(*boxes: Column) -> Column:
    """Overlap of two boxes (cx, cy, l, w, rot_z) each, seen from above, in Arrow batches."""
    return F.pandas_udf(_overlap, "double")(*boxes)
