"""Gated joins of boxes inside a frame, and one-to-one assignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.functions.geometry import association_cost, bev_iou

KEY = ["seq_name", "frame_idx"]


BOX = ("cx", "cy", "cz", "l", "w", "h", "rot_z")


def by_frame(rows: DataFrame) -> DataFrame:
    """rows with those of a frame side by side in one partition; joins, windows and groups inside frames then need no further exchange. Spark uses that
    for joins on more than the frame once the session's setting that asks for all keys is switched off."""
    rows.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return rows.repartition(*KEY)


def candidates(left: DataFrame, right: DataFrame, radius: float, top_k: int | None = None, z_gate: float | None = None, min_iou: float | None = None) -> DataFrame:
    """Pairs of a frame within `radius` of each other seen from above, with dist2 and, if min_iou is given, iou.

    left and right have (seq_name, frame_idx, track_id or det_id, box). Each left box keeps its top_k nearest, ties by
    det_id, and only then the height gate and the least overlap are applied. All gates are inclusive. Boxes are joined on a
    grid of cells four times as wide as the radius, so a crowded frame is not all pairs.
    """
    # cells four radii wide: what is near a box lies in 2.25 of them on average, in 4 at most; a little more than the radius allows for rounding
    width, reach = 4 * radius, radius * (1 + 1e-6)
    cell = lambda c, by=0.0: F.floor((F.col(c) + by) / width).cast("long")
    a = left.select(*KEY, "track_id", *(F.col(c).alias(f"a_{c}") for c in ("cx", "cy", "cz", "l", "w", "h", "rot_z")))
    b = right.select(*KEY, "det_id", *(F.col(c).alias(f"b_{c}") for c in ("cx", "cy", "cz", "l", "w", "h", "rot_z")))
    a, b = by_frame(a), by_frame(b)
    a = a.withColumn("gx", F.explode(F.sequence(cell("a_cx", -reach), cell("a_cx", reach)))).withColumn("gy", F.explode(F.sequence(cell("a_cy", -reach), cell("a_cy", reach))))
    b = b.withColumn("gx", cell("b_cx")).withColumn("gy", cell("b_cy"))
    dx, dy = F.col("a_cx") - F.col("b_cx"), F.col("a_cy") - F.col("b_cy")
    pairs = a.join(b, [*KEY, "gx", "gy"]).withColumn("dist2", dx * dx + dy * dy).filter(F.col("dist2") <= radius * radius).drop("gx", "gy")
    if top_k is not None:
        order = W.partitionBy(*KEY, "track_id").orderBy("dist2", "det_id")
        pairs = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k).drop("rank")
    if z_gate is not None:
        pairs = pairs.filter(F.abs(F.col("a_cz") - F.col("b_cz")) <= z_gate)
    if min_iou is not None:
        boxes = [F.col(f"{s}_{c}") for s in "ab" for c in ("cx", "cy", "l", "w", "rot_z")]
        pairs = pairs.withColumn("iou", bev_iou(*boxes)).filter(F.col("iou") >= min_iou)
    return pairs


#: Up to so many rows plain lists are quicker than arrays.
_SMALL = 32


def least_cost(cost: np.ndarray) -> list[tuple[int, int]]:
    """The cheapest complete assignment of a square matrix, by shortest augmenting paths."""
    n = len(cost)
    if n <= _SMALL:
        return _least_cost_of_few(cost.tolist())
    u, v, match, way = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        match[0], j = i, 0
        low, used = np.full(n + 1, np.inf), np.zeros(n + 1, bool)
        while True:
            used[j] = True
            reduced = cost[match[j] - 1] - u[match[j]] - v[1:]
            better = ~used[1:] & (reduced < low[1:])
            low[1:][better], way[1:][better] = reduced[better], j
            free = np.flatnonzero(~used[1:]) + 1
            k = free[np.argmin(low[free])]
            delta = low[k]
            u[match[used]] += delta
            v[used] -= delta
            low[~used] -= delta
            j = k
            if not match[j]:
                break
        while j:
            match[j], j = match[way[j]], way[j]
    return [(match[j] - 1, j - 1) for j in range(1, n + 1)]


def _least_cost_of_few(cost: list[list[float]]) -> list[tuple[int, int]]:
    """The same, step by step, in lists."""
    n = len(cost)
    u, v, match, way = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        match[0], j = i, 0
        low, free, used = [float("inf")] * (n + 1), list(range(1, n + 1)), [0]
        while True:
            row, high, delta, k = cost[match[j] - 1], u[match[j]], float("inf"), 0
            for c in free:
                reduced = row[c - 1] - high - v[c]
                if reduced < low[c]:
                    low[c], way[c] = reduced, j
                if low[c] < delta:
                    delta, k = low[c], c
            for c in used:
                u[match[c]] += delta
                v[c] -= delta
            for c in free:
                low[c] -= delta
            j = k
            if not match[j]:
                break
            free.remove(j), used.append(j)
        while j:
            match[j], j = match[way[j]], way[j]
    return [(match[j] - 1, j - 1) for j in range(1, n + 1)]


#: What a row costs that stays alone: more than any edges that it could spare.
_ALONE = 1e6


def least_cost_of_edges(rows: list[list[tuple[int, float]]], n_cols: int) -> list[tuple[int, int]]:
    """As many (row, column) one to one as can be, then at least cost, by shortest augmenting paths along the edges (column, cost) of each row alone."""
    n, high, low = len(rows), [0.0] * len(rows), [0.0] * (n_cols + len(rows))
    match, col_of = [-1] * len(low), [-1] * n
    rows = [[*edges, (n_cols + r, _ALONE)] for r, edges in enumerate(rows)]  # a column of its own for each row, so that a path is always found
    for i in range(n):
        high[i] = min(w - low[c] for c, w in rows[i])
        r, way, open_, closed, far = i, {}, {}, {}, 0.0
        while True:
            rest = far - high[r]
            for c, w in rows[r]:
                if c not in closed and (d := rest + w - low[c]) < open_.get(c, float("inf")):
                    open_[c], way[c] = d, r
            col = min(open_, key=open_.get)
            far = open_.pop(col)
            if match[col] < 0:
                break
            closed[col], r = far, match[col]
        for c, d in closed.items():
            low[c] -= far - d
            high[match[c]] += far - d
        high[i] += far
        while True:
            r = way[col]
            match[col], col_of[r], col = r, col, col_of[r]
            if r == i:
                break
    return [(r, c) for r, c in enumerate(col_of) if c < n_cols]


def numbered(x: np.ndarray) -> np.ndarray:
    """x as small whole numbers in the same order; such numbers stay as they are."""
    if x.dtype.kind == "i" and x.min() >= 0 and x.max() < 4 * len(x) + 1024:
        return x
    return np.unique(x, return_inverse=True)[1]


def assigned_pairs(tracks: np.ndarray, dets: np.ndarray, cost: np.ndarray, method: str = "optimal") -> np.ndarray:
    """Indices of the chosen edges: as many as possible, then at least cost; or greedily, the cheapest edge first.

    tracks and dets may be of many frames at once, if none has a number of another frame. Of a component in which all edges share a box
    the cheapest edge is chosen, for all of them together; only the others are looked at one by one.
    """
    order = np.lexsort((dets, tracks, cost))
    if method == "greedy":
        seen, out = (set(), set()), []
        for e, t, d in zip(order.tolist(), tracks[order].tolist(), dets[order].tolist()):
            if t not in seen[0] and d not in seen[1]:
                seen[0].add(t), seen[1].add(d), out.append(e)
        return np.array(sorted(out), int)
    if not len(order):
        return order
    t, d = numbered(tracks), numbered(dets)
    degree = [np.bincount(x)[x] for x in (t, d)]
    # the most edges that the boxes on the other side have: 1 if all around this box have only the edge to it
    around = [np.zeros(x.max() + 1, int) for x in (t, d)]
    np.maximum.at(around[0], t, degree[1]), np.maximum.at(around[1], d, degree[0])
    star = np.where(around[0][t] == 1, 0, np.where(around[1][d] == 1, 1, 2))
    out = []
    for kind, x in ((0, t), (1, d)):
        mine = order[star[order] == kind]
        if len(mine):
            out += mine[np.unique(x[mine], return_index=True)[1]].tolist()
    rest = order[star[order] == 2]
    edges_of_component: dict = {}
    root: dict = {}

    def find(x):
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    rest = list(zip(rest.tolist(), t[rest].tolist(), (-1 - d[rest]).tolist(), cost[rest].tolist()))
    for _, a, b, _ in rest:
        root[find(a)] = find(b)
    for edge in rest:
        edges_of_component.setdefault(find(edge[1]), []).append(edge)
    for edges in edges_of_component.values():
        row = {x: i for i, x in enumerate(sorted({e[1] for e in edges}))}
        col = {x: i for i, x in enumerate(sorted({e[2] for e in edges}, reverse=True))}
        n, at, cheapest = max(len(row), len(col)), {}, {}
        for e, a, b, c in edges:  # in order of cost
            if (p := (row[a], col[b])) not in at:
                at[p], cheapest[p] = e, c
        if len(at) * 2 < n * n:
            of_row = [[] for _ in row]
            for (a, b), c in sorted(cheapest.items()):
                of_row[a].append((b, c))
            out += [at[p] for p in least_cost_of_edges(of_row, len(col))]
        else:
            matrix = np.full((n, n), _ALONE)
            for p, c in cheapest.items():
                matrix[p] = c
            out += [at[p] for p in least_cost(matrix) if p in at]
    return np.array(sorted(out), int)


def assign(edges: DataFrame, method: str = "optimal", *kept: str) -> DataFrame:
    """edges(seq_name, frame_idx, track_id, det_id, cost) of each frame, one to one; columns named `kept` stay.

    A frame's edges stand side by side in a partition; a task takes many frames at a time, and keeps an unfinished one for its next batch.
    """
    rows = edges.select(*KEY, "track_id", "det_id", "cost", *kept)

    def chosen(pdf: pd.DataFrame) -> pd.DataFrame:
        frame = pdf.groupby(KEY, sort=False).ngroup().to_numpy()
        t, d = (pd.MultiIndex.from_arrays([frame, pdf[c]]).factorize(sort=True)[0] for c in ("track_id", "det_id"))
        return pdf.iloc[assigned_pairs(t, d, pdf["cost"].to_numpy(), method)]

    def frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            last = (pdf[KEY] == pdf[KEY].iloc[-1]).all(axis=1)
            held = pdf[last]
            if not last.all():
                yield chosen(pdf[~last])
        if held is not None:
            yield chosen(held)

    return by_frame(rows).sortWithinPartitions(*KEY).mapInPandas(frames, rows.schema)


def edges_of(pairs: DataFrame, weight: float = 10.0) -> DataFrame:
    """Pairs with their association cost; without an overlap only the distance counts."""
    iou = F.col("iou") if "iou" in pairs.columns else F.lit(1.0)
    return pairs.withColumn("cost", association_cost(iou, F.sqrt("dist2"), F.lit(0), weight))


def unmatched(dets: DataFrame, matches: DataFrame) -> DataFrame:
    return dets.join(matches, [*KEY, "det_id"], "left_anti")


def matched(dets: DataFrame, matches: DataFrame) -> DataFrame:
    return dets.join(matches, [*KEY, "det_id"], "left_semi")
