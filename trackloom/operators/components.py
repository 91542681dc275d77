"""Connected components of the graphs of boxes in a frame, and one-to-one assignment by component."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.operators.batches import starts
from trackloom.operators.matching import KEY, assign, by_frame
from trackloom.plans.storage import written

#: Partial matchings of a component that are compared each with each; components that may have more go to the solver.
MATCHINGS = 256

_EDGE = "struct<track_id: {t}, det_id: {d}, cost: double>"


def components(edges: DataFrame) -> DataFrame:
    """edges(seq_name, frame_idx, track_id, det_id, ...) with `component`: the smallest track_id that an edge reaches over others of its frame.

    Edges travel once, sorted by frame; a task labels the whole frames of a batch at once and keeps an unfinished one for its next batch. Edges of a null sequence, frame or box
    are of no graph, and go; edges given twice stay twice. No edges, no rows.
    """
    own = edges.dropna(subset=[*KEY, "track_id", "det_id"])
    rows = by_frame(own.withColumn("component", F.col("track_id"))).sortWithinPartitions(*KEY)

    def labelled(table: pa.Table) -> pa.Table:
        ids = table.select([*KEY, "track_id", "det_id"]).to_pandas()
        tracks, ids["track_id"] = ids["track_id"].to_numpy(), pd.factorize(ids["track_id"], sort=True)[0]
        ids["det_id"] = pd.factorize(ids["det_id"])[0]
        at = least_reached(np.repeat(np.arange(len(f := starts(ids, KEY))), np.diff(f, append=len(ids))), ids["track_id"].to_numpy(), ids["det_id"].to_numpy())
        kind = table.schema.field("component")
        return table.set_column(table.schema.get_field_index("component"), kind, pa.array(tracks[at], kind.type))

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([*held, batch])
                last = int(starts(table.select(KEY).to_pandas(), KEY)[-1])
                if last:
                    yield from labelled(table.slice(0, last)).to_batches()
                held = table.slice(last).to_batches()
        if held:
            yield from labelled(pa.Table.from_batches(held)).to_batches()

    return written(rows.mapInArrow(frames, rows.schema))


def least_reached(frames: np.ndarray, tracks: np.ndarray, dets: np.ndarray) -> np.ndarray:
    """Of each edge an edge with the smallest track that it reaches over others of its frame.

    Labels go from tracks to detections and back, the least one around each, and then jump to the label of the track that they name, so a chain of n boxes takes about log n rounds.
    """

    def boxes(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Boxes in order of frame and number: the order of edges, where each box's begin there, and each edge's box."""
        order = np.lexsort((numbers, frames))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(frames[order]) != 0) | (np.diff(numbers[order]) != 0)
        box = np.empty(len(order), int)
        box[order] = np.cumsum(new) - 1
        return order, np.flatnonzero(new), box

    (by_track, first_of_track, track), (by_det, first_of_det, det) = boxes(tracks), boxes(dets)
    label = np.arange(len(first_of_track))
    while True:
        around = np.minimum.reduceat(label[track[by_det]], first_of_det)
        after = np.minimum.reduceat(around[det[by_track]], first_of_track)
        after = after[after]
        if (after == label).all():
            return by_track[first_of_track][label][track]
        label = after


def stars(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of edges(..., component): those of components in which one box has all edges, and the others."""
    by = W.partitionBy(*KEY, "component")
    sides = [F.min(c).over(by) == F.max(c).over(by) for c in ("track_id", "det_id")]
    marked = edges.withColumn("_star", sides[0] | sides[1])
    return marked.filter("_star").drop("_star"), marked.filter(~F.col("_star")).drop("_star")


def cheapest(edges: DataFrame) -> DataFrame:
    """The cheapest edge of each component, ties by track and detection: the best that a star allows."""
    order = W.partitionBy(*KEY, "component").orderBy("cost", "track_id", "det_id")
    return edges.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def matchings(edges: Column, kind: str) -> Column:
    """The best set of edges without a common box, as an array: as many as there can be, then the least cost, then the first in order. edges are an
    array of (track_id, det_id, cost); all sets without a common box are made, edge after edge."""
    none = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("cost"), F.array().cast(f"array<{kind}>").alias("chosen"))

    def with_edge(sets: Column, e: Column) -> Column:
        free = F.filter(sets, lambda s: ~F.exists(s["chosen"], lambda c: (c["track_id"] == e["track_id"]) | (c["det_id"] == e["det_id"])))
        return F.concat(sets, F.transform(free, lambda s: F.struct((s["n"] + 1).alias("n"), (s["cost"] + e["cost"]).alias("cost"), F.concat(s["chosen"], F.array(e)).alias("chosen"))))

    sets = F.aggregate(edges, F.array(none), with_edge)
    return F.array_min(F.transform(sets, lambda s: F.struct((-s["n"]).alias("n"), s["cost"].alias("cost"), s["chosen"].alias("chosen"))))["chosen"]


def assign_by_component(edges: DataFrame, most: int = MATCHINGS) -> DataFrame:
    """edges(seq_name, frame_idx, track_id, det_id, cost) one to one, as many as possible and then at least cost: (..., component, way).

    Three ways, by component: a `star` keeps its cheapest edge, by a window; a component of which at most `most` sets of edges can be without a
    common box is settled among these sets (`sets`), by array functions over its few edges; what is left goes to the solver (`solved`), many
    frames a batch. The bound on sets is the product of (1 + edges) over a component's tracks. Repeated edges count once, with their least cost.
    """
    rows = edges.groupBy(*KEY, "track_id", "det_id").agg(F.min("cost").alias("cost"))
    single, several = stars(by_frame(components(rows)))
    degree = F.count(F.lit(1)).over(W.partitionBy(*KEY, "component", "track_id"))
    # each edge brings its share of its track's log, so that the sum over the component is that of its tracks
    several = several.withColumn("_log", F.log(1.0 + degree) / degree).withColumn("_log", F.sum("_log").over(W.partitionBy(*KEY, "component")))
    several = written(several)
    kinds = dict(several.dtypes)
    kind = _EDGE.format(t=kinds["track_id"], d=kinds["det_id"])
    small = F.exp("_log") <= most + 0.5
    lists = several.filter(small).groupBy(*KEY, "component").agg(F.array_sort(F.collect_list(F.struct("track_id", "det_id", "cost"))).alias("edges"))
    best = lists.select(*KEY, "component", F.explode(matchings(F.col("edges"), kind)).alias("e")).select(*KEY, "e.*", "component", F.lit("sets").alias("way"))
    large = several.filter(~small)
    solved = assign(large).join(large.select(*KEY, "track_id", "det_id", "component"), [*KEY, "track_id", "det_id"]).withColumn("way", F.lit("solved"))
    parts = [cheapest(single).withColumn("way", F.lit("star")), best, solved]
    columns = [*KEY, "track_id", "det_id", "cost", "component", "way"]
    return reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])


def greedy_rounds(edges: DataFrame) -> DataFrame:
    """edges one to one, the cheapest first, ties by track and detection, as table rounds: edges that are the first of both their boxes are taken, and all that
    share a box with them go, until none is left. What a pass over the sorted edges takes is the same; here frames need not fit anywhere."""
    left, taken = edges.select(*KEY, "track_id", "det_id", "cost"), []
    while True:
        first = lambda box: F.row_number().over(W.partitionBy(*KEY, box).orderBy("cost", "track_id", "det_id")) == 1
        ranked = by_frame(left).withColumn("_take", first("track_id") & first("det_id"))
        ranked = ranked.withColumn("_gone", F.max("_take").over(W.partitionBy(*KEY, "track_id")) | F.max("_take").over(W.partitionBy(*KEY, "det_id")))
        ranked = written(ranked)
        taken.append(ranked.filter("_take").select(*left.columns))
        left = ranked.filter("NOT _gone").select(*left.columns)
        if left.isEmpty():
            return reduce(DataFrame.unionByName, taken)
