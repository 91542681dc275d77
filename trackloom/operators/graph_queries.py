"""Registered queries of components, assignment by component and greedy rounds, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators import components as K
from trackloom.operators import matching
from trackloom.operators.registry import KEYS, C, query, r6

EDGES = "SELECT g.seq_name, g.frame_idx, g.track_id, d.det_id, (g.cx - d.cx) * (g.cx - d.cx) + (g.cy - d.cy) * (g.cy - d.cy) AS cost FROM gt g JOIN det d ON g.seq_name = d.seq_name AND g.frame_idx = d.frame_idx WHERE (g.cx - d.cx) * (g.cx - d.cx) + (g.cy - d.cy) * (g.cy - d.cy) <= CAST(0.45 AS double) * CAST(0.45 AS double)"
#: Edges with the smallest track that each of them reaches: all that reach one another, and the least of them.
LABELLED = f"""e AS MATERIALIZED ({EDGES}), reach(seq_name, frame_idx, a, b) AS (
  SELECT DISTINCT seq_name, frame_idx, track_id, track_id FROM e
  UNION
  SELECT r.seq_name, r.frame_idx, r.a, y.track_id FROM reach r JOIN e x ON x.seq_name = r.seq_name AND x.frame_idx = r.frame_idx AND x.track_id = r.b
  JOIN e y ON y.seq_name = x.seq_name AND y.frame_idx = x.frame_idx AND y.det_id = x.det_id
), least AS (SELECT seq_name, frame_idx, b AS track_id, min(a) AS component FROM reach GROUP BY ALL),
c AS MATERIALIZED (SELECT e.*, component FROM e JOIN least USING (seq_name, frame_idx, track_id))"""


def edges_of(gt: DataFrame, det: DataFrame) -> DataFrame:
    return matching.candidates(gt, det, 0.45).select(*KEYS, "track_id", "det_id", C("dist2").alias("cost"))


@query("j11_components", f"WITH RECURSIVE {LABELLED} SELECT seq_name, frame_idx, track_id, det_id, component FROM c", "gt", "det")
def j11(gt, det):
    """Every edge of every frame with its component."""
    return K.components(edges_of(gt, det)).select(*KEYS, "track_id", "det_id", "component")


#: The best one-to-one choice of each component, track by track over all sets of detections that earlier tracks can have taken.
BEST = f"""WITH RECURSIVE {LABELLED}, placed AS MATERIALIZED (
  SELECT *, dense_rank() OVER (PARTITION BY seq_name, frame_idx, component ORDER BY track_id) - 1 AS t, 1::hugeint << (dense_rank() OVER (PARTITION BY seq_name, frame_idx, component ORDER BY det_id) - 1)::int AS bit FROM c
), choice AS MATERIALIZED (
  SELECT seq_name, frame_idx, component, t, bit, cost, 1 AS one FROM placed UNION ALL SELECT DISTINCT seq_name, frame_idx, component, t, 0::hugeint, 0.0::double, 0 FROM placed
), best(seq_name, frame_idx, component, t, taken, found) AS (
  SELECT DISTINCT seq_name, frame_idx, component, 0::bigint, 0::hugeint, {{'n': 0, 'cost': 0.0::double}} FROM c
  UNION ALL
  SELECT b.seq_name, b.frame_idx, b.component, b.t + 1, b.taken | x.bit, min({{'n': b.found.n - x.one, 'cost': b.found.cost + x.cost}})
  FROM best b JOIN choice x ON x.seq_name = b.seq_name AND x.frame_idx = b.frame_idx AND x.component = b.component AND x.t = b.t AND b.taken & x.bit = 0 GROUP BY ALL
)
SELECT seq_name, frame_idx, component, CAST(-found.n AS bigint) AS pairs, round(found.cost, 6) AS cost FROM (
  SELECT b.seq_name, b.frame_idx, b.component, min(found) AS found FROM best b JOIN (SELECT seq_name, frame_idx, component, max(t) + 1 AS n FROM placed GROUP BY ALL) s
  ON s.seq_name = b.seq_name AND s.frame_idx = b.frame_idx AND s.component = b.component AND s.n = b.t GROUP BY ALL)"""


@query("j12_best_of_components", BEST, "gt", "det")
def j12_best(gt, det):
    """Of every component of every frame, how many pairs can be made at once, and the least that so many cost."""
    pairs = K.assign_by_component(edges_of(gt, det))
    return pairs.groupBy(*KEYS, "component").agg(F.count(F.lit(1)).alias("pairs"), r6(F.sum("cost"), "cost"))


#: Rounds in which edges are taken that are the first of both their boxes.
GREEDY = f"""e AS MATERIALIZED ({EDGES}), rounds AS (
  SELECT *, false AS take, false AS gone FROM e
  UNION ALL
  SELECT seq_name, frame_idx, track_id, det_id, cost, take, bool_or(take) OVER (PARTITION BY seq_name, frame_idx, track_id) OR bool_or(take) OVER (PARTITION BY seq_name, frame_idx, det_id)
  FROM (SELECT *, row_number() OVER (PARTITION BY seq_name, frame_idx, track_id ORDER BY cost, det_id) = 1 AND row_number() OVER (PARTITION BY seq_name, frame_idx, det_id ORDER BY cost, track_id) = 1 AS take
        FROM (SELECT seq_name, frame_idx, track_id, det_id, cost FROM rounds WHERE NOT gone))
)"""


@query("o6_greedy_rounds", f"WITH RECURSIVE {GREEDY} SELECT seq_name, frame_idx, track_id, det_id, round(cost, 6) AS cost FROM rounds WHERE take", "gt", "det")
def o6(gt, det):
    return K.greedy_rounds(edges_of(gt, det)).select(*KEYS, "track_id", "det_id", r6(C("cost"), "cost"))


@query("j9_matched_greedy", f"WITH RECURSIVE {GREEDY} SELECT seq_name, frame_idx, d.det_id, round(score, 6) AS score FROM det d SEMI JOIN (SELECT * FROM rounds WHERE take) r USING (seq_name, frame_idx, det_id)", "gt", "det")
def j9(gt, det):
    """Detections that some label takes, the nearest pairs first."""
    return matching.matched(det, K.greedy_rounds(edges_of(gt, det))).select(*KEYS, "det_id", r6(C("score"), "score"))


@query("j8_unmatched_greedy", f"WITH RECURSIVE {GREEDY} SELECT seq_name, frame_idx, d.det_id, round(score, 6) AS score FROM det d ANTI JOIN (SELECT * FROM rounds WHERE take) r USING (seq_name, frame_idx, det_id)", "gt", "det")
def j8(gt, det):
    return matching.unmatched(det, K.greedy_rounds(edges_of(gt, det))).select(*KEYS, "det_id", r6(C("score"), "score"))
