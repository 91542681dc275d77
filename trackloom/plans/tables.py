"""Track tables that Spark derives from the star-schema tables: labels, detections, frames, poses and frame statistics.

The same derivations as SQL are in SQL_TABLES, for checking. A sequence stands for a group of suppliers, a frame for a
group of orders; lines are objects in a frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = """
SELECT concat('seq_', lpad(cast(l_suppkey % n.n_seq AS {string}), 4, '0')) AS seq_name, cast(l_orderkey % 200 AS int) AS frame_idx,
  cast(row_number() OVER (PARTITION BY l_suppkey % n.n_seq, l_orderkey % 200 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS int) AS track_id,
  cast(l_discount AS double) AS disc, cast(l_tax AS double) AS tax, cast(l_quantity AS double) AS qty, l_returnflag, l_linestatus, l_linenumber
FROM lineitem CROSS JOIN (SELECT greatest(1, count(*) {div} 10) AS n_seq FROM supplier) n
"""

GT = """
SELECT seq_name, frame_idx, track_id, cast(0.6 AS double) * (track_id % 8) + cast(0.02 AS double) * frame_idx AS cx, cast(2.0 AS double) * floor(track_id / 8) AS cy,
  cast(0.9 AS double) AS cz, cast(0.6 AS double) AS l, cast(0.5 AS double) AS w, cast(1.7 AS double) AS h, cast(0.1 AS double) * (track_id % 16) AS rot_z
FROM base
"""

DET = """
SELECT seq_name, frame_idx, track_id * 2 AS det_id, cast(0.6 AS double) * (track_id % 8) + cast(0.02 AS double) * frame_idx + (disc - cast(0.05 AS double)) * 6 AS cx,
  cast(2.0 AS double) * floor(track_id / 8) + (tax - cast(0.04 AS double)) * 5 AS cy, cast(0.9 AS double) AS cz, cast(0.6 AS double) AS l, cast(0.5 AS double) AS w, cast(1.7 AS double) AS h,
  cast(0.1 AS double) * (track_id % 16) + disc AS rot_z, cast(0.5 AS double) + qty / 100 AS score
FROM base WHERE NOT (l_returnflag = 'A' AND l_linestatus = 'F')
UNION ALL
SELECT seq_name, frame_idx, track_id * 2 + 1, cast(0.6 AS double) * (track_id % 8) + cast(0.02 AS double) * frame_idx + cast(0.9 AS double),
  cast(2.0 AS double) * floor(track_id / 8) + cast(0.9 AS double), cast(0.9 AS double), cast(0.6 AS double), cast(0.5 AS double), cast(1.7 AS double), cast(0.0 AS double), cast(0.5 AS double) + qty / 200
FROM base WHERE l_linenumber = 7
"""

FRAMES = "SELECT DISTINCT seq_name, frame_idx FROM base"

POSES = """
SELECT seq_name, frame_idx, cast(frame_idx AS bigint) * 66666667 AS timestamp_ns, cast(0.05 AS double) * frame_idx AS x, cast(0.01 AS double) * frame_idx AS y, cast(0.0 AS double) AS z,
  cast(0.0 AS double) AS qx, cast(0.0 AS double) AS qy, sin(cast(0.005 AS double) * frame_idx) AS qz, cos(cast(0.005 AS double) * frame_idx) AS qw
FROM frames
"""

STATS = """
SELECT concat('seq_', cast(user_id % 10 AS {string})) AS seq_name, cast(row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) - 1 AS int) AS frame_idx,
  cast(value AS double) AS step_ms, cast(event_id % 30 AS int) AS num_det_in
FROM events
"""

TABLES = {"base": BASE, "gt": GT, "det": DET, "frames": FRAMES, "poses": POSES, "frame_stats": STATS}


def derived(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The named tables of TABLES over the Parquet tables in sf_dir."""
    from_parquet = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "supplier", "events")}

    def table(name: str) -> DataFrame:
        sql = TABLES[name].format(string="string", div="div")
        needed = {t: table(t) for t in ("base", "frames") if f"FROM {t}" in sql}
        used = {t: df for t, df in from_parquet.items() if f"FROM {t}" in sql}
        for t in sorted({**needed, **used}, key=len, reverse=True):
            sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
        return spark.sql(sql, **needed, **used)

    return [table(n) for n in names]


def with_sql(query: str, *names: str) -> str:
    """A query over the named tables as one statement for DuckDB."""
    chain = {"gt": ("base",), "det": ("base",), "frames": ("base",), "poses": ("base", "frames")}
    order = dict.fromkeys(t for n in names for t in (*chain.get(n, ()), n))
    ctes = ", ".join(f"{t} AS ({TABLES[t].format(string='varchar', div='//')})" for t in order)
    if query.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {query[15:]}"
    return f"WITH {ctes}, {query[5:]}" if query.startswith("WITH ") else f"WITH {ctes} {query}"
