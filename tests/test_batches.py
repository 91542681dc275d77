import numpy as np
import pandas as pd

from trackloom.operators import corruption
from trackloom.operators.batches import starts, whole_groups


def test_batches_end_where_groups_end():
    pdf = pd.DataFrame({"a": ["x", "x", None, None, "y", "y", "y", "z"], "b": [1, 1, 2, 2, 2, 2, 2, 2]})
    assert starts(pdf, ["a", "b"]).tolist() == [0, 2, 4, 7]
    for size in (1, 2, 3, 8):
        parts = list(whole_groups((pdf.iloc[i : i + size] for i in range(0, 8, size)), ["a", "b"]))
        assert pd.concat(parts, ignore_index=True).equals(pdf)
        assert sum(len(starts(p, ["a", "b"])) for p in parts) == 4


def test_tracks_travel_once_for_all_variants_whatever_batches_are(spark):
    rows = [("s", t, f, 0.1 * f, 2.0 * t, 0.9, 0.6, 0.5, 1.7, 0.2) for t in range(4) for f in range(40)]
    boxes = spark.createDataFrame(rows, "seq_name string, track_id int, frame_idx int, cx double, cy double, cz double, l double, w double, h double, rot_z double")
    out = corruption.corrupt(boxes, corruption.resolve(corruption.EXAMPLE), 5, {"tp": [0.8, 0.9], "fp": [0.1]})
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()  # rows are not copied for each variant before they are sorted
    found = []
    for size in ("10000", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        found.append(sorted(map(tuple, out.collect())))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found[0] == found[1] and len({r[0] for r in found[0]}) == 6
