from trackloom.operators import matching


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_frames_travel_once(spark):
    kind = "seq_name string, frame_idx int, {0} int, cx double, cy double, cz double, l double, w double, h double, rot_z double"
    box = lambda i, x: ("s", i % 3, i, x, 0.3 * x, 0.0, 1.0, 1.0, 1.0, 0.0)
    a = spark.createDataFrame([box(i, 0.21 * i - 3) for i in range(40)], kind.format("track_id"))
    b = spark.createDataFrame([box(i, 0.2 * i - 3.1) for i in range(40)], kind.format("det_id"))
    pairs = matching.candidates(a.hint("merge"), b.hint("merge"), 0.45, top_k=8)
    assert exchanges(pairs) == 2 and exchanges(matching.assign(matching.edges_of(pairs))) == 2
    near = {(x["track_id"], y["det_id"]) for x in a.collect() for y in b.collect() if x["frame_idx"] == y["frame_idx"] and (x["cx"] - y["cx"]) ** 2 + (x["cy"] - y["cy"]) ** 2 <= 0.45 * 0.45}
    assert {(r["track_id"], r["det_id"]) for r in matching.candidates(a, b, 0.45).collect()} == near and near
