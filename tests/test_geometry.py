import numpy as np

from trackloom.functions.geometry import rectangle_overlap
from trackloom.operators.corruption import DEFAULTS, EXAMPLE, confused, corrupt, group_seed, resolve, scaled, seen_rows, switched
from trackloom.operators.matching import assigned_pairs
from trackloom.sources import formats


def grid_overlap(a, b, n=700):
    lim = 4.0
    x, y = np.meshgrid(np.linspace(-lim, lim, n), np.linspace(-lim, lim, n))

    def inside(r):
        dx, dy = x - r[0], y - r[1]
        u, v = dx * np.cos(r[4]) + dy * np.sin(r[4]), dy * np.cos(r[4]) - dx * np.sin(r[4])
        return (np.abs(u) <= r[2] / 2) & (np.abs(v) <= r[3] / 2)

    i, j = inside(a), inside(b)
    return (i & j).sum() / max(1, (i | j).sum())


def test_overlap():
    rng = np.random.default_rng(3)
    a, b = ([[*rng.uniform(-1, 1, 2), *rng.uniform(0.8, 3, 2), rng.uniform(-4, 4)] for _ in range(25)] for _ in range(2))
    got = rectangle_overlap(np.array(a), np.array(b))
    assert np.allclose(got, [grid_overlap(x, y) for x, y in zip(a, b)], atol=0.02)
    same = np.array([[3.0, 2.0, 2.0, 1.0, 0.7]])
    assert np.allclose(rectangle_overlap(same, same), 1)
    assert rectangle_overlap(same, same + [[9, 0, 0, 0, 0]])[0] == 0 and rectangle_overlap(same * [[1, 1, 0, 1, 1]], same)[0] == 0


def test_assignment_is_largest_then_cheapest():
    rng = np.random.default_rng(5)
    for _ in range(60):
        n, m = rng.integers(1, 5, 2)
        edges = [(i, j, float(rng.integers(0, 6))) for i in range(n) for j in range(m) if rng.random() < 0.6]
        if not edges:
            continue
        t, d, c = (np.array(x) for x in zip(*edges))

        def best(k, used, size, cost):
            if k == len(edges):
                return (-size, cost)
            skip = best(k + 1, used, size, cost)
            i, j, w = edges[k]
            if ("t", i) in used or ("d", j) in used:
                return skip
            return min(skip, best(k + 1, used | {("t", i), ("d", j)}, size + 1, cost + w))

        got = assigned_pairs(t, d, c)
        assert (-len(got), c[got].sum()) == best(0, frozenset(), 0, 0.0)
        assert len(set(t[got])) == len(set(d[got])) == len(got)


def test_assignment_of_many_frames_at_once():
    rng = np.random.default_rng(8)
    parts = [(rng.integers(0, 6, 12) + 100 * f, rng.integers(0, 6, 12) + 100 * f, rng.integers(0, 9, 12) / 4) for f in range(40)]
    t, d, c = (np.concatenate(x) for x in zip(*parts))
    for method in ("optimal", "greedy"):
        alone = np.concatenate([assigned_pairs(*p, method) + 12 * f for f, p in enumerate(parts)])
        got = assigned_pairs(t, d, c, method)
        assert len(got) == len(alone) and abs(c[got].sum() - c[alone].sum()) < 1e-9


def test_variants():
    variants = resolve(EXAMPLE)
    assert [v["name"] for v in variants] == ["clean", "dropout_light", "dropout_heavy", "switching_on", "confusers_near", "all"]
    heavy = scaled(variants[2] | {"severity": 20.0, "confuser_p_static": 0.3, "instability_mode_xy_sigma_m": 0.1})
    assert heavy["dropout_p_start"] == 1.0 and heavy["confuser_p_static"] == 0.3 and heavy["instability_mode_xy_sigma_m"] == 2.0 and heavy["dropout_max_s"] == 0.8
    assert group_seed(1, "a", "b") == group_seed(1, "b", "a")


def track_of(n):
    return np.arange(n), np.column_stack([0.1 * np.arange(n), np.zeros(n), np.full(n, 0.9), np.full(n, 0.6), np.full(n, 0.5), np.full(n, 1.7), np.full(n, 0.1)])


def test_switching_goes_to_each_other_mode_alike():
    _, boxes = track_of(30_000)
    out = switched(boxes, DEFAULTS | {"instability_enable": True, "instability_k_modes": 4, "instability_p_switch": 0.25, "instability_mode_xy_sigma_m": 0.5, "instability_mode_lwh_sigma_rel": 0.1}, np.random.default_rng(2))
    off = np.round(out[:, :2] - boxes[:, :2], 9)
    modes, at = np.unique(off, axis=0, return_inverse=True)
    assert len(modes) == 4 and np.abs(modes).max() <= 1.0
    moves = np.flatnonzero(at[1:] != at[:-1])
    assert abs(len(moves) / len(boxes) - 0.25) < 0.02
    counts = np.array([np.bincount(at[1:][moves][at[:-1][moves] == a], minlength=4) for a in range(4)])
    shares = counts / counts.sum(axis=1, keepdims=True)
    assert np.allclose(shares[~np.eye(4, dtype=bool)], 1 / 3, atol=0.05)
    assert np.allclose(out[:, 2] - out[:, 5] / 2, boxes[:, 2] - boxes[:, 5] / 2)  # bottoms stay


def test_bursts_run_over_frames():
    frames = np.arange(0, 40_000, 2)
    seen = seen_rows(frames, DEFAULTS | {"dropout_p_start": 0.02, "dropout_min_s": 0.4, "dropout_max_s": 0.8}, np.random.default_rng(3))
    edges = np.flatnonzero(np.diff(seen.astype(int)))
    gone = np.diff(edges)[::2] if not seen[edges[0] + 1] else np.diff(edges)[1::2]
    assert gone.min() == 3 and 6 <= gone.max() <= 18  # 6 to 12 frames are 3 to 6 rows; bursts may follow each other
    assert 0.05 < 1 - seen.mean() < 0.12


def test_confusers():
    frames, boxes = track_of(6000)
    v = DEFAULTS | {"confuser_p_start": 0.3, "confuser_min_s": 1.0, "confuser_max_s": 2.0, "confuser_max_active": 2, "confuser_p_static": 0.4, "confuser_offset_xy_mu_m": 0.8, "confuser_offset_xy_sigma_m": 0.1}
    seen = frames % 10 != 3
    rows, made = confused(frames, boxes, seen, v, np.random.default_rng(4))
    assert np.bincount(rows).max() == 2 and seen[rows].all()
    rows, made = confused(frames, boxes, seen, v | {"confuser_p_static": 0.0}, np.random.default_rng(4))
    far = np.hypot(*(made[:, :2] - boxes[rows, :2]).T)
    assert 0.6 - 1e-9 <= far.min() and far.max() <= 1.0 + 1e-9
    rows, made = confused(frames, boxes, seen, v | {"confuser_p_static": 1.0}, np.random.default_rng(4))
    assert len(np.unique(made[:, :2].round(9), axis=0)) < len(made) / 8  # they stand
    rows, _ = confused(frames, boxes, seen, v | {"confuser_only_when_primary_present": False}, np.random.default_rng(4))
    assert not seen[rows].all()


def test_corruption(spark):
    variants = resolve(EXAMPLE)
    rows = [("s", t, f, 1.0 * f, 0.0, 0.9, 0.6, 0.5, 1.7, 0.1) for t in range(3) for f in range(60)]
    df = spark.createDataFrame(rows, "seq_name string, track_id int, frame_idx int, cx double, cy double, cz double, l double, w double, h double, rot_z double")
    pools = {"tp": [0.8, 0.9], "fp": [0.1]}
    a, b = corrupt(df, variants, 5, pools).collect(), corrupt(df.repartition(7), variants, 5, pools).collect()
    assert sorted(a) == sorted(b)
    clean = [r for r in a if r.variant == "clean"]
    assert len(clean) == len(rows) and all(r.cx == r.frame_idx and r.score == 1 and r.kind == "tp" for r in clean)
    assert len([r for r in a if r.variant == "dropout_heavy"]) < len(rows)
    assert {(r.kind, r.score) for r in a if r.variant == "all"} == {("tp", 0.8), ("tp", 0.9), ("fp", 0.1)}


def test_formats(spark):
    doc = '{"dets": {"000001.pcd": [{"box": [1,2,3,4,5,6,7], "label_id": "pedestrian:9"}, {"box": {"cx":1,"cy":2,"cz":3,"l":4,"w":5,"h":6,"rot_z":7}, "label_id": "car", "score": 0.5, "track_id": 4}], "12": []}}'
    rows = formats.parse_boxes(spark.createDataFrame([("q", doc)], "seq_name string, value string")).orderBy("frame_idx", "det_pos").collect()
    assert [(r.frame_idx, r.track_id, r.label, r.score, r.rot_z) for r in rows] == [(1, 9, "pedestrian", None, 7.0), (1, 4, "unknown", 0.5, 7.0), (12, -1, "unknown", None, None)]
    poses = formats.parse_odometry(spark.createDataFrame([("q", "timestamp_ns,x,y,z,qx,qy,qz,qw\n5,1,2,3,0,0,0,1\n9,1,2,4,0,0,0,1\n")], "seq_name string, value string"))
    assert [(r.frame_idx, r.timestamp_ns, r.z) for r in poses.orderBy("frame_idx").collect()] == [(0, 5, 3.0), (1, 9, 4.0)]
