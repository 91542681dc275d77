import math

import numpy as np
import pytest

from trackloom.functions.geometry import rectangle_overlap
from trackloom.operators.matching import assigned_pairs
from trackloom.streaming.mixture import DEFAULTS, Mixture, MixtureTracker
from trackloom.streaming.tracker import CLASS_PRESET, Adapted, AssistedTracker, Clock, Settings, register_tracker, run, run_info, run_many, run_stream

DETS = "seq_name string, frame_idx int, det_id int, cx double, cy double, cz double, l double, w double, h double, rot_z double, score double"
LABELS = "seq_name string, frame_idx int, track_id int, cx double, cy double, cz double, l double, w double, h double, rot_z double"
SHAPE = (0.9, 0.6, 0.5, 1.7, 0.1)


class Plain:
    """The assisted tracker's rules, one track and one number at a time."""

    def __init__(self, s):
        self.s, self.t, self.n, self.true, self.false, self.before, self.next = s, 0.0, 0, {}, {}, {}, s.false_offset

    def gain(self, dt, tau):
        return 1 - math.exp(-max(dt, 0) / max(tau, 1e-9))

    def fresh(self, key, box, now):
        return dict(id=key, key=key, epoch=0, box=list(box[:7]), e=0.0, ok=False, hits=0, seen=now, obs=[], speed=0.0, vel=(0.0, 0.0), prev=tuple(box[:2]), fv=(0.0, 0.0), moving=False, up=0, down=0, lv=(0.0, 0.0))

    def static(self, t):
        if len(t["obs"]) < max(3, self.s.static_window // 2):
            return False
        mx, my = (sum(p[i] for p in t["obs"]) / len(t["obs"]) for i in (0, 1))
        return t["speed"] < self.s.static_speed_mps and max(math.hypot(x - mx, y - my) for x, y in t["obs"]) < self.s.static_radius_m

    def predict(self, t, dt, label):
        if label is not None:
            for i in range(3):
                t["box"][i] += label[i]
        elif not self.static(t):
            t["box"][0] += t["vel"][0] * dt
            t["box"][1] += t["vel"][1] * dt

    def hit(self, t, score, dt):
        a, s = self.gain(dt, self.s.tau_hit_s), 1.0 if math.isnan(score) else score
        x = min(1, max(0, (s - self.s.score_floor) / (1 - self.s.score_floor))) ** self.s.score_power
        t["e"] = (1 - a) * t["e"] + a * x
        t["hits"] += 1
        t["ok"] = t["ok"] or t["hits"] >= self.s.confirm_hits and t["e"] >= self.s.theta_on

    def push(self, t, d, dt):
        t["obs"] = (t["obs"] + [tuple(d[:2])])[-self.s.static_window :]
        if len(t["obs"]) > 1:
            (x0, y0), (x1, y1) = t["obs"][-2:]
            vx, vy, b = (x1 - x0) / dt, (y1 - y0) / dt, self.s.speed_keep
            t["speed"] = b * t["speed"] + (1 - b) * math.hypot(vx, vy)
            t["vel"] = (b * t["vel"][0] + (1 - b) * vx, b * t["vel"][1] + (1 - b) * vy)

    def correct(self, t, d, dt):
        s, p, z = self.s, t["box"][:2], d[:2]
        r = (z[0] - p[0], z[1] - p[1])
        vm = tuple((z[i] - t["prev"][i]) / dt for i in (0, 1))
        nv, nl = math.hypot(*vm), math.hypot(*t["lv"])
        cos = (vm[0] * t["lv"][0] + vm[1] * t["lv"][1]) / nv / nl if nl > 1e-3 and nv > 1e-3 else 0.0
        if nv >= s.enter_mps and (cos >= s.same_way_cos or nl <= 1e-3):
            t["up"], t["down"] = t["up"] + 1, 0
        elif nv <= s.exit_mps:
            t["up"], t["down"] = 0, t["down"] + 1
        else:
            t["up"], t["down"] = max(0, t["up"] - 1), max(0, t["down"] - 1)
        t["lv"] = vm
        if t["up"] >= s.enter_frames:
            t["moving"] = True
        if t["moving"] and t["down"] >= s.exit_frames:
            t["moving"] = False
        if t["moving"]:
            u = t["fv"] if math.hypot(*t["fv"]) >= 1e-3 else vm
            n = math.hypot(*u)
            u = (u[0] / n, u[1] / n) if n >= 1e-9 else (1.0, 0.0)
            along = r[0] * u[0] + r[1] * u[1]
            kp, kc = self.gain(dt, s.tau_along_s), self.gain(dt, s.tau_across_s)
            new = tuple(p[i] + kp * along * u[i] + kc * (r[i] - along * u[i]) for i in (0, 1))
        else:
            k = self.gain(dt, s.tau_static_s)
            new = tuple(p[i] + k * r[i] for i in (0, 1))
        a = self.gain(dt, s.tau_velocity_s)
        t["fv"] = tuple((1 - a) * t["fv"][i] + a * (new[i] - t["prev"][i]) / dt for i in (0, 1))
        t["prev"], t["box"] = new, [*new, *d[2:7]]

    def match(self, tracks, costs, dets, now):
        s, edges = self.s, []
        for i, (t, c) in enumerate(zip(tracks, costs)):
            near = sorted((math.hypot(t["box"][0] - d[0], t["box"][1] - d[1]), j) for j, d in enumerate(dets))
            for far, j in [x for x in near if x[0] <= s.dist_gate_m][: s.top_k]:
                if abs(t["box"][2] - dets[j][2]) <= s.z_gate_m:
                    box = lambda b: np.array([[b[0], b[1], b[3], b[4], b[6]]])
                    late = min(max(now - t["seen"], 0), s.stale_cap_s)
                    edges.append((i, j, (1 - rectangle_overlap(box(c), box(dets[j]))[0]) * s.iou_weight + math.hypot(c[0] - dets[j][0], c[1] - dets[j][1]) + s.stale_m_per_s * late))
        if not edges:
            return {}
        a, b, c = (np.array(x) for x in zip(*edges))
        return {int(a[e]): int(b[e]) for e in assigned_pairs(a, b, c)}

    def observe(self, t, d, now, dt):
        gap = max(1e-6, now - t["seen"])
        self.hit(t, d[7], dt)
        self.correct(t, d, gap)
        t["seen"] = now
        self.push(t, d, gap)

    def step(self, dets, labels, time):
        s = self.s
        dt = 1 / s.fps if time is None or self.n == 0 else max(1e-6, time - self.t)
        self.t = self.t + dt if time is None else time
        self.n += 1
        now = self.t
        for k, t in self.true.items():
            known = k in labels and k in self.before
            self.predict(t, dt, [labels[k][i] - self.before[k][i] for i in range(3)] if known else None)
        for t in self.false.values():
            self.predict(t, dt, None)
        for k, b in labels.items():
            self.true.setdefault(k, self.fresh(k, b, now))
        keys = list(self.true)
        pairs = self.match([self.true[k] for k in keys], [labels.get(k, self.true[k]["box"]) for k in keys], dets, now)
        for i, k in enumerate(keys):
            t = self.true[k]
            if i not in pairs:
                t["e"] *= 1 - self.gain(dt, s.tau_miss_s)
                continue
            d = dets[pairs[i]]
            if now - t["seen"] > (s.reid_static_s if self.static(t) else s.reid_s):
                new = self.fresh(k, d, now)
                new |= {"box": t["box"], "seen": t["seen"], "epoch": t["epoch"] + 1, "id": k + (t["epoch"] + 1) * s.epoch_stride}
                t.clear()
                t.update(new)
            self.observe(t, d, now, dt)
        rest = [d for j, d in enumerate(dets) if j not in set(pairs.values())]
        keys = list(self.false)
        pairs = self.match([self.false[k] for k in keys], [self.false[k]["box"] for k in keys], rest, now)
        for i, k in enumerate(keys):
            t = self.false[k]
            if i in pairs:
                self.observe(t, rest[pairs[i]], now, dt)
            else:
                t["e"] *= 1 - self.gain(dt, s.tau_miss_s)
                if now - t["seen"] > (s.reid_static_s if self.static(t) else s.reid_s):
                    del self.false[k]
        for j, d in enumerate(rest):
            if j not in set(pairs.values()):
                t = self.false[self.next] = self.fresh(self.next, d, now)
                self.next += 1
                self.hit(t, d[7], dt)
                self.push(t, d, dt)
        self.before = labels
        shown = []
        for t in [*self.true.values(), *self.false.values()]:
            x = min(1, max(0, (t["e"] - s.theta_on) / (1 - s.theta_on))) ** s.out_gamma
            if t["ok"] and now - t["seen"] <= max(1e-6, s.out_min_s + (s.out_max_s - s.out_min_s) * x):
                shown.append((t["id"], *t["box"], s.output_score, t["hits"]))
        return shown


def scene(seed, frames=160):
    """Walkers that stop, vanish and come back, with noise, ghosts and missing scores."""
    rng = np.random.default_rng(seed)
    place, speed = rng.uniform(0, 4, (6, 2)), rng.normal(0, 0.03, (6, 2)) * (rng.random(6) < 0.7)[:, None]
    out = []
    for f in range(frames):
        place = place + speed
        there = [k for k in range(6) if not (k == 2 and 40 < f < 110) and not (k == 4 and 20 < f < 25)]
        labels = {k: np.array([*place[k], *SHAPE]) for k in there if rng.random() < 0.97}
        dets = [[*(place[k] + rng.normal(0, 0.04, 2)), *SHAPE, rng.choice([np.nan, rng.uniform(0.3, 1)], p=[0.1, 0.9])] for k in there if rng.random() < 0.8]
        dets += [[*(np.array([1.0, 1.0]) + 0.02 * f), *SHAPE, 0.9]] * (f % 5 != 0) + [[*rng.uniform(0, 4, 2), *SHAPE, 0.5]] * (rng.random() < 0.3)
        out.append((np.array(dets).reshape(-1, 8), labels, 0.07 * f + 0.01 * rng.random()))
    return out


@pytest.mark.parametrize("seed,preset,timed", [(1, {}, False), (2, CLASS_PRESET, True), (3, {}, True)])
def test_assisted_tracker_follows_the_rules(seed, preset, timed):
    s = Settings(**preset)
    fast, plain, ids = AssistedTracker(s), Plain(s), set()
    for f, (dets, labels, time) in enumerate(scene(seed)):
        got = sorted(fast.step_with_labels(f, dets, labels, time if timed else None))
        want = sorted(plain.step(dets.tolist(), {k: v.tolist() for k, v in labels.items()}, time if timed else None))
        assert [g[0] for g in got] == [w[0] for w in want] and np.allclose(np.array(got), np.array(want), atol=1e-9), f
        ids |= {g[0] for g in got}
    assert {0, 1, 3} <= ids and max(ids) >= s.false_offset and (seed != 1 or 100_002 in ids)


def test_by_hand():
    t, box = AssistedTracker(Settings()), lambda x: np.array([x, 0.0, *SHAPE])
    shown = []
    for f in range(100):
        seen = f < 5 or f >= 90
        shown.append(t.step_with_labels(f, np.array([[*box(0.1 * f), 1.0]] if seen else []).reshape(-1, 8), {7: box(0.1 * f)}))
    # 1 - exp(-1/3) = 0.283: evidence is 0.283, 0.487, 0.632, so the third hit confirms
    assert [len(x) for x in shown[:5]] == [0, 0, 1, 1, 1]
    # 0.5 s at least, 1.5 s at most after the last hit at frame 4; the box goes on with its label
    assert all(x[0][0] == 7 for x in shown[5:12]) and not shown[27] and abs(shown[8][0][1] - shown[7][0][1] - 0.1) < 1e-9
    # away for 86 frames, 5.7 s, which is over 2.5 s: another id, confirmed anew by its third hit
    assert [[y[0] for y in x] for x in shown[90:94]] == [[], [], [100_007], [100_007]]


def test_clock():
    clock = Clock(10.0)
    assert [clock.tick(t) for t in (None, None)] == [0.1, 0.1]
    for late, last in (("clamp", 1e-6), ("nominal", 0.1)):
        clock = Clock(10.0, late)
        assert np.allclose([clock.tick(t) for t in (5.0, 5.5, 5.2)], [0.1, 0.5, last])
    clock = Clock(10.0, "error")
    clock.tick(5.0)
    with pytest.raises(ValueError):
        clock.tick(4.0)
    with pytest.raises(ValueError):
        Clock(10.0, "other")


def rows_of(seed, frames=60):
    dets, labels = [], []
    for seq in ("a", "b", "c"):
        for f, (d, l, _) in enumerate(scene(seed + ord(seq), frames)):
            dets += [(seq, f, i, *map(float, x)) for i, x in enumerate(d)]
            labels += [(seq, f, k, *map(float, x)) for k, x in l.items()]
    return dets, labels


def test_batches_and_partitions_do_not_matter(spark):
    dets, labels = rows_of(5)
    d, g = spark.createDataFrame(dets, DETS), spark.createDataFrame(labels, LABELS)
    frames = spark.createDataFrame([(s, f) for s in "abc" for f in range(60)], "seq_name string, frame_idx int")
    want = []
    for seq in "abc":
        t = AssistedTracker(Settings())
        for f in range(60):
            now = np.array([x[3:] for x in dets if x[:2] == (seq, f)]).reshape(-1, 8)
            want += [(seq, f, *x) for x in t.step_with_labels(f, now, {x[2]: np.array(x[3:]) for x in labels if x[:2] == (seq, f)})]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (old, "7"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            assert sorted(map(tuple, run(d.repartition(5), "assisted", Settings(), g, frames).collect())) == sorted(want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_frames_without_detections_are_steps(spark):
    d = spark.createDataFrame([("a", f, 0, 0.0, 0.0, *SHAPE, 1.0) for f in (0, 1, 2, 30, 31, 32)], DETS)
    frames = spark.range(40).selectExpr("'a' AS seq_name", "cast(id AS int) AS frame_idx", "id / 15.0D AS time")
    with_frames = {r.track_id for r in run(d, "nearest", Settings(), frames=frames).collect()}
    without = {r.track_id for r in run(d, "nearest", Settings()).collect()}
    assert with_frames == {1, 2} and without == {1}


def test_stream_is_batch(spark, tmp_path):
    dets, _ = rows_of(9, 24)
    df = spark.createDataFrame(dets, DETS)
    for name in ("nearest", "assisted"):
        want = sorted(map(tuple, run(df, name, Settings()).collect()))
        for k in range(3):
            df.filter(f"frame_idx div 8 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/in")
            query = run_stream(spark.readStream.schema(DETS).parquet(f"{tmp_path}/{name}/in"), name, Settings()).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/{name}/check").trigger(availableNow=True).start(f"{tmp_path}/{name}/out")
            query.awaitTermination(120)
        got = spark.read.schema(run(df, name, Settings()).schema).parquet(f"{tmp_path}/{name}/out").collect()
        assert sorted(map(tuple, got)) == want and want


def test_registry_and_contract(spark):
    class Twice:
        def __init__(self, settings):
            pass

        def step(self, frame, boxes, time=None):
            return [(1, *b.tolist(), 1) for b in boxes]

    register_tracker("twice", Twice)
    one, two = ([("a", 0, i, 0.0, 0.0, *SHAPE, 1.0) for i in range(n)] for n in (1, 2))
    assert run(spark.createDataFrame(one, DETS), "twice", Settings()).count() == 1
    with pytest.raises(Exception, match="one id twice"):
        run(spark.createDataFrame(two, DETS), "twice", Settings()).collect()
    assert run(spark.createDataFrame([], DETS), "assisted", Settings()).collect() == []
    assert run_info("assisted", Settings())["fps"] == "15.0"


def test_mixture_is_three_filters_one_by_one():
    rng, m = np.random.default_rng(6), Mixture(DEFAULTS)
    m.add(np.array([[0.0, 0.0], [5.0, 1.0]]))
    x, p, w = np.array([[5.0, 1, 0, 0, 0, 0]] * 3), np.array([np.diag([0.25**2] * 2 + [1.0] * 2 + [4.0] * 2)] * 3), np.array(DEFAULTS["first"])
    switch, h = np.array(DEFAULTS["switch"]), np.eye(2, 6)
    for k in range(25):
        dt = 0.07
        c = w @ switch
        mixed = [(sum(w[i] * switch[i, j] / c[j] * x[i] for i in range(3)), j) for j in range(3)]
        p = np.array([sum(w[i] * switch[i, j] / c[j] * (p[i] + np.outer(x[i] - mj, x[i] - mj)) for i in range(3)) for mj, j in mixed])
        x = np.array([mj for mj, _ in mixed])
        one = np.array([[[1, 0, 0], [0, 0.3, 0], [0, 0, 0]], [[1, dt, 0], [0, 1, 0], [0, 0, 0]], [[1, dt, dt * dt / 2], [0, 1, dt], [0, 0, 1]]])
        for j in range(3):
            f = np.kron(one[j], np.eye(2))
            x[j], p[j] = f @ x[j], f @ p[j] @ f.T + np.diag(np.repeat(np.array(DEFAULTS["noise"][j]) ** 2, 2)) * dt
        m.predict(dt)
        if k % 4 != 3:
            z = np.array([5 + 0.08 * k, 1 - 0.02 * k]) + rng.normal(0, 0.05, 2)
            v = (w @ x)[2:4]
            speed = math.hypot(*v)
            u = v / max(speed, 1e-9)
            r = 0.25**2 * np.eye(2) if speed < 0.15 else 0.35**2 * np.eye(2) + (0.15**2 - 0.35**2) * np.outer(u, u)
            ll = []
            for j in range(3):
                y, s = z - h @ x[j], h @ p[j] @ h.T + r
                g = p[j] @ h.T @ np.linalg.inv(s)
                ll.append(-0.5 * (math.log(np.linalg.det(s)) + y @ np.linalg.inv(s) @ y))
                x[j], p[j] = x[j] + g @ y, (np.eye(6) - g @ h) @ p[j]
            w = (w @ switch) * np.exp(np.array(ll) - max(ll))
            w /= w.sum()
            m.update(np.array([1]), z[None])
        assert np.allclose(m.x[1], x) and np.allclose(m.p[1], p) and np.allclose(m.weight[1], w)
    assert m.fused()[0][1, 2] > 0.8 and w[0] < 0.2  # it goes 0.08 m a step, 1.1 m a second


def test_mixture_tracker():
    t, ids = MixtureTracker(Settings()), set()
    for f, (dets, labels, time) in enumerate(scene(1)):
        out = t.step_with_labels(f, dets, labels, time)
        ids |= {x[0] for x in out}
        for x in out:
            if x[0] in labels:
                assert math.hypot(x[1] - labels[x[0]][0], x[2] - labels[x[0]][1]) < 0.5
    assert {0, 1, 3} <= ids and max(ids) >= Settings().false_offset


def test_several_runs_and_adapters(spark):
    dets, labels = rows_of(5, 20)
    d, g = spark.createDataFrame(dets, DETS), spark.createDataFrame(labels, LABELS)
    rows = run_many(d, {"a": ("passthrough", Settings()), "b": ("mixture", Settings())}, g).collect()
    assert sum(r.run_name == "a" for r in rows) == len(dets) and {r.run_name for r in rows} == {"a", "b"}

    def numbered(frame, rows, time):
        return np.column_stack([np.arange(len(rows)), rows])

    for layout in ("scored", "camera", "record", "row"):
        boxes = np.array([[1.0, 2.0, 0.9, 0.6, 0.5, 1.7, 0.3, 0.8], [3.0, -2.0, 0.8, 0.7, 0.5, 1.6, 0.2, 0.4]])
        got = Adapted(numbered, layout, layout).step(0, boxes)
        want = boxes if layout == "scored" else np.column_stack([boxes[:, :7], np.ones(2)])
        assert [g[0] for g in got] == [0, 1] and np.allclose([g[1:9] for g in got], want)
    with pytest.raises(ValueError):
        Adapted(numbered, "scored", "row").step(0, boxes)
    assert Adapted(numbered).step(0, np.zeros((0, 8))) == []
