"""Seeded corruption of labelled tracks: dropout bursts, hypothesis switching, confusers and scores, for each variant."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators.batches import starts, whole_groups

#: The settings of a variant and what they are if nothing is said. Names say their unit: _s seconds, _m metres,
#: _rad radians, _rel a share of the size; those with _p_ are probabilities.
DEFAULTS = {
    "fps": 15.0, "class_name": "pedestrian", "severity": 1.0,
    "dropout_enable": False, "dropout_p_start": 0.0, "dropout_min_s": 0.0, "dropout_max_s": 0.0,
    "instability_enable": False, "instability_k_modes": 3, "instability_p_switch": 0.0,
    "instability_mode_xy_sigma_m": 0.0, "instability_mode_yaw_sigma_rad": 0.0, "instability_mode_lwh_sigma_rel": 0.0,
    "instability_jitter_xy_sigma_m": 0.0, "instability_jitter_yaw_sigma_rad": 0.0, "instability_jitter_lwh_sigma_rel": 0.0, "instability_p_yaw_random": 0.0,
    "confuser_enable": False, "confuser_p_start": 0.0, "confuser_min_s": 0.0, "confuser_max_s": 0.0, "confuser_max_active": 1, "confuser_p_static": 0.0,
    "confuser_offset_xy_mu_m": 0.0, "confuser_offset_xy_sigma_m": 0.0, "confuser_yaw_sigma_rad": 0.0, "confuser_lwh_sigma_rel": 0.0,
    "confuser_jitter_xy_sigma_m": 0.0, "confuser_jitter_yaw_sigma_rad": 0.0, "confuser_jitter_lwh_sigma_rel": 0.0, "confuser_p_yaw_random": 0.0,
    "confuser_static_offset_xy_mu_m": 0.0, "confuser_static_offset_xy_sigma_m": 0.0, "confuser_static_yaw_sigma_rad": 0.0, "confuser_static_lwh_sigma_rel": 0.0,
    "confuser_static_jitter_xy_sigma_m": 0.0, "confuser_static_jitter_yaw_sigma_rad": 0.0, "confuser_static_jitter_lwh_sigma_rel": 0.0, "confuser_static_p_yaw_random": 0.0,
    "confuser_only_when_primary_present": True, "score_value": 1.0, "score_mode": "constant", "score_dists": "",
}

EXAMPLE = {
    "base": {"instability_jitter_xy_sigma_m": 0.02},
    "single_mode_sweeps": {
        "dropout": [{"name": "light", "dropout_enable": True, "dropout_p_start": 0.02, "dropout_max_s": 0.4}, {"name": "heavy", "dropout_enable": True, "dropout_p_start": 0.1, "dropout_min_s": 0.2, "dropout_max_s": 0.8}],
        "switching": [{"name": "on", "instability_enable": True, "instability_p_switch": 0.2, "instability_mode_xy_sigma_m": 0.3, "instability_mode_lwh_sigma_rel": 0.1, "instability_p_yaw_random": 0.05}],
        "confusers": [{"name": "near", "confuser_enable": True, "confuser_p_start": 0.05, "confuser_min_s": 0.2, "confuser_max_s": 1.0, "confuser_max_active": 2, "confuser_p_static": 0.5, "confuser_offset_xy_mu_m": 0.8, "confuser_offset_xy_sigma_m": 0.2}],
    },
    "combos": [{"name": "all", "use": {"dropout": "heavy", "switching": "on", "confusers": "near"}, "overrides": {"score_mode": "sample", "severity": 1.5}}],
}


def is_probability(name: str) -> bool:
    return "_p_" in name


def resolve(spec: Mapping) -> list[dict]:
    """The variants of a spec: clean, each level of each sweep, and combinations of levels. Probabilities are clipped."""

    def made(name: str, *parts: Mapping) -> dict:
        out = dict(DEFAULTS)
        for part in parts:
            out |= {k: v for k, v in part.items() if k != "name"}
        if unknown := set(out) - set(DEFAULTS):
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return {k: min(1.0, max(0.0, v)) if is_probability(k) else v for k, v in out.items()} | {"name": name}

    base, sweeps = spec.get("base", {}), spec.get("single_mode_sweeps", {})
    levels = {(mode, level["name"]): level for mode, many in sweeps.items() for level in many}
    out = [made("clean")]
    out += [made(f"{mode}_{name}", base, level) for (mode, name), level in levels.items()]
    out += [made(c["name"], base, *(levels[m, n] for m, n in c.get("use", {}).items()), c.get("overrides", {})) for c in spec.get("combos", [])]
    if len({v["name"] for v in out}) < len(out):
        raise ValueError("variants must have names of their own")
    return out


def scaled(variant: Mapping) -> dict:
    """Probabilities (clipped) and magnitudes times the variant's severity; the share of static confusers stays."""
    s = variant["severity"]

    def grown(name: str, value: object) -> object:
        if name == "confuser_p_static":
            return value
        if is_probability(name):
            return min(1.0, value * s)
        return value * s if name.endswith(("_m", "_rad", "_rel")) else value

    return {k: grown(k, v) for k, v in variant.items()}


def group_seed(seed: int, *names: object) -> int:
    """A stable seed: checksums of the names added up, so it doesn't depend on the names' order."""
    return (seed + sum(zlib.adler32(str(n).encode()) for n in names)) % 2**32


def truncated_normal(rng: np.random.Generator, mean: float, sigma: float, size: int | tuple[int, ...]) -> np.ndarray:
    """Within two sigma of the mean, drawn again up to 50 times and then clipped; the mean itself for sigma <= 0."""
    if sigma <= 0:
        return np.full(size, mean)
    x = rng.normal(mean, sigma, size)
    for _ in range(50):
        far = np.abs(x - mean) > 2 * sigma
        if not far.any():
            break
        x[far] = rng.normal(mean, sigma, int(far.sum()))
    return np.clip(x, mean - 2 * sigma, mean + 2 * sigma)


def wrapped(a: np.ndarray) -> np.ndarray:
    return (a + np.pi) % (2 * np.pi) - np.pi


def frames_of(seconds: float, fps: float) -> int:
    return max(1, int(np.ceil(seconds * fps)))


def resized(boxes: np.ndarray, rel: np.ndarray) -> None:
    """Length, width and height times 1 + rel, at least a millimetre each; the bottom stays where it is."""
    size = np.maximum(boxes[:, 3:6] * (1 + rel), 1e-3)
    boxes[:, 2] += (size[:, 2] - boxes[:, 5]) / 2
    boxes[:, 3:6] = size


def jittered(boxes: np.ndarray, rng: np.random.Generator, xy: float, yaw: float, lwh: float, p_random: float) -> None:
    """Noise of each row on its own; a yaw drawn at random has none besides."""
    n = len(boxes)
    boxes[:, :2] += truncated_normal(rng, 0.0, xy, (n, 2))
    resized(boxes, truncated_normal(rng, 0.0, lwh, (n, 3)))
    anywhere = rng.random(n) < p_random
    boxes[:, 6] = wrapped(np.where(anywhere, rng.uniform(-np.pi, np.pi, n), boxes[:, 6] + truncated_normal(rng, 0.0, yaw, n)))


def switched(boxes: np.ndarray, v: Mapping, rng: np.random.Generator) -> np.ndarray:
    """The track as seen under hypotheses that it switches between: each has a bias of place, yaw and size of its own."""
    n, k = len(boxes), max(1, int(v["instability_k_modes"]))
    xy, yaw, lwh = (truncated_normal(rng, 0.0, v[f"instability_mode_{c}"], size) for c, size in (("xy_sigma_m", (k, 2)), ("yaw_sigma_rad", k), ("lwh_sigma_rel", (k, 3))))
    # a step of 1 to k - 1 around the circle of modes leads to each other one alike
    step = np.where(rng.random(n) < v["instability_p_switch"], rng.integers(1, max(k, 2), n), 0)
    step[:1] = rng.integers(0, k)
    mode = np.cumsum(step) % k
    out = boxes.copy()
    out[:, :2] += xy[mode]
    out[:, 6] = wrapped(out[:, 6] + yaw[mode])
    resized(out, lwh[mode])
    jittered(out, rng, *(v[f"instability_{c}"] for c in ("jitter_xy_sigma_m", "jitter_yaw_sigma_rad", "jitter_lwh_sigma_rel", "p_yaw_random")))
    return out


def seen_rows(frames: np.ndarray, v: Mapping, rng: np.random.Generator) -> np.ndarray:
    """Rows outside all dropout bursts. A burst begins at a row by chance and lasts for so many frames, in which none begins."""
    least = frames_of(v["dropout_min_s"], v["fps"])
    lengths = rng.integers(least, max(least, frames_of(v["dropout_max_s"], v["fps"])) + 1, len(frames))
    gone, end = np.zeros(len(frames), bool), -1
    for i in np.flatnonzero(rng.random(len(frames)) < v["dropout_p_start"]):
        if frames[i] >= end:
            end = frames[i] + lengths[i]
            gone |= (frames >= frames[i]) & (frames < end)
    return ~gone


def confused(frames: np.ndarray, boxes: np.ndarray, seen: np.ndarray, v: Mapping, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the track, boxes) of tracklets beside it, moving along or standing where they began, at most so many at a time."""
    near = seen if v["confuser_only_when_primary_present"] else np.ones(len(frames), bool)
    least = frames_of(v["confuser_min_s"], v["fps"]) if v["confuser_max_s"] > 0 else 1
    most = max(least, frames_of(v["confuser_max_s"], v["fps"])) if v["confuser_max_s"] > 0 else 1
    lengths, statics = rng.integers(least, most + 1, len(frames)), rng.random(len(frames)) < v["confuser_p_static"]
    ends: list[int] = []
    rows, out = [np.zeros(0, int)], [np.zeros((0, 7))]
    for i in np.flatnonzero(near & (rng.random(len(frames)) < v["confuser_p_start"])):
        ends = [e for e in ends if e > frames[i]]
        if len(ends) >= v["confuser_max_active"]:
            continue
        ends.append(int(frames[i] + lengths[i]))
        # of a static one, settings that are 0 are those of a moving one
        of = lambda name: (statics[i] and v[f"confuser_static_{name}"]) or v[f"confuser_{name}"]  # noqa: E731, B023
        far = abs(truncated_normal(rng, of("offset_xy_mu_m"), of("offset_xy_sigma_m"), 1)[0])
        angle = rng.uniform(-np.pi, np.pi)
        at = np.flatnonzero(near & (frames >= frames[i]) & (frames < ends[-1]))
        made = boxes[at].copy()
        if statics[i]:
            made[:, :2] = boxes[i, :2]
        made[:, :2] += far * np.array([np.cos(angle), np.sin(angle)])
        made[:, 6] += truncated_normal(rng, 0.0, of("yaw_sigma_rad"), 1)
        resized(made, truncated_normal(rng, 0.0, of("lwh_sigma_rel"), (1, 3)))
        jittered(made, rng, *(of(c) for c in ("jitter_xy_sigma_m", "jitter_yaw_sigma_rad", "jitter_lwh_sigma_rel", "p_yaw_random")))
        rows.append(at), out.append(made)
    return np.concatenate(rows), np.concatenate(out)


BOX = ["cx", "cy", "cz", "l", "w", "h", "rot_z"]


def corrupted(frames: np.ndarray, boxes: np.ndarray, v: Mapping, rng: np.random.Generator, scores: np.random.Generator, pools: Mapping[str, np.ndarray]) -> list[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """One track's detections under one variant, with severity applied: instability, dropout, confusers, scores, in this order; (kind, rows of the track, boxes, scores) of the
    true and the false ones. Bursts and tracklets run over frame numbers, which rise, not rows. Scores have random numbers of their own."""
    primary = switched(boxes, v, rng) if v["instability_enable"] else boxes
    seen = seen_rows(frames, v, rng) if v["dropout_enable"] and v["dropout_max_s"] > 0 else np.ones(len(frames), bool)
    rows, beside = confused(frames, boxes, seen, v, rng) if v["confuser_enable"] and v["confuser_max_active"] > 0 else (np.zeros(0, int), np.zeros((0, 7)))
    parts = []
    for kind, at, made in (("tp", np.flatnonzero(seen), primary[seen]), ("fp", rows, beside)):
        pool = pools.get(kind, ())
        drawn = np.asarray(pool)[scores.integers(0, len(pool), len(at))] if v["score_mode"] == "sample" and len(pool) else np.full(len(at), float(v["score_value"]))
        parts.append((kind, at, made, drawn))
    return parts


def corrupt(boxes: DataFrame, variants: list[dict], seed: int, pools: Mapping[str, list[float]] | None = None) -> DataFrame:
    """boxes(seq_name, track_id, frame_idx, box) under every variant, by tracks. Groups never meet: rows don't depend on partitions.

    pools: scores of true ('tp') and false ('fp') detections to draw from, a bounded sample (see sources.reports.score_pools). A track's rows travel once, for all variants, and a
    task takes the tracks of a batch one after the other.
    """
    by_name = {v["name"]: scaled(v) for v in variants}
    held = {k: np.asarray(x, float) for k, x in (pools or {}).items()}
    keys = ["seq_name", "track_id"]

    def tracks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, keys):
            frames, rows, at = pdf["frame_idx"].to_numpy(), pdf[BOX].to_numpy(float), starts(pdf, keys).tolist()
            names = pdf["seq_name"].tolist()
            ids = [None if pd.isna(i) else int(i) for i in pdf["track_id"]]
            found: list[tuple] = []  # variant, kind, rows of pdf, boxes, scores
            for a, b in zip(at, [*at[1:], len(pdf)]):
                for variant, v in by_name.items():
                    streams = (np.random.default_rng(group_seed(seed, variant, names[a], "tid", ids[a], part)) for part in ("geom", "score"))
                    found += [(variant, kind, a + own, made, drawn) for kind, own, made, drawn in corrupted(frames[a:b], rows[a:b], v, *streams, held) if len(own)]
            if not found:
                continue
            variant, kind, own, made, drawn = zip(*found)
            out, n = pdf.iloc[np.concatenate(own)][["seq_name", "track_id", "frame_idx"]].reset_index(drop=True), [len(x) for x in own]
            out.insert(0, "variant", np.repeat(np.array(variant, object), n))
            out[BOX] = np.concatenate(made)
            yield out.assign(kind=np.repeat(np.array(kind, object), n), score=np.concatenate(drawn))

    schema = "variant string, seq_name string, track_id bigint, frame_idx int, " + ", ".join(f"{c} double" for c in BOX) + ", kind string, score double"
    rows = boxes.select("seq_name", F.col("track_id").cast("long").alias("track_id"), "frame_idx", *BOX)
    return rows.repartition(*keys).sortWithinPartitions(*keys, "frame_idx").mapInPandas(tracks, schema)
