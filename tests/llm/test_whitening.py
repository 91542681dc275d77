import numpy as np
import pytest

from trackloom.llm import whitening
from trackloom.llm.whitening import bidiagonal, dqds, op12_embedding_whitening, principal, twisted, whitened


def bidiagonal_matrix(a, b):
    return np.diag(a) + np.diag(b, 1)


@pytest.mark.parametrize("n", [1, 2, 3, 8, 40, 64])
def test_bidiagonal(n):
    r = np.triu(np.random.default_rng(n).normal(size=(n, n)))
    a, b, v = bidiagonal(r)
    assert np.allclose(v.T @ v, np.eye(n), atol=1e-13)
    m = bidiagonal_matrix(a, b)
    assert np.allclose(v @ (m.T @ m) @ v.T, r.T @ r, atol=1e-11)


@pytest.mark.parametrize("seed", range(12))
def test_dqds_is_accurate_for_small_values(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 50))
    a, b = rng.uniform(0.1, 2, n) * 10.0 ** rng.integers(-6, 3, n), rng.uniform(0, 1, max(0, n - 1)) * 10.0 ** rng.integers(-8, 1, max(0, n - 1))
    got = dqds(a, b)
    assert len(got) == n and (np.diff(got) <= 0).all()
    want = np.linalg.svd(bidiagonal_matrix(a, b), compute_uv=False)
    assert np.allclose(np.sqrt(got), want, rtol=1e-9, atol=1e-13 * want[0])
    # their product is known exactly
    assert np.log(got).sum() == pytest.approx(2 * np.log(a).sum(), abs=1e-9)


def test_principal_of_wide_rows():
    r = np.linalg.qr(np.random.default_rng(3).normal(size=(2000, 150)), mode="r")
    values, vectors, _ = principal(r, 2000, 8)
    assert np.allclose(values, np.linalg.svd(r, compute_uv=False)[:8] ** 2 / 2000, rtol=1e-12)
    assert np.allclose(vectors.T @ vectors, np.eye(8), atol=1e-12)


def test_dqds_of_zeros_and_ties():
    assert dqds(np.zeros(5), np.zeros(4)).tolist() == [0.0] * 5
    assert np.allclose(dqds(np.ones(6), np.zeros(5)), 1)
    assert np.allclose(dqds(np.array([1.0, 0.0, 2.0]), np.array([1.0, 1.0])), np.linalg.svd(bidiagonal_matrix([1.0, 0, 2], [1.0, 1]), compute_uv=False) ** 2)


@pytest.mark.parametrize("seed", range(8))
def test_twisted_vectors(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.uniform(0.5, 3, 20), rng.uniform(0.1, 2, 19)
    m = bidiagonal_matrix(a, b)
    for value in dqds(a, b):
        z = twisted(a, b, value)
        assert np.abs(m.T @ (m @ z) - value * z).max() < 1e-13 * 100


def test_close_values():
    """Two halves that hardly touch: pairs of values that are nearly the same."""
    half = np.linspace(1, 2, 6)
    a, b = np.concatenate([half, half[::-1]]), np.full(11, 0.3)
    b[5] = 1e-7
    for r in (bidiagonal_matrix(a, b), np.eye(7), np.diag([3.0, 3, 3, 1, 1, 0, 0])):
        values, vectors, total = principal(r, 1, 8)
        assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)
        assert np.allclose(r.T @ (r @ vectors), vectors * values, atol=1e-12)
        assert total == pytest.approx((r**2).sum())


def brute(rows, components=8):
    kept = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)]
    ids, x = [i for i, _ in kept], np.stack([np.floor(1024 * v).astype(np.int64) + 100_000 for _, v in kept])
    n, s = len(x), [int(t) for t in x.astype(object).sum(0)]
    deviation = [sum((n * int(a) - b) ** 2 for a, b in zip(row, s)) for row in x]
    c = np.array([[(n * int(a) - b) / n for a, b in zip(row, s)] for row in x])
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    k = min(components, int((e > 1e-12 * e[0]).sum()))
    return ids, n, deviation, c @ v[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def check(got, rows):
    ids, n, deviation, white, explained = brute(rows)
    k = len(explained)
    assert len(got) == len(ids) * k
    # rows that repeat an id are told apart by what they hold
    want = sorted((str(i), j + 1, d, abs(w[j])) for i, d, w in zip(ids, deviation, white) for j in range(k))
    have = sorted((str(r.vec_id), r.component, r.deviation, abs(r.whitened)) for r in got)
    assert [w[:3] for w in want] == [h[:3] for h in have]
    assert np.allclose([w[3] for w in want], [h[3] for h in have], rtol=1e-7, atol=1e-7)
    by = {(r.vec_id, r.component): r.whitened for r in got}
    for j in range(k):
        signs = {np.sign(by[i, j + 1] * w[j]) for i, w in zip(ids, white) if abs(w[j]) > 1e-6 and ids.count(i) == 1}
        assert len(signs) <= 1
    assert {r.n for r in got} == {n} and {r.identity_error for r in got} and max(r.identity_error for r in got) < 1e-9
    assert all(abs(r.explained - explained[r.component - 1]) <= 1e-9 * explained[r.component - 1] for r in got)


SCHEMA = "vec_id long, embedding array<float>, component string, n int"


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(parts)


def test_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=12) * np.linspace(1, 5, 12) + 3).tolist()) for i in range(90)]
    rows += [(None, rows[0][1]), (3, rows[5][1]), (3, rows[5][1])]
    bad = [(200, None), (201, []), (202, [1.0] * 11 + [None]), (203, [float("nan")] * 12), (204, [float("inf")] + [0.0] * 11), (205, [1.0] * 5)]
    check(whitened(frame(spark, rows + bad)).collect(), rows)
    monkeypatch.setattr(whitening, "FAN", 2)
    monkeypatch.setattr(whitening, "BLOCK", 4)
    check(whitened(frame(spark, rows + bad, 9)).collect(), rows)


def test_few_dimensions_and_ties(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(a), float(a), 7.0]) for i, a in enumerate(rng.normal(size=30))]
    check(whitened(frame(spark, rows)).collect(), rows)
    same = [(i, [1.0, 2.0]) for i in range(5)]
    assert whitened(frame(spark, same)).collect() == [] and whitened(frame(spark, same[:1])).collect() == []
    assert whitened(frame(spark, [(1, None)])).collect() == [] and whitened(frame(spark, same).limit(0)).collect() == []


def test_large_entries(spark):
    rows = [(i, [1e9 * i, 1.0, -(1e8) * (i % 3)]) for i in range(6)]
    got = {r.vec_id: r.deviation for r in whitened(frame(spark, rows)).collect()}
    ids, _, deviation, _, _ = brute(rows)
    assert got == {i: d if d < 2**63 else None for i, d in zip(ids, deviation)} and None in got.values()


def test_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(op12_embedding_whitening(spark, sf).collect(), rows)
