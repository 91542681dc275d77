import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import summaries
from trackloom.operators.quantiles import at_ranks, quantiles, with_quantiles

WANTED = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.9, "e": 1.0}


def values(seed, n):
    rng = random.Random(seed)
    return [rng.choice([rng.gauss(0, 1), rng.randrange(5), 1e6 * rng.random(), None]) for _ in range(n)]


def test_same_as_numpy(spark):
    groups = {"one": [3.0], "ties": [1.0] * 50 + [2.0], "wide": [-1.7e308, 0.0, 1.7e308], None: values(1, 400), "hot": values(2, 5000), "none": [None, None]}
    rows = [(g, None if v is None else float(v), "x") for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double, a string").repartition(7)
    got = {r.g: [r[k] for k in WANTED] for r in quantiles(df, "v", ["g"], WANTED).collect()}
    assert set(got) == set(groups) - {"none"}
    for g, found in got.items():
        assert np.allclose(found, np.quantile([v for v in groups[g] if v is not None], list(WANTED.values())) if g != "wide" else [-1.7e308, found[1], 0.0, found[3], 1.7e308])


def test_without_group_and_empty(spark):
    df = spark.createDataFrame([(float(i % 7),) for i in range(100)], "v double")
    assert [*quantiles(df, "v", [], {"m": 0.5}).first()] == [np.quantile([i % 7 for i in range(100)], 0.5)]
    assert [*quantiles(df.limit(0), "v", [], {"m": 0.5}).first()] == [None]
    both = with_quantiles(spark.createDataFrame([("a",), (None,)], "g string"), spark.createDataFrame([(None, 2.0), (None, 4.0)], "g string, v double"), "v", ["g"], {"m": 0.5})
    assert sorted(map(tuple, both.collect()), key=repr) == [("a", None), (None, 3.0)]


def test_infinite_values_and_ranks(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(v,) for v in (inf, 1.0, -inf, nan, 2.0, inf)], "v double")
    got = at_ranks(df, "v", [], {f"r{i}": F.lit(i) for i in range(6)}).first()
    assert [got[f"r{i}"] for i in range(5)] == [-inf, 1.0, 2.0, inf, inf] and np.isnan(got["r5"])


def test_plan_gathers_no_group(spark):
    df = spark.createDataFrame([("s", False, 1.0)], "seq_name string, is_warmup boolean, step_ms double")
    for plan in (summaries.run_stats(df), summaries.numeric_summary(df, "step_ms", "seq_name")):
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile" not in text and "collect_list(step_ms" not in text


@pytest.mark.parametrize("bins", [1, 4, 10])
def test_quantile_calibrator(spark, bins):
    rng = random.Random(3)
    rows = [("tp" if rng.random() < 0.6 else "fp", round(rng.random(), 2)) for _ in range(500)]
    got = {r.bin: (r.tp, r.fp) for r in summaries.quantile_calibrator(spark.createDataFrame(rows, "kind string, score double"), bins).collect()}
    edges = np.quantile([s for _, s in rows], [i / bins for i in range(1, bins)])
    want = {}
    for kind, s in rows:
        b = int((s >= edges).sum())
        tp, fp = want.get(b, (0, 0))
        want[b] = (tp + (kind == "tp"), fp + (kind == "fp"))
    assert got == want
