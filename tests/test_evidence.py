"""Estimation windows, errors by cluster, bootstrap draws, one-pass walk-forward regression and stored sketches, against plain loops."""

import math
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import bars, clustered, gram, portfolio, sketches


def months(n):
    return [date(2000 + k // 12, 1 + k % 12, 1) for k in range(n)]


def test_estimation_window_ends_before_the_event_window(spark):
    r = np.random.default_rng(1)
    rows = [(i, m, None if r.random() < 0.1 else float(r.normal()), float(r.normal())) for i in ("a", "b") for m in months(30)]
    df = spark.createDataFrame(rows, "inst string, month date, ret double, iret double")
    got = {(x.inst, x.month): x for x in bars.rolling_market_model(df, "inst", "month", "ret", "iret", 8, 2, least=4).collect()}
    assert len(got) == 60
    for i in ("a", "b"):
        own = [x for x in rows if x[0] == i]
        for k, (_, m, *_) in enumerate(own):
            use = [(x[2], x[3]) for x in own[max(0, k - 10) : max(0, k - 2)] if x[2] is not None]
            assert got[i, m].fit_n == len(use)
            if len(use) < 4:
                assert got[i, m].beta is None and got[i, m].alpha is None
            else:
                beta, alpha = np.polyfit([x for _, x in use], [y for y, _ in use], 1)
                assert got[i, m].beta == pytest.approx(beta) and got[i, m].alpha == pytest.approx(alpha)


def test_clustered_errors_equal_plain_sums(spark):
    r = np.random.default_rng(2)
    rows = [(g, int(c), None if r.random() < 0.1 else float(r.normal() + c)) for g in ("x", "y") for c in r.integers(0, 6, 80)] + [("alone", 1, 2.0), ("alone", 1, 4.0), ("none", 1, None)]
    sums = clustered.cluster_sums(spark.createDataFrame(rows, "g string, c int, v double"), ["g"], "c", "v")
    got = {x.g: x for x in clustered.clustered_mean(sums, ["g"]).collect()}
    assert set(got) == {"x", "y", "alone"}
    for g in ("x", "y"):
        v = [(c, x) for k, c, x in rows if k == g and x is not None]
        mean = sum(x for _, x in v) / len(v)
        parts = [sum(x - mean for c, x in v if c == k) for k in {c for c, _ in v}]
        error = math.sqrt(sum(p * p for p in parts) * len(parts) / (len(parts) - 1)) / len(v)
        assert got[g].mean == pytest.approx(mean) and got[g].std_error == pytest.approx(error) and got[g].t_stat == pytest.approx(mean / error) and (got[g].n, got[g].n_clusters) == (len(v), len(parts))
    assert got["alone"].mean == 3.0 and got["alone"].std_error is None and got["alone"].t_stat is None


def test_bootstrap_draws_whole_clusters_and_repeats(spark):
    r = np.random.default_rng(3)
    rows = [("x", k, float(r.normal()), 1 + k % 3) for k in range(60)]
    sums = spark.createDataFrame(rows, "g string, c int, s double, n long")
    a, b = (sorted(map(tuple, clustered.bootstrap(s, ["g"], "c", 300).collect())) for s in (sums, sums.repartition(7)))
    assert [x[:2] for x in a] == [x[:2] for x in b] and np.allclose([x[2] for x in a], [x[2] for x in b]) and len(a) == 300
    w = [x.w for x in spark.range(4000).select(clustered.weight(F.col("id"), F.lit(5), 1).alias("w")).collect()]
    assert np.mean(w) == pytest.approx(1, abs=0.06) and np.var(w) == pytest.approx(1, abs=0.12) and min(w) == 0
    clusters = clustered.clustered_mean(sums, ["g"]).first()
    assert np.std([x[2] for x in a]) == pytest.approx(clusters.std_error, rel=0.25)
    assert clustered.bootstrap(sums.limit(0), ["g"], "c", 5).collect() == []


def panel(spark, n_months=30, n_inst=12):
    r = np.random.default_rng(4)
    rows = []
    for m in months(n_months):
        for i in range(n_inst):
            x = [float(v) for v in r.normal(size=3)]
            rows.append((i, m, None if r.random() < 0.05 else 0.5 * x[0] - x[2] + 0.1 * float(r.normal()), x[0], x[1], x[2], 7.0))
    return rows, spark.createDataFrame(rows, "inst int, month date, fwd double, a double, b double, c double, flat double")


@pytest.mark.parametrize("horizon", [0, 2])
def test_one_pass_walk_forward_equals_a_fit_a_fold(spark, horizon):
    rows, df = panel(spark)
    names, ridge = ["a", "b", "c", "flat"], 0.05
    folds = portfolio.folds(df, "month", 12, 6)
    got = {x.fold: x for x in gram.fold_weights(df, folds, "month", names, "fwd", ridge, horizon).collect()}
    every = months(30)
    assert sorted(got) == [f.fold for f in folds.orderBy("fold").collect()]
    for f in folds.collect():
        until = every[every.index(f.test_from) - horizon]
        use = [x for x in rows if f.train_from <= x[1] < until and x[2] is not None]
        x, y = np.array([u[3:] for u in use]), np.array([u[2] for u in use])
        z = (x[:, :3] - x[:, :3].mean(axis=0)) / x[:, :3].std(axis=0)
        w = np.linalg.solve(z.T @ z / len(z) + ridge * np.eye(3), z.T @ (y - y.mean()) / len(z)) / x[:, :3].std(axis=0)
        assert got[f.fold].n == len(use) and got[f.fold].w == pytest.approx([y.mean() - x[:, :3].mean(axis=0) @ w, *w, 0.0], abs=1e-9)
    scored = gram.walk_forward(df, folds, "month", names, "fwd", ridge, horizon).collect()
    assert len(scored) == sum(12 for m in every[12:]) and all(s.fold == (every.index(s.month) - 12) // 6 for s in scored)
    assert np.corrcoef([s.score for s in scored if s.fwd is not None], [s.fwd for s in scored if s.fwd is not None])[0, 1] > 0.9
    assert gram.walk_forward(df.limit(0), folds, "month", names, "fwd").collect() == []


def test_sketches_merge_and_intersect(spark):
    n = spark.range(40_000).select("id", F.when(F.col("id") < 30_000, "a").otherwise("b").alias("g"), (F.col("id") % 5).alias("month"))
    n = n.unionByName(spark.range(25_000, 30_000).select("id", F.lit("b").alias("g"), F.lit(9).cast("long").alias("month"))).unionByName(n.limit(500))
    stored = sketches.by_period(n, ["g", "month"], "id")
    about = {r.part: r.about for r in sketches.compared(stored, "g", "a", "b").collect()}
    for part, true in {"a": 30_000, "b": 15_000, "both": 5_000, "either": 40_000}.items():
        assert abs(about[part] - true) < 40_000 * 3 / 128
    assert about["b"] == 15_000
    assert {r.g: r.about for r in sketches.merged(stored, ["g"]).collect()}["b"] == 15_000
    assert {r.part: r.about for r in sketches.compared(stored, "g", "b", "none").collect()} == {"b": 15_000, "none": 0, "both": 0, "either": 15_000}


def test_backtests_of_the_learned_books_add_up(spark, monkeypatch):
    """Reports of M1 to M3 against their own monthly returns, before and after costs; scores are fixed, as tree fits may differ from run to run."""
    from tidemark.plans import books
    from tidemark.plans.registry import QUERIES

    fixed = lambda x: x.where("fwd is not null").select("inst", "month", "fwd", (F.col("sent") + F.col("ret_1") / 10 + F.col("inst") / 1000).alias("score"))
    monkeypatch.setattr(books, "walk_forward", fixed)

    sf = "/root/testdata/sf0.001"
    report = {(r.strategy, r.costs): r for r in QUERIES["backtest_models"](spark, sf).collect()}
    assert set(report) == {(m, c) for m in ("m1", "m2", "m3") for c in ("gross", "net")}
    for name, query in (("m1", "m1_gbt"), ("m2", "m2_softmax"), ("m3", "m3_cash")):
        monthly = sorted((r.month, r.port_ret) for r in QUERIES[query](spark, sf).collect())
        x = np.array([v for _, v in monthly])
        got, net = report[name, "gross"], report[name, "net"]
        wealth = np.cumprod(1 + x)
        peak = np.maximum(1, np.maximum.accumulate(wealth))
        assert got.n_periods == len(x) and got.mean_ret == pytest.approx(x.mean(), abs=1e-9) and got.vol == pytest.approx(x.std(ddof=1), abs=1e-9)
        assert got.final_wealth == pytest.approx(wealth[-1], rel=1e-6) and got.max_drawdown == pytest.approx((wealth / peak - 1).min(), abs=1e-9)
        assert net.final_wealth < got.final_wealth and net.mean_ret < got.mean_ret


def test_sketches_are_exact_beyond_one_sketch(spark):
    """40,000 items overflow a sketch of 2**14, but not its shards."""
    n = spark.range(40_000).select("id", F.when(F.col("id") < 30_000, "a").otherwise("b").alias("g")).unionByName(spark.range(25_000, 30_000).select("id", F.lit("b").alias("g")))
    stored = sketches.by_period(n, ["g"], "id")
    assert {r.part: r.about for r in sketches.compared(stored, "g", "a", "b").collect()} == {"a": 30_000, "b": 15_000, "both": 5_000, "either": 40_000}
    assert {r.g: r.about for r in sketches.merged(stored, ["g"]).collect()} == {"a": 30_000, "b": 15_000}
    empty = sketches.compared(stored.limit(0), "g", "a", "b").collect()
    assert {r.part: r.about for r in empty} == {"a": 0, "b": 0, "both": 0, "either": 0}
