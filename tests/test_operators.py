import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import curation, ews, learn, scoring, simulate
from tidewatch.operators import windows as W
from tidewatch.sources import series as S


def long(spark, **series):
    return spark.createDataFrame([(n, i, None if v is None else float(v)) for n, vs in series.items() for i, v in enumerate(vs)], "series_id string, t int, v double")


def values(df, column="v"):
    out = {}
    for r in df.orderBy("series_id", "t").collect():
        out.setdefault(r["series_id"], []).append(r[column])
    return out


def test_fill_gaps_only_short_inner_ones(spark):
    df = long(spark, a=[None, 1, None, None, 4, None], b=[0, None, None, None, None, None, None, 7])
    assert values(W.fill_gaps(df, 5)) == {"a": [None, 1, 2, 3, 4, None], "b": [0, None, None, None, None, None, None, 7]}


def test_truncate_decline(spark):
    df = long(spark, a=[1, 5, 10, 9.5, 8, 9.9, 3], b=[1, 5, 10, 9.5])
    assert values(W.truncate_decline(df)) == {"a": [1, 5, 10, 9.5], "b": [1, 5, 10, 9.5]}


def test_flat_and_empty_series(spark):
    flat = long(spark, a=[2] * 12)
    assert values(W.minmax(flat), "x")["a"] == [0.0] * 12
    assert W.rolling(flat, 5).count() == 0
    empty = long(spark).limit(0)
    assert W.fill_gaps(empty).count() == 0 and W.truncate_decline(empty).count() == 0


def test_wide_to_long_drops_what_is_no_number(spark):
    wide = spark.createDataFrame([("a", "1", "x", None)], "ID string, `1990` string, `1991` string, note string")
    assert [tuple(r) for r in S.wide_to_long(wide, ["ID"]).orderBy("t").collect()] == [("a", 1990, 1.0), ("a", 1991, None)]


def test_text_table_round_trip(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("﻿id, Region ,2000\nx,World,3\n", encoding="utf-8")
    df = S.read_text_table(spark, str(path), ["ID", "Region", "Metric"])
    assert set(df.columns) == {"ID", "Region", "2000", "Metric"}
    assert df.first()["Metric"] == ""


def test_gates_say_why(spark):
    none = spark.createDataFrame([], "ws int, we int")
    rise = list(np.linspace(0, 1, 12))
    df = long(spark, short=[1, 2], hole=[0, 1, 2, 3, *[None] * 7, 4, 5, 6, 7, 8, 9], good=rise, falls=[*rise, *[0.3] * 6])
    kept, rejected = curation.gate(df, none)
    assert {r["series_id"]: r["reason"] for r in rejected.collect()} == {"short": curation.REASONS[0], "hole": curation.REASONS[1]}
    assert {r["series_id"]: (r["series_type"], r["n"]) for r in kept.groupBy("series_id", "series_type").agg(F.count("x").alias("n")).collect()} == {"good": ("pre_saturation", 12), "falls": ("declining_structural", 12)}


def test_greedy_copies_keep_the_first(spark):
    df = spark.createDataFrame([("g", 2, [1.0, 2.0, 3.0]), ("g", 1, [2.0, 4.0, 6.0]), ("g", 3, [3.0, 1.0, 2.0]), ("h", 4, [1.0, 2.0, 3.0])], "g string, ord int, x array<double>")
    assert sorted(r["ord"] for r in curation.drop_near_copies(df, ["g"]).collect()) == [1, 3, 4]


def test_simulation_does_not_depend_on_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", 3)
    a = simulate.benchmark(spark, 5, "logistic", 100).orderBy("series_id").collect()
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert a == simulate.benchmark(spark, 5, "logistic", 100).orderBy("series_id").collect()
    assert {r["label"] for r in a} == {0, 1, 2} and len(a) == 15


def test_simulated_curves_turn_when_their_class_does(spark):
    made = simulate.benchmark(spark, 30, "mixed", 200).collect()
    for label in (0, 1, 2):
        own = [np.array(r["x"]) for r in made if r["label"] == label]
        low, high = simulate.TURNS[label]
        assert len(own) == 30 and all(abs(x.min()) < 1e-9 and abs(x.max() - 1) < 1e-9 and low < simulate.turn(x) < high for x in own)


def test_mixtures_find_two_clouds(spark):
    g = np.random.default_rng(0)
    x = np.concatenate([g.normal(0, 1, (150, 2)), g.normal(8, 1, (150, 2))])
    df = spark.createDataFrame([(i, int(i >= 150), v.tolist()) for i, v in enumerate(x)], "k int, label int, x array<double>")
    for student in (False, True):
        state, ll = learn.mixture(df, 2, student=student, restarts=2, rounds=30)
        accuracy, _ = scoring.matched_accuracy(learn.assign(df, state))
        assert accuracy > 0.99 and np.isfinite(ll)
    z, axes, shares = learn.principal_components(df, k=1)
    assert shares[0] > 0.9 and axes.shape == (1, 2)
    assert learn.out_of_distribution(df, df.where("label = 0")).where("label = 1 AND outside").count() == 150


def test_auc_and_roc(spark):
    df = spark.createDataFrame([(float(i % 7), i % 3 == 0) for i in range(60)], "s double, p boolean")
    rows = df.collect()
    pairs = [(a["s"], b["s"]) for a in rows for b in rows if a["p"] and not b["p"]]
    want = sum((x > y) + 0.5 * (x == y) for x, y in pairs) / len(pairs)
    assert scoring.auc(df, "s", F.col("p")).first()["auc"] == pytest.approx(want)
    low = scoring.roc(df, "s", F.col("p")).orderBy("score").first()
    assert (low["tpr"], low["fpr"]) == (1.0, 1.0)


def test_signals_rise_before_a_fold(spark):
    n = 120
    g = np.random.default_rng(1)
    noise = np.zeros(n)
    for i in range(1, n):
        phi = min(0.98, 0.1 + i / 60)
        noise[i] = phi * noise[i - 1] + 0.01 * g.standard_normal()
    x = 1 / (1 + np.exp(-(np.arange(n) - 90) / 4)) + noise
    df = spark.createDataFrame([("a", x.tolist())], "series_id string, v array<double>")
    r = ews.signals(df, surrogates=20).first()
    assert r["tau_var"] > 0 and 0.5 < r["t_takeoff"] < 0.95 and 0 <= r["p_ar1_var"] <= 1
    assert ews.detections(df).first()["n"] == n


def test_silhouette_takes_all_rows(spark):
    rng = np.random.default_rng(3)
    label = rng.integers(0, 3, 3500)
    v = rng.normal(size=(3500, 3)) + label[:, None] * np.linspace(0.2, 3, 3500)[:, None]
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    mean = np.stack([d[:, label == c].sum(1) / ((label == c).sum() - (label == c).astype(int)) for c in range(3)], 1)
    a = mean[np.arange(3500), label]
    mean[np.arange(3500), label] = np.inf
    want = ((mean.min(1) - a) / np.maximum(a, mean.min(1))).mean()
    rows = spark.createDataFrame([(i, int(c), x.tolist()) for i, (c, x) in enumerate(zip(label, v, strict=True))], "k long, l int, v array<double>")
    for block in (8192, 1000):
        assert abs(scoring.silhouette(rows, "v", "l", "k", block=block).first()[0] - want) < 1e-9


def test_greedy_copies_of_a_large_group(spark):
    g = np.random.default_rng(6)
    x = g.normal(size=(60, 6))[g.integers(0, 60, 1200)] + g.normal(0, 0.4, (1200, 6))
    x[::97] = g.integers(0, 3, (len(x[::97]), 1))  # flat ones
    kept, flat = [], x.std(axis=1) < 1e-12
    with np.errstate(invalid="ignore", divide="ignore"):
        same = np.corrcoef(x) >= 0.98
    for i, v in enumerate(x):
        if not any(np.allclose(v, x[j]) if flat[i] or flat[j] else same[i, j] for j in kept):
            kept.append(i)
    df = spark.createDataFrame([(None, i, v.tolist()) for i, v in enumerate(x)] + [("h", 9999, [1.0, 2.0])], "g string, ord int, x array<double>")
    began = time.perf_counter()
    assert sorted(r["ord"] for r in curation.drop_near_copies(df, ["g"], least=0.98).collect()) == [*kept, 9999]
    assert time.perf_counter() - began < 20


def test_silhouettes_of_several_labels_at_once(spark):
    rng = np.random.default_rng(8)
    rows = [(None if i == 5 else i // 2 if i < 20 else i, None if i % 30 == 0 else i % 3, i % 2, None if i % 41 == 0 else rng.normal(i % 3, 1, 2).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, a int, b int, v array<double>")
    both = scoring.silhouettes(df, "v", ["a", "b"], "k", block=256).first()
    d = np.array([r[3] or [np.nan] * 2 for r in rows])
    d = np.sqrt(((d[:, None] - d[None]) ** 2).sum(2))
    for c, at in (("a", 1), ("b", 2)):
        sums = {}
        for i, x in enumerate(rows):
            for j, y in enumerate(rows):
                if x[0] is not None and y[0] is not None:
                    s = sums.setdefault((x[0], x[at]), {}).setdefault(y[at], [])
                    if x[0] != y[0] and not np.isnan(d[i, j]):
                        s.append(d[i, j])
        scores = []
        for (_, own), by in sums.items():
            means = {other: np.mean(s) for other, s in by.items() if s and other is not None}
            a, b = means.get(own), min((m for other, m in means.items() if other != own), default=None)
            scores.append(0.0 if own is None or a is None or b is None else (b - a) / max(a, b))
        assert abs(both[c] - np.mean(scores)) < 1e-9


def test_gate_runs_each_step_once(spark):
    rows = S.user_days(spark, "/root/testdata/sf0.001")
    kept, rejected = curation.gate(rows, spark.createDataFrame([(3, 4)], "ws int, we int"), least=5)
    plan = kept.select("series_id").unionByName(rejected.select("series_id"))._jdf.queryExecution().withCachedData()
    leaves = plan.collectLeaves()
    names = {leaves.apply(i).getClass().getSimpleName() for i in range(leaves.size())}
    spark.catalog.clearCache()
    assert names == {"InMemoryRelation"}
