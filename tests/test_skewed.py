import numpy as np
from pyspark.sql import functions as F

from tidewatch.operators import scoring, skewed
from tidewatch.streaming import online


def test_skew_mixture_separates_and_finds_the_skew(spark):
    g = np.random.default_rng(0)
    a = np.stack([np.abs(g.normal(0, 3, 200)), g.normal(0, 1, 200)], axis=1)
    b = g.normal([-12, 5], 1, (200, 2))
    df = spark.createDataFrame([(int(i >= 200), v.tolist()) for i, v in enumerate(np.concatenate([a, b]))], "label int, x array<double>")
    state, ll = skewed.skew_mixture(df, 2, rounds=15)
    accuracy, names = scoring.matched_accuracy(skewed.assign_skewed(df, state))
    assert accuracy > 0.98 and np.isfinite(ll)
    j = next(c for c, label in names.items() if label == 0)
    assert abs(state["delta"][j][0]) > abs(state["delta"][j][1])


def test_two_normals_and_density(spark):
    g = np.random.default_rng(1)
    assert skewed.two_normals(np.concatenate([g.normal(0, 1, 60), g.normal(9, 1, 60)]))[0] > 0
    assert skewed.two_normals(g.normal(0, 1, 120))[0] < 10
    df = spark.createDataFrame([("a", float(v)) for v in g.normal(0, 1, 50)], "k string, v double")
    d = skewed.density(df, "v", ["k"], [-5.0, 0.0, 5.0]).collect()
    assert max(r["density"] for r in d) == 1.0 and len(d) == 3


def test_convolved_length(spark):
    df = spark.createDataFrame([([float(i) for i in range(60)],)], "x array<double>")
    assert len(df.select(skewed.convolved(F.col("x"), 60, 5).alias("f")).first()["f"]) == 10


def test_online_rolling_equals_batch(spark, tmp_path):
    g = np.random.default_rng(2)
    v = g.normal(size=30)
    df = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(v)], "series_id string, t long, v double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("series_id string, t long, v double").parquet(str(tmp_path / "in"))
    q = online.rolling(stream, 10).writeStream.format("memory").queryName("online_rolling").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["t"]: r["var"] for r in spark.table("online_rolling").collect()}
    assert set(got) == set(range(9, 30)) and all(abs(got[t] - v[t - 9 : t + 1].var()) < 1e-9 for t in got)


def test_bimodality_scan_can_find_two_modes(spark):
    from tidewatch import plans, registry

    plans.load()
    found = registry.QUERIES["bimodality_scan"](spark, "/root/testdata/sf0.001").collect()
    assert sorted((r["share"], r["n"]) for r in found) == [(0.4, 200), (0.6, 300), (0.8, 400), (1.0, 500)]
    assert all(abs(r["p"] * 201 - round(r["p"] * 201)) < 1e-9 for r in found)
    g = np.random.default_rng(3)
    rows = [(float(v), float(i % 7)) for i, v in enumerate(np.concatenate([g.normal(0, 1, 90), g.normal(8, 1, 90)]))]
    assert all(r["bimodal"] for r in skewed.bimodality_scan(spark.createDataFrame(rows, "v double, o double"), "v", "o").collect())
