import hashlib

import numpy as np

from pyspark.sql import functions as F

from tidewatch.functions import columns as C
from tidewatch.operators import curation
from tidewatch.sources import series as S


def test_json_report_with_fallback(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text('{"a": {"b": 1.5}}')
    assert S.read_cached_json(spark, str(path), "a.b").first()["value"] == 1.5
    assert S.read_cached_json(spark, str(path), "a.c.d", 7.0).first()["value"] == 7.0


def test_tiers_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 12, 0.0), ("b", 30, 0.2), ("c", 30, 0.05)], "series_id string, n int, start double")
    member = curation.tiers(df, {"all": (None, F.lit(True)), "long": ("all", F.col("n") >= 20), "clean": ("long", F.col("start") < 0.1)})
    S.write_tiers(member, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert {(r["tier"], r["series_id"]) for r in back.collect()} == {("all", "a"), ("all", "b"), ("all", "c"), ("long", "b"), ("long", "c"), ("clean", "c")}


def test_csv_json_and_checksums(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 0.5)], "series_id string, t int, v double")
    S.write_csv(df, str(tmp_path / "c"))
    S.write_json(df, str(tmp_path / "j"))
    assert S.read_typed_table(spark, str(tmp_path / "c"), "series_id string, t int, v double").collect() == df.collect()
    assert spark.read.schema(df.schema).json(str(tmp_path / "j")).collect() == df.collect()
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x").write_bytes(b"abc")
    assert S.checksums(spark, str(tmp_path / "f")).first()["sha256"] == hashlib.sha256(b"abc").hexdigest()


def test_column_rules(spark):
    df = spark.createDataFrame([(1.0, 2.0, "x"), (2.0, 2.0, " World "), (3.0, 2.0, None)], "x double, y double, r string")
    r = df.agg(C.correlation(F.col("x"), F.col("y"), 1.0).alias("c"), C.r_squared(F.col("y"), F.col("x")).alias("r2"), C.correlation(F.col("x"), F.col("x")).alias("one")).first()
    assert (r["c"], r["r2"], round(r["one"], 9)) == (1.0, 0.0, 1.0)
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (2.0,)], "x double")
    assert [x[0] for x in odd.select(C.finite(F.col("x"), -1.0)).collect()] == [-1.0, -1.0, -1.0, 2.0]
    assert [x[0] for x in df.orderBy("x").select(C.scale_tag(F.col("r"))).collect()] == ["national", "global", "national"]
    assert [x[0] for x in df.orderBy("x").select(C.bucket(F.col("x"), [0, 1, 2])).collect()] == [0, 1, None]
    assert [x[0] for x in df.orderBy("x").select(C.share(F.col("x"), F.col("y") - 2)).collect()] == [None, None, None]


def test_arrays_and_back(spark):
    df = spark.createDataFrame([("a", 3, 1.0), ("a", 1, 2.0), ("a", 2, None)], "series_id string, t int, v double")
    wide = S.to_arrays(df)
    assert (wide.first()["t"], wide.first()["v"]) == ([1, 3], [2.0, 1.0])
    assert [tuple(r) for r in S.to_long(wide.select("series_id", "v")).orderBy("t").collect()] == [("a", 0, 2.0), ("a", 1, 1.0)]


def test_no_transition_counts_the_unknown(spark):
    s = spark.createDataFrame([("a", 0.4, 0.1, 0.1), ("b", 0.9, None, 0.6)], "series_id string, rise double, s_score double, residual double")
    r = {x["series_id"]: (x["c1"], x["c2"], x["c3"], x["headline"], x["strict"]) for x in curation.no_transition(s).collect()}
    assert r == {"a": (True, False, False, True, False), "b": (False, True, True, True, False)}


def test_caches_states_reports_and_arrays(spark, tmp_path):
    made = []

    def build():
        made.append(1)
        return spark.range(3)

    for config, times in ((None, 1), (None, 1), ({"a": 1}, 2), ({"a": 1}, 2), ({"a": 2}, 3)):
        assert S.built(spark, str(tmp_path / ("plain" if config is None else "by_config")), build, config).count() == 3 and len(made) == times
    state = {"weights": np.arange(3.0), "names": ["a", "b"], "k": 2}
    S.write_state(spark, state, str(tmp_path / "state"))
    assert S.read_state(spark, str(tmp_path / "state")) == {"weights": [0.0, 1.0, 2.0], "names": ["a", "b"], "k": 2}
    df = spark.createDataFrame([("x|y", 0.123456, None)], "a string, b double, c int")
    assert S.markdown(df, "T") == "# T\n\n| a | b | c |\n| - | - | - |\n| x\\|y | 0.1235 |  |\n"
    S.write_markdown(df, "T", str(tmp_path / "md"))
    assert spark.read.option("wholetext", True).text(str(tmp_path / "md")).first()["value"].startswith("# T")
    (tmp_path / "np").mkdir()
    np.save(tmp_path / "np" / "a.npy", np.arange(6).reshape(3, 2))
    assert [r["x"] for r in S.read_npy(spark, str(tmp_path / "np")).orderBy("row").collect()] == [[0.0, 1.0], [2.0, 3.0], [4.0, 5.0]]
