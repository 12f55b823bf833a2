import numpy as np
from pyspark.sql import functions as F

from actloom.functions import stats
from actloom.queries.numbers import QUERIES


def test_bootstrap_runs_over_all_customers(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    assert QUERIES["m06_bootstrap_ci"](spark, sf_dir).count() == orders.select("o_custkey").distinct().count()


def test_effect_with_ci_runs_over_all_lines(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    side = lambda g, f: f(F.when(F.col("l_returnflag") == g, F.col("l_quantity")))
    stat = lines.groupBy("l_linenumber").agg(*(side(g, f).alias(n + g) for g in "AR" for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))), F.avg("l_quantity").alias("mean"))
    want = {r.l_linenumber: (r.mean, (r.mA - r.mR) / (((r.nA - 1) * r.vA + (r.nR - 1) * r.vR) / (r.nA + r.nR - 2)) ** 0.5) for r in stat.collect()}
    got = {r.l_linenumber: r for r in QUERIES["k17_effect_with_ci"](spark, sf_dir).collect()}
    assert set(got) == set(want)
    for k, (mean, effect) in want.items():
        assert abs(got[k].effect_size - effect) < 1e-5 and got[k].status == "ok" and got[k].lower < mean < got[k].upper


def test_bootstrap_resamples_many_groups_at_once(spark):
    """Groups reach Python in batches, not one by one, with the very intervals of a loop over each group's draws."""
    rows = [(g if g else None, i, None if i % 7 == 6 else (g * 31 + i * i * 17) % 101 / 3) for g in range(60) for i in range(g % 23)]
    df = spark.createDataFrame(rows, "g long, i long, x double").repartition(5)
    for stat, f in (("mean", np.mean), ("median", np.median)):
        out = stats.bootstrap_ci(df, ["g"], "x", "i", n_boot=50, seed=7, stat=stat)
        assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()
        got = {r.g: r for r in out.collect()}
        assert set(got) == {g for g, _, _ in rows}
        for g, r in got.items():
            x = np.array([v for k, _, v in rows if k == g and v is not None])
            if len(x) < 2:
                assert r[1:] == ("missing", None, None)
                continue
            rng = np.random.default_rng(7)
            ends = np.percentile([float(f(x[rng.integers(0, len(x), size=len(x))])) for _ in range(50)], [2.5, 97.5])
            assert r[1:] == ("ok", *(round(float(e), 6) for e in ends))
