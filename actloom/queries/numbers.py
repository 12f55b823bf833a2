"""Statistics, significance and equations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..plans.quantiles import quantiles
from ..views import view

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def _two(s, d):
    return stats.two_samples(view(s, d, "lineitem"), ["l_linenumber"], "l_returnflag", "A", "R", "l_extendedprice")


_TWO = """(SELECT l_linenumber, count(*) FILTER (WHERE l_returnflag = 'A') AS na, count(*) FILTER (WHERE l_returnflag = 'R') AS nb, avg(l_extendedprice) FILTER (WHERE l_returnflag = 'A') AS ma, avg(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS mb,
  var_samp(l_extendedprice) FILTER (WHERE l_returnflag = 'A') AS va, var_samp(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS vb FROM lineitem GROUP BY l_linenumber)"""


@query("m04_effect_size", f"SELECT l_linenumber, na AS n_a, nb AS n_b, round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 6) AS effect_size, 'ok' AS status FROM {_TWO}")
def _effect(s, d):
    return stats.effect_size(_two(s, d)).select("l_linenumber", "n_a", "n_b", "effect_size", "status")


@query("m05_welch_t", f"SELECT l_linenumber, round((ma - mb) / sqrt(va / na + vb / nb), 6) AS t_stat, 'ok' AS status FROM {_TWO}")
def _welch(s, d):
    return stats.t_statistic(_two(s, d)).select("l_linenumber", "t_stat", "status")


@query("m05_pooled_t", f"SELECT l_linenumber, round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1.0 / na + 1.0 / nb)), 6) AS t_stat, na + nb - 2 AS df FROM {_TWO}")
def _pooled(s, d):
    return stats.t_statistic(_two(s, d), equal_var=True).select("l_linenumber", "t_stat", "df")


@query("m05_paired_t", "SELECT l_returnflag, round(avg(x) / sqrt(var_samp(x) / count(x)), 6) AS t_stat, count(x) - 1 AS df FROM (SELECT l_returnflag, l_quantity / 50 - l_discount * 5 AS x FROM lineitem) GROUP BY l_returnflag")
def _paired(s, d):
    rows = view(s, d, "lineitem").select("l_returnflag", (F.col("l_quantity") / 50).alias("a"), (F.col("l_discount") * 5).alias("b"))
    return stats.paired_t(rows, ["l_returnflag"], "a", "b").select("l_returnflag", "t_stat", "df")


_P = f"""(SELECT l_linenumber, t, CASE WHEN x >= 5 THEN 0 ELSE greatest(1 - 2 / sqrt(pi()) * exp(-x * x) * list_sum(list_transform(range(120), lambda n: exp((2 * n + 1) * ln(x) + 2 * n * ln(2) + lgamma(n + 1) - lgamma(2 * n + 2)))), 0) END AS p
  FROM (SELECT l_linenumber, (ma - mb) / sqrt(va / na + vb / nb) AS t, greatest(abs(ma - mb) / sqrt(va / na + vb / nb) / sqrt(2), 1e-300) AS x FROM {_TWO}))"""


@query("m05_p_value", f"SELECT l_linenumber, round(t, 6) AS t_stat, round(p, 6) AS p_value FROM {_P}")
def _p(s, d):
    return stats.t_statistic(_two(s, d)).select("l_linenumber", "t_stat", "p_value")


@query("m06_bootstrap_ci")
def _bootstrap(s, d):
    rows = view(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return stats.bootstrap_ci(rows, ["o_custkey"], "o_totalprice", "o_orderkey", n_boot=200, seed=7)


@query("m06_bootstrap_ci_distributed")
def _bootstrap_all(s, d):
    return stats.bootstrap_ci_distributed(view(s, d, "orders"), ["o_orderpriority"], "o_totalprice", "o_orderkey", n_boot=100)


_SAID = "CASE event_type WHEN 'purchase' THEN 'This is significant' WHEN 'error' THEN 'not a significant gap' WHEN 'view' THEN '' ELSE 'no claim' END"


@query("m07_significance_claim", f"""
SELECT event_id, kind, CASE kind WHEN 'significant' THEN p < 0.05 WHEN 'not_significant' THEN p >= 0.05 END AS supported
FROM (SELECT event_id, (event_id % 100) / 1000.0 AS p, CASE event_type WHEN 'purchase' THEN 'significant' WHEN 'error' THEN 'not_significant' END AS kind FROM events)""")
def _claim(s, d):
    rows = view(s, d, "events").withColumn("kind", stats.significance_claim(F.expr(_SAID)))
    return rows.select("event_id", "kind", stats.claim_supported(F.col("kind"), (F.col("event_id") % 100) / 1000.0).alias("supported"))


@query("m09_float_list", "SELECT event_id, list_transform(list_filter(list_transform(string_split(props, ':'), lambda x: TRY_CAST(trim(x, '} ') AS DOUBLE)), lambda x: x IS NOT NULL), lambda x: x)[1] AS first FROM events")
def _floats(s, d):
    parts = F.transform(F.split("props", ":"), lambda x: F.btrim(x, F.lit("} ")))
    return view(s, d, "events").select("event_id", F.get(stats.float_list(parts), F.lit(0)).alias("first"))


@query("m10_quantiles", "SELECT user_id % 10 AS k, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.75) AS p75, count(value) AS n FROM events GROUP BY 1")
def _quantiles(s, d):
    rows = view(s, d, "events").select((F.col("user_id") % 10).alias("k"), "value")
    counts = rows.groupBy("k").agg(F.count("value").alias("n"))
    return counts.join(quantiles(rows, ["k"], "value", {"p25": 0.25, "p75": 0.75}), "k", "left").select("k", "p25", "p75", "n")


@query("m12_half_even", "SELECT l_orderkey, l_linenumber, round_even(cast(l_quantity AS BIGINT) / 2.0, 0) AS half FROM lineitem")
def _round(s, d):
    return view(s, d, "lineitem").select("l_orderkey", "l_linenumber", stats.rounded(F.col("l_quantity").cast("long") / F.lit(2.0), 0).alias("half"))


def _equations(s, d):
    k = F.col("p_size").cast("string")
    return view(s, d, "part").select("p_partkey", F.concat(F.lit(r"a \cdot x^{2} + "), k).alias("a"), F.concat(k, F.lit(r" + x^{2} * a"), F.when(F.col("p_partkey") % 3 == 0, F.lit(" + $")).otherwise("")).alias("b"))


@query("m01_parse_equation")
def _parse(s, d):
    return _equations(s, d).select("p_partkey", stats.equation(F.col("a")).alias("e")).select("p_partkey", "e.*")


@query("m02_compare_equations", "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN true END AS same FROM part")
def _compare(s, d):
    return _equations(s, d).select("p_partkey", stats.same_structure(F.col("a"), F.col("b")).alias("same"))


@query("k09_derivation_step", "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN 'ok' ELSE 'missing' END AS status, CASE WHEN p_partkey % 3 <> 0 THEN true END AS supported FROM part")
def _derivation(s, d):
    rows = _equations(s, d).select("p_partkey", stats.same_structure(F.col("a"), F.col("b")).alias("supported"))
    return rows.withColumn("status", F.when(F.col("supported").isNotNull(), "ok").otherwise("missing"))


@query("m03_dimensions", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN 'fail' ELSE 'ok' END AS status, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS consistent FROM part")
def _dimensions(s, d):
    k = F.col("p_partkey") % 4
    rhs = F.when(k == 0, "v*t").when(k == 1, "v/t").when(k == 2, "2*x + v*t").otherwise("x + t")
    units = {"x": {"L": 1.0}, "v": {"L": 1.0, "T": -1.0}, "t": {"T": 1.0}}
    return view(s, d, "part").select("p_partkey", stats.dimensions_agree(F.lit("x"), rhs, units).alias("r")).select("p_partkey", "r.*")


@query("k16_significance_check", f"SELECT l_linenumber, round(t, 6) AS t_stat, round(p, 6) AS p_value, round(p, 6) >= 0.05 AS supported FROM {_P}")
def _k16(s, d):
    t = stats.t_statistic(_two(s, d))
    return t.select("l_linenumber", "t_stat", "p_value", stats.claim_supported(stats.significance_claim(F.lit("not significant")), F.col("p_value")).alias("supported"))


@query("k17_effect_with_ci")
def _k17(s, d):
    rows = view(s, d, "lineitem")
    e = stats.effect_size(stats.two_samples(rows, ["l_linenumber"], "l_returnflag", "A", "R", "l_quantity")).select("l_linenumber", "effect_size")
    held = rows.groupBy("l_linenumber").agg(F.when(F.count("l_quantity") >= 2, "ok").otherwise("missing").alias("status"))
    ci = stats.bootstrap_ci_distributed(rows.filter("l_quantity is not null"), ["l_linenumber"], "l_quantity", "l_orderkey", n_boot=100)
    ends = [F.when(F.col("status") == "ok", stats.rounded(F.col(c))).alias(c) for c in ("lower", "upper")]
    return e.join(held, "l_linenumber").join(ci, "l_linenumber", "left").select("l_linenumber", "effect_size", "status", *ends)
