"""Steps whose work for a row does not multiply, and whose tasks do not grow with the table."""

import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from actloom.functions import core, salvage
from actloom.operators import cluster, kmeans
from actloom.plans import grounding, retrieval
from actloom.queries import acts, corpus, lookups
from actloom.streaming import ledger


def plans(df):
    told = df._jdf.queryExecution()
    return told.optimizedPlan().toString(), told.executedPlan().toString()


def test_a_specification_is_parsed_once_and_dealt_by_size(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(acts, "parts", lambda *_: 37)
    logical, physical = plans(acts.QUERIES["p10_spec_normalise"](spark, sf_dir))
    assert logical.count("from_json(") == 1
    assert re.findall(r"hashpartitioning\(p_partkey#\d+L?, (\d+)\)", physical) == ["37"]


@pytest.mark.parametrize("form", [salvage.reply_json, salvage.object_json, salvage.any_json, lambda c: salvage.label_payload(salvage.variant(c))])
def test_a_reply_is_read_once(spark, form):
    df = spark.createDataFrame([("x",)], "reply string").select(form(F.col("reply")).alias("found"))
    assert len(re.findall(r"(?<!\w)reply#\d+", plans(df)[0])) == 2  # the table's column and one use of it


def test_white_space_at_both_ends_is_trimmed(spark):
    texts = ["", " ", "\n\t a b\x0b\f\r\n", "a  b", "  a  ", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(salvage.trimmed(F.col("t")).alias("t"))
    assert [r.t for r in df.collect()] == ["", "", "a b", "a  b", " a ", None]


def test_existence_moves_no_payloads_and_holds_no_snapshots(spark, sf_dir):
    logical, physical = plans(lookups.QUERIES["k15_existence_batch"](spark, sf_dir))
    assert "Broadcast" not in physical and physical.count("Join") == 1
    assert "AS payload" not in logical


def test_whole_table_kmeans_sends_no_distances_between_centers(spark, monkeypatch):
    from pyspark.ml.clustering import KMeans

    solvers, fit = [], KMeans.fit
    monkeypatch.setattr(KMeans, "fit", lambda self, df: solvers.append(self.getSolver()) or fit(self, df))
    df = spark.createDataFrame([([float(i % 3), 1.0],) for i in range(30)], "v array<float>")
    assert cluster.kmeans(df, "v", 3).select("cluster_id").distinct().count() == 3 and solvers == ["block"]


def test_a_row_is_labelled_before_it_is_exploded(spark, monkeypatch):
    told, write = [], cluster.written
    monkeypatch.setattr(cluster, "written", lambda df, name: told.append((name, plans(df)[0])) or write(df, name))
    df = spark.createDataFrame([(i, "ab"[i % 2], [float(i), 1.0]) for i in range(12)], "id long, s string, v array<double>")
    cluster.kmeans_scoped(df, "s", "v", "id", 2, max_iter=2).collect()
    means = [plan for name, plan in told if name == "means"]
    assert means and all("zip_with" not in plan.split("Generate")[0] and "zip_with" in plan.split("Generate")[1] for plan in means)


def starts_one_by_one(points, k, seed):
    d, found = None, []
    for i in range(k):
        u = [(int(hashlib.md5(f"{row}:{seed}:{i}".encode()).hexdigest()[:13], 16) + 1) / 2**52 for row in range(len(points))]
        key = [u[r] if d is None else -math.log(u[r]) / d[r] if d[r] > 0 else math.inf for r in range(len(points))]
        found.append(min(range(len(points)), key=lambda r: (key[r], u[r], r)))
        new = ((points - points[found[-1]]) ** 2).sum(axis=1)
        d = new if d is None else np.minimum(d, new)
    return found


@pytest.mark.parametrize("n, distinct, k", [(300, 300, 45), (40, 4, 6)])
def test_a_pass_over_the_rows_serves_many_starts(spark, n, distinct, k):
    points = np.random.default_rng(1).normal(0, 1, (distinct, 5))[np.arange(n) % distinct]
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, v array<double>").repartition(3)
    spark.sparkContext.setJobGroup(f"starts-{n}", "starts")
    got = [r for r, _ in kmeans.dsquared_starts(df, "id", "v", k)]
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"starts-{n}"))
    assert got == starts_one_by_one(points, k, 42) and (jobs < k or distinct < k)


def test_only_columns_that_are_read_go_to_the_stateful_operator(spark, tmp_path):
    kinds = "thread_id string, event_id long, noise string, role string, status string, action_type string, observation string, requests array<string>, commitments array<string>"
    stream = ledger.summaries(spark.readStream.schema(kinds).parquet(str(tmp_path)))
    projects = [x for x in stream._jdf.queryExecution().analyzed().toString().splitlines() if "Project [" in x]
    assert projects and any("observation" in x and "noise" not in x for x in projects)


def best_by_all_pairs(docs, queries, top):
    split = [(i, re.findall("[a-z0-9]+", t.lower())) for i, t in docs if t is not None]
    avg, tf, found = sum(len(w) for _, w in split) / len(split), {}, []
    for i, w in split:
        for t in w:
            tf[i, t, len(w)] = tf.get((i, t, len(w)), 0) + 1
    df = {}
    for _, t, _ in tf:
        df[t] = df.get(t, 0) + 1
    for item, text in queries:
        scores, asked = {}, set(re.findall("[a-z0-9]+", text.lower()))
        for (i, t, n), c in tf.items():
            if t in asked:
                scores[i] = scores.get(i, 0) + math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * n / avg))
        best = sorted((-round(s, 5), 10**9 if i is None else i) for i, s in scores.items())[:top]
        found += [(item, i, -s, r + 1) for r, (s, i) in enumerate(best)]
    return sorted(found)


def of_zipf(n, seed, ids):
    rng = np.random.default_rng(seed)
    return [(ids(i), " ".join(f"w{min(x, 900)}" for x in rng.zipf(1.3, rng.integers(20, 60)))) for i in range(n)]


def test_few_documents_are_scored_on_all_words(spark, monkeypatch):
    docs, seen, scored = of_zipf(400, 1, lambda i: i), [], retrieval._scored
    queries = [(i, docs[i * 7][1] + " W1, w2") for i in range(20)]
    monkeypatch.setattr(retrieval, "_scored", lambda pairs, *rest: seen.append(pairs.count()) or scored(pairs, *rest))
    out = retrieval.bm25(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "item_id long, text string"))
    got = sorted((r.item_id, r.doc_id, r.score, r["rank"]) for r in out.collect())
    assert got == best_by_all_pairs(docs, queries, 3)
    assert seen[-1] < 20 * 400 / 10, seen


def test_best_documents_with_repeated_and_null_ids(spark):
    docs = of_zipf(120, 2, lambda i: i // 3 if i else None) + [(500, None), (501, ""), (7, "w1"), (502, " W3-w4_w3 ÄW5\n")]
    queries = [(i, docs[i * 5][1]) for i in range(12)] + [(50, "w3 w4"), (51, "nowhere"), (52, None)]
    out = retrieval.bm25(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "item_id long, text string"))
    got = sorted((r.item_id, 10**9 if r.doc_id is None else r.doc_id, r.score, r["rank"]) for r in out.collect())
    assert got == best_by_all_pairs(docs, [q for q in queries if q[1]], 3)


def test_acts_are_routed_once_for_their_observations(spark, sf_dir, monkeypatch):
    routes, route = [], grounding.routed
    monkeypatch.setattr(grounding, "routed", lambda df: routes.append(plans(route(df))[0]) or route(df))
    logical, _ = plans(corpus.QUERIES["r01_reground"](spark, sf_dir))
    assert logical.count("Relation [l_orderkey#") == 1  # the segments; acts were read and routed before
    assert len(routes) == 1 and routes[0].count("not[_ ]required") == 5  # a test for each of the five columns
    assert "RLIKE" not in logical


def test_fixed_patterns_find_what_patterns_of_numbers_find(spark):
    words = {"Extract_Table": (r"Table|Tab\.?", "", ""), "Extract_Figure_Caption": (r"Figure|Fig\.?", "", ""), "Extract_Equation": (r"Eq\.?,?|Equation", r"\(?", r"\)?"), "Extract_Algorithm": (r"Algorithm|Alg\.?", "", "")}
    heads = ["Table", "tab.", "Tab", "tables", "xTable", "Table Table", "fig.", "FIGURE", "Eq", "Eq.,", "eq,", "Equation", "Alg.", "algorithm", "Tab.1 Tab."]
    texts = [h + gap + n + tail for h in heads for gap in ("", " ", "  (", "\n", "(") for n in ("1", "12", "21", "1.2", "1 2", "") for tail in ("", ")", ")x", "x", ").", " and Table 2", "-2")]
    pairs = spark.createDataFrame([(t,) for t in texts], "text string").crossJoin(spark.createDataFrame([(s, v) for s in words for v in ("1", "2", "12", "21")], "skill string, value string"))
    old = F.lit(None).cast("boolean")
    for skill, (w, a, b) in words.items():
        old = F.when(F.col("skill") == skill, F.rlike("text", F.concat(F.lit(rf"(?i)\b(?:{w})\s*{a}"), F.col("value"), F.lit(rf"{b}\b")))).otherwise(old)
    seen = pairs.select(grounding._answers().alias("new"), old.alias("old")).groupBy("new", "old").count().collect()
    assert {(r.new, r.old) for r in seen} == {(True, True), (False, False)}


def test_references_that_say_that_there_is_none(spark):
    void = ["n/a", "N/A", " NA ", "none", "None", "not_required", "n/a, see below", "na table", "is not required here", "x NOT_REQUIRED", "", "  ", None]
    kept = ["nah", "nan", "na\n", "none of these", "nonesuch", "not  required", "see n/a", "\nna table", "not_requ\u0130red", "Table 3"]
    rows = spark.createDataFrame([(x,) for x in void + kept], "c string").select(core.clean_ref("c").alias("c"), core._given("c").alias("g")).collect()
    assert [r.c for r in rows] == [""] * len(void) + kept and [r.g for r in rows] == [None] * len(void) + kept
