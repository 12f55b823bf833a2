"""Hand-checked values, quirks that results depend on, files, and the streaming ledger."""

import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from actloom.functions import core, stats
from actloom.operators import cluster, external
from actloom.operators.extract import OPERATORS, clean_segments, extract, intervals
from actloom.operators.skills import SKILLS, run_skill
from actloom.plans import arena, corpus_stats, grounding, retrieval, specs
from actloom.sources import markdown, readers, sinks


@pytest.fixture(scope="module")
def segments(spark):
    texts = [
        "Table 2: accuracy = 0.91 and F1 is 91%.", "We compare against BERT-base and RoBERTa baselines.", "weight decay 1e-4. lr = 0.1, dropout 0.5",
        "Code: https://github.com/a/b. and http://x.org/data,", "We define the margin as a bound [3, 4].", "lr = 0.2; trained on 8 x A100 for 3 hours", "2.1 Method overview of the dataset split for training", "no limitations here",
    ]
    return spark.createDataFrame([("p", i + 1, t) for i, t in enumerate(texts)] + [("empty", None, None)], "ctx string, id int, text string")


def one(segments, name, params=None, ctx="p"):
    return extract(segments, name, params).filter(F.col("ctx") == ctx).first()


def test_extraction_values(segments):
    assert one(segments, "Extract_Metric_Values", {"metric": "F1"})["items"] == ["2", "0.91", "1", "91%"]
    assert one(segments, "Extract_Code_Data_Links", {})["items"] == ["https://github.com/a/b", "http://x.org/data", "https://github.com/a/b"]
    h = one(segments, "Extract_Hyperparameters", {})
    assert dict(x.split("=") for x in h["items"]) == {"learning_rate": "0.2", "dropout": "0.5", "weight_decay": "1e-4."} and h.prov == [3, 6]
    assert one(segments, "Extract_Baseline_List", {})["items"] == ["BERT-base", "RoBERTa"]
    assert one(segments, "Extract_Compute_Resources", {})["items"] == ["8xA100", "3 hours"]
    assert one(segments, "Extract_Table", {"table_id": "Table 2"}).prov == [1]
    assert one(segments, "Resolve_Citation", {"cite_key": "[4]"}).prov == [5]
    assert one(segments, "Extract_Definition", {"term": "Margin"}).status == "ok"


def test_statuses_and_limits(segments):
    assert one(segments, "Extract_Span", {"query": "a", "max_matches": 0}).prov == [1, 2, 3, 4, 5]
    assert one(segments, "Extract_Span", {"query": "a", "max_matches": -1}).prov == [1, 2, 3, 4, 5]
    assert one(segments, "Extract_Dataset_Info", {"max_matches": -1, "dataset": "a"}).prov == [1]
    assert one(segments, "Extract_Span", {"query": "a", "max_matches": 2}).prov == [1, 2]
    lost = one(segments, "Extract_Span", {})
    assert (lost.status, lost.type, lost.prov) == ("missing", "evidence", [])
    gone = one(segments, "Extract_Span", {"query": "zzz"})
    assert (gone.status, gone.type) == ("missing", "text")
    assert one(segments, "Extract_Limitations", None).status == "fail" and one(segments, "Extract_Limitations", {}).status == "missing"
    assert one(segments, "Extract_Span", {"query": "a"}, "empty").status == "missing"


def test_observation_id(segments):
    import hashlib

    o = one(segments, "Extract_Table", {"table_id": 2})
    assert o.id == "O" + hashlib.sha256(json.dumps({"prov": [1], "type": "text"}, sort_keys=True).encode()).hexdigest()[:12]


def test_unusable_segments(spark):
    rows = spark.createDataFrame([("p", "1", "a"), ("p", "x", "a"), ("p", None, "a"), ("p", "2", None), ("q", None, None)], "ctx string, id string, text string")
    out = {r.ctx: r.prov for r in extract(clean_segments(rows), "Extract_Span", {"query": "a"}).collect()}
    assert out == {"p": [1], "q": []}


def test_every_operator_and_skill_runs(segments):
    params = {"query": "a", "title": "Method", "table_id": 1, "figure_id": 1, "eq_id": 1, "algo_id": 1, "cite_key": "[3]", "term": "margin", "symbol": "A", "metric": "F1"}
    for name in OPERATORS:
        assert extract(segments, name, params).count() == 2
    needs = {"Verify_Definition": {"term": "margin"}, "Verify_Claim_With_Evidence": {"queries": ["BERT"]}, "Check_Citation_Support": {"cite_key": "[3]"}, "Check_Result_Consistency": {"expected": {"accuracy": 0.9}, "tolerance": 0.02}, "Verify_Equation_Assumption": {"eq_id": 3}}
    for name in SKILLS:
        rows = {r.ctx: r for r in run_skill(segments, name, **needs.get(name, {})).collect()}
        assert set(rows) == {"p", "empty"} and rows["empty"].status == ("ok" if name == "Check_Experimental_Setup" else "missing"), name  # metrics count as found unless asked for
    assert run_skill(segments, "Verify_Definition", term="").filter("status <> 'missing'").count() == 0
    r = run_skill(segments, "Check_Result_Consistency", expected={"accuracy": 0.9}, tolerance=0.02).filter("ctx = 'p'").first()
    assert r.supported
    r = run_skill(segments, "Check_Baseline_Coverage", expected=["bert-BASE", "GPT"]).filter("ctx = 'p'").first()
    assert (r.supported, r.missing) == (False, ["GPT"])


def test_intervals(spark):
    (r,) = spark.createDataFrame([("x [ -1.5 , 2] and 3 ± .5",)], "t string").select(intervals(F.col("t")).alias("i")).collect()
    assert [tuple(x) for x in r.i] == [(-1.5, 2.0, "bracket"), (2.5, 3.5, "plus_minus")]


def test_statistics(spark):
    rows = spark.createDataFrame([("g", k, float(v)) for k, vs in (("a", (1, 2, 3)), ("b", (1, 1, 1))) for v in vs], "key string, side string, v double")
    s = stats.two_samples(rows, ["key"], "side", "a", "b", "v")
    assert round(stats.effect_size(s).first().effect_size, 3) == 1.414
    t = stats.t_statistic(s).first()
    assert round(t.t_stat, 6) == 1.732051 and round(t.p_value, 4) == 0.0833 and t.df is None
    assert stats.t_statistic(s, True).first().df == 4
    flat = stats.two_samples(rows.withColumn("v", F.lit(1.0)), ["key"], "side", "a", "b", "v")
    assert stats.effect_size(flat).first().status == "missing" and stats.t_statistic(flat).first().status == "missing"
    ci = stats.bootstrap_ci(rows.withColumn("n", F.monotonically_increasing_id()), ["key"], "v", "n", n_boot=100, seed=3).first()
    assert ci.status == "ok" and 1 <= ci.lower <= ci.upper <= 3
    assert [stats.digits(x) for x in (None, 0, 3)] == [6, 6, 3]
    assert [stats.auto_k(n) for n in (0, 1, 2, 6, 100)] == [1, 1, 2, 2, 10] and stats.auto_k(10, target=4) == 3 and stats.auto_k(3, explicit=9) == 3
    (r,) = spark.range(1).select(stats.float_list(F.array(F.lit("1"), F.lit("x"), F.lit("2.5"))).alias("f"), F.bround(F.lit(2.5), 0).alias("b")).collect()
    assert (r.f, r.b) == ([1.0, 2.5], 2.0)


def test_distributed_bootstrap_covers_the_mean(spark):
    rows = spark.range(4000).select(F.lit("g").alias("k"), F.col("id").alias("u"), (F.col("id") % 10).cast("double").alias("v"))
    r = stats.bootstrap_ci_distributed(rows, ["k"], "v", "u", n_boot=60).first()
    assert r.lower < 4.5 < r.upper and r.upper - r.lower < 0.4


def test_equations():
    p = stats.parse_equation
    assert stats.canonical(p("x+y")) == stats.canonical(p("y + x")) and stats.canonical(p("x-y")) != stats.canonical(p("y-x"))
    assert stats.symbols(p(r"a \cdot x^{2}")) == ["a", "x"]
    units = {"x": {"L": 1}, "v": {"L": 1, "T": -1}, "t": {"T": 1}}
    assert stats.dimension(p("v*t", "python"), units) == {"L": 1.0}
    assert stats.dimension(p("v**2/v", "python"), units) == {"L": 1.0, "T": -1.0}
    for bad in ("", "import os", "f(x)", "x[0]", "x +"):
        with pytest.raises(stats.EquationError):
            p(bad)
    with pytest.raises(stats.EquationError, match="unknown_symbol"):
        stats.dimension(p("q"), units)


def test_significance(spark):
    rows = spark.createDataFrame([("a significant gain",), ("not significant",), ("nothing",), ("",), (None,)], "c string")
    got = [r.k for r in rows.select(stats.significance_claim(F.col("c")).alias("k")).collect()]
    assert got == ["significant", "not_significant", None, None, None]


def test_lookups(spark):
    payload = json.dumps({"abstract_inverted_index": {"deep": [0], "learning": [1]}, "referenced_works": []})
    snaps = sinks.snapshots(spark.createDataFrame([("u1", payload), ("u2", None)], "url string, payload string"))
    found = external.lookup(spark.createDataFrame([("u1",), ("u2",), ("u3",)], "url string"), snaps)
    assert {r.url: r.reason for r in found.collect()} == {"u1": None, "u2": "not_found", "u3": "cache_miss"}
    assert external.abstract(found).filter("url = 'u1'").first().abstract == "deep learning"
    assert {r.url: (r.status, r.exists) for r in external.exists(found).collect()} == {"u1": ("ok", True), "u2": ("ok", False), "u3": ("missing", None)}


def test_markdown(spark):
    text = "intro\n\n# One\n" + "x" * 1900 + "\n\n   \n## Two ##\nline a\nline b\n"
    rows = [tuple(r) for r in markdown.segment(spark.createDataFrame([("d", text)], "ctx string, text string")).orderBy("id").collect()]
    assert [(i, len(t), s) for _, i, t, s in rows] == [(1, 5, None), (2, 3, "One"), (3, 900, "One"), (4, 900, "One"), (5, 100, "One"), (6, 6, "Two ##"), (7, 13, "Two ##")]


def test_readers_and_sinks(spark, tmp_path):
    record = {"forum_id": "f", "analysis": {"mining_results": [{"role": "Reviewer", "action": "ask", "source_seg_ids": ["t_1"]}, {"role": "author"}]}}
    (tmp_path / "m.jsonl").write_text(json.dumps(record) + "\n\n" + json.dumps({"analysis": {"mining_results": [{}]}}) + "\n")
    (tmp_path / "m.json").write_text(json.dumps([record], indent=1))
    acts = readers.flatten_mining(readers.read_records(spark, f"{tmp_path}/m.jsonl", readers.MINING))
    assert sorted(r.act_id for r in acts.collect()) == ["UNKNOWN#0000", "f#0000", "f#0001"]
    for name in ("m.json", "m.jsonl"):
        assert readers.flatten_mining(readers.sniff_records(spark, f"{tmp_path}/{name}", readers.MINING)).filter("forum_id = 'f'").count() == 2
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.read_records(spark, f"{tmp_path}/none.jsonl", readers.MINING)
    (tmp_path / "s.json").write_text(json.dumps({"train": ["a", "b"], "test": ["c"]}))
    (tmp_path / "s.jsonl").write_text('{"forum": "a", "set": "TRAIN"}\n{"forum_id": "b", "partition": "dev"}\n{"forum_id": "c", "split": "x"}\n')
    assert sorted(map(tuple, readers.read_splits(spark, f"{tmp_path}/s.json").collect())) == [("a", "train"), ("b", "train"), ("c", "test")]
    assert sorted(map(tuple, readers.read_splits(spark, f"{tmp_path}/s.jsonl").collect())) == [("a", "train"), ("b", "dev")]
    sinks.write_records(acts, f"{tmp_path}/out")
    sinks.write_records(acts, f"{tmp_path}/out", append=True)
    assert spark.read.json(f"{tmp_path}/out").count() == 6
    (tmp_path / "p.md").write_text("# A\nb")
    assert readers.read_markdown(spark, f"{tmp_path}/*.md").first().ctx == "p"
    segs = markdown.segment(readers.read_markdown(spark, f"{tmp_path}/*.md"))
    sinks.write_contexts(segs, f"{tmp_path}/contexts")
    assert spark.read.json(f"{tmp_path}/contexts").count() == 2
    (tmp_path / "c.jsonl").write_text('{"id": 1, "text": "x"}\n{"id": 2}\n')
    assert readers.segment_counts(readers.read_context_segments(spark, f"{tmp_path}/c.jsonl")).first().n_segments == 1
    report = spark.createDataFrame([Row(a=1, b=None)], "a int, b string")
    assert json.loads(sinks.document(report)) == {"a": 1} and sinks.latex_rows(report, ["a", "b"]) == r"1 & -- \\"
    threads = spark.createDataFrame([("t", "p"), ("u", "q")], "issue_id string, context_id string")
    held = segs.groupBy("ctx").agg(F.array_sort(F.collect_list(F.struct(F.col("id").cast("int").alias("id"), "text"))).alias("segments"))
    assert {r.issue_id: len(r.segments) for r in readers.resolve_contexts(threads, held.filter("ctx = 'none'"), held).collect()} == {"t": 2, "u": 0}
    (tmp_path / "e" / "run").mkdir(parents=True)
    (tmp_path / "e" / "run" / "events.jsonl").write_text('{"type": "move"}\n')
    (tmp_path / "e" / "run" / "other.jsonl").write_text('{"type": "move"}\n')
    assert readers.event_files(spark, f"{tmp_path}/e", "type string").count() == 1


def test_scalars(spark):
    rows = spark.createDataFrame([("pre {\"a\": {\"b\": 1}} post", "```json\nx = 1\n```", "https://doi.org/10.1/X", "a_b_12", "", 0)], "j string, c string, d string, s string, e string, z int")
    r = rows.select(
        core.json_object(F.col("j")).alias("j"), core.code_block(F.col("c")).alias("c"), core.strip_doi(F.col("d")).alias("d"), core.turn_id(F.col("s")).alias("s"), core.truthy("e", "x").alias("e"), core.truthy_number("z", 6).alias("z"),
        core.valid_status(F.lit("odd")).alias("v"), core.mean_iqr(F.lit(7.56), F.lit(5.0), F.lit(10.0)).alias("m"), core.slug(F.col("d")).alias("g"),
    ).first()
    assert tuple(r) == ('{"a": {"b": 1}}', "x = 1", "10.1/X", "a_b", "x", 6, "fail", "7.6 [p25 5, p75 10]", "https_doi_org_10_1_x")


def test_routing_tests_substrings(spark):
    rows = spark.createDataFrame([("establish 3",), ("a second look",), ("Tab. 4",), ("Fig. A-12",), ("Appendix Table B",), ("equation two",)], "q string")
    got = [tuple(r.r) for r in rows.select(core.route("q").alias("r")).collect()]
    assert got == [("Extract_Span", "query", "establish 3"), ("Extract_Section", "title", "a second look"), ("Extract_Span", "query", "Tab. 4"), ("Extract_Figure_Caption", "figure_id", "12"), ("Extract_Section", "title", "Appendix"), ("Extract_Span", "query", "equation two")]


def _moves(spark, rows):
    return spark.createDataFrame([("t", i, *r) for i, r in enumerate(rows)], "thread_id string, event_id int, role string, status string, action_type string, n_requests int, n_commitments int")


def test_ledger(spark):
    run = lambda rows, **k: arena.replay(_moves(spark, rows), "thread_id", ["event_id"], **k).first()
    r = run([("Reviewer", "missing", "request", 1, 0), ("Author", "ok", "evidence_response", 0, 1)])
    assert (r.phase, r.budget, r.observations, r.requests, r.commitments) == ("Negotiation", 4, 1, 0, 1)
    assert run([("Reviewer", "ok", "close", 0, 0), ("Author", "ok", "x", 0, 0)]).moves == 1
    assert run([("Reviewer", "missing", "clarification", 1, 0)] * 9)[1:] == ("Closed", 0, 0, 6, 0, "Reviewer", 6)
    assert run([("Reviewer", "ok", "x", 0, 0)] * 3, budget=0).budget == 3


def test_stub_run_is_the_known_one(spark):
    out = arena.stub_run(spark.createDataFrame([("a",)], "issue_id string")).first()
    assert (out.phase, out.budget, out.moves, out.observations) == ("Closed", 0, 6, 0)
    assert arena.close_rate(arena.stub_run(spark.createDataFrame([("a",)], "issue_id string"))).first().close_rate == 0.0


def test_streaming_ledger_equals_the_fold(spark, tmp_path):
    from actloom.streaming.ledger import ledgers

    rows = [("Reviewer", "missing", "request", 1, 0), ("Author", "ok", "evidence_response", 0, 1), ("Reviewer", "ok", "x", 0, 0), ("Reviewer", "fail", "close", 0, 0)]
    moves = _moves(spark, rows)
    for i in range(4):
        moves.filter(F.col("event_id") == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(moves.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = ledgers(stream).writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = spark.table("states").orderBy(F.desc("moves")).first()
    assert tuple(last) == tuple(arena.replay(moves, "thread_id", ["event_id"]).first())


def test_grounding_and_splits(spark):
    acts = spark.createDataFrame([("a#0000", "f", "", "", "", "", "", "i", 0, None, "reviewer"), ("a#0001", "f", "n/a", "", "none", "lookup", "", "i", 1, 5.0, "x")], "act_id string, forum_id string, grounding_ref string, action string, intent string, operation string, target_type string, issue_id string, pos int, timestamp double, role string")
    assert [r.query for r in grounding.routed(acts).orderBy("act_id").collect()] == ["evidence", "lookup"]
    (t,) = grounding.threads(acts).collect()
    assert (t.issue_id, t.issue_text, t.budget, t.request) == ("i", "", 6, "")
    assert corpus_stats.year_range("2018-2020, 2025,x,") == [2018, 2019, 2020, 2025]
    stats_ = spark.createDataFrame([(f"f{i}", i, 2020 if i < 3 else 2024) for i in range(6)], "forum_id string, first int, year int")
    assert sorted(map(tuple, corpus_stats.default_splits(stats_, 2, 1, 2, 5).collect())) == [("f0", "train"), ("f1", "train"), ("f2", "dev"), ("f3", "test"), ("f4", "test")]
    assert sorted(map(tuple, corpus_stats.temporal_splits(stats_, [1999], [2024], 2, 9, 2, 6).collect())) == [("f0", "train"), ("f1", "train"), ("f2", "dev"), ("f3", "test"), ("f4", "test")]


def test_registry():
    r = specs.Registry()
    r.register("A", "primitive", lambda: 1)
    r.register("B", "skill", lambda: 2, ("A", "C"))
    r.register("", "primitive", lambda: 3)
    with pytest.raises(ValueError):
        r.register("A", "primitive", lambda: 4)
    with pytest.raises(LookupError, match="primitive_missing:C"):
        r.run("B")
    assert r.closure(["B", "A"]) == ["A", "C", "B"] and r.run("A") == 1
    assert len(specs.library().entries) == len(OPERATORS) + len(SKILLS)


def test_label_memory_and_samples(spark):
    labels = spark.createDataFrame([("s", 1, "1", "a"), ("s", 2, "2", "b"), ("s", 3, "3", "a"), ("t", 9, "4", "a")], "s string, n int, c string, l string")
    taken = lambda memory: {r.c: (r.taken, r.reused) for r in cluster.label_memory(labels, "s", "n", "c", "l", memory).collect()}
    assert taken(50) == {"1": ("1", False), "2": ("2", False), "3": ("1", True), "4": ("4", False)}
    assert taken(1)["3"] == ("3", False)
    rows = spark.range(50).withColumn("k", F.lit(1))
    assert cluster.samples(rows, ["k"], "id", 6).count() == 6 and cluster.row_sample(rows, "id", 5).count() == 5
    assert cluster.normalized(F.array(F.lit(0.0))) is not None
    sizes = cluster.size_summary(cluster.cluster_sizes(rows.withColumn("k", F.col("id") % 4), ["k"])).first()
    assert tuple(sizes) == (12, 12.5, 12.5, 13)
    assert retrieval.split_forums(spark.createDataFrame([("a", -3), ("b", 2), ("c", 0)], "forum_id string, c int"), "c", 1).first().forum_id == "a"


def test_failing_provider_gives_nulls(spark):
    from actloom.sources.providers import HashingEmbedder, embed, labels, stub_labels

    rows = spark.createDataFrame([("a b",), (None,)], "t string")

    def broken(texts):
        raise OSError("down")

    out = embed(rows, "t", broken).collect()
    assert all(r.embedding is None and "down" in r.embedding_error for r in out)
    assert all(r.embedding is None for r in embed(rows, "t", lambda x: [[1.0]] * 9).collect())
    good = {r.t: r.embedding for r in embed(rows, "t", HashingEmbedder(8)).collect()}
    assert abs(sum(x * x for x in good["a b"]) - 1) < 1e-6 and not any(good[None])
    assert [r.label for r in labels(rows, stub_labels, "t").collect()] == ["a b", ""]


def test_runs_with_and_without_a_round_limit(spark):
    threads = spark.createDataFrame([(f"i{i}", i, "ok" if i % 2 else "missing") for i in range(5)], "issue_id string, pos int, status string")
    all_ = arena.run_rounds(threads, 9)
    assert all_.count() == 5 * 6 and all_.filter("phase = 'Closed'").count() == 5
    few = arena.run_rounds(threads, 7, per_round=2)
    by_round = {r["round"]: r.ids for r in few.groupBy("round").agg(F.array_sort(F.collect_list("issue_id")).alias("ids")).collect()}
    assert by_round == {**{i: ["i0", "i1"] for i in range(6)}, 6: ["i2", "i3"]}


def test_scoped_and_minibatch_kmeans(spark):
    """Two tight clouds in each scope, and in all: members of a cloud share a cluster."""
    rows = [(i, "s" if i % 2 else "t", [float(i % 4 // 2) * 50 + i * 0.01, float(i % 2)]) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, scope string, v array<double>").repartition(3)
    out = cluster.kmeans_scoped(df, "scope", "v", "id", 2).collect()
    for scope in "st":
        clouds = {(r.id % 4 // 2, r.cluster_id) for r in out if r.scope == scope}
        assert len(out) == 80 and len(clouds) == 2 and {c for _, c in clouds} == {0, 1}
    one = cluster.kmeans_scoped(df, "scope", "v", "id", 100, max_iter=1)
    assert one.groupBy("scope", "cluster_id").count().filter("count > 1").count() == 0
    mini = {r.id: r.cid for r in cluster.kmeans_minibatch(df, "v", "id", 2, batch=40).collect()}
    assert len({(i % 4 // 2, c) for i, c in mini.items()}) == 2


def test_assignment_in_blocks_of_centers(spark):
    vectors = spark.createDataFrame([(i, [float(i)]) for i in range(40)], "id long, v array<double>")
    centers = spark.createDataFrame([(c, [float(c)]) for c in range(0, 40, 3)], "cid long, centroid array<double>")
    whole, blocks = (sorted(map(tuple, cluster.assign(vectors, centers, "id", "v", most=m).collect())) for m in (100, 4))
    assert whole == blocks and all(cid == min(range(0, 40, 3), key=lambda c: (abs(c - i), c)) for i, cid, _ in whole)


def test_numbers_over_range_partitions(spark):
    from actloom.plans.numbering import numbered

    rows = [(i * 7919 % 1000, i % 3) for i in range(1000)]
    got = numbered(spark.createDataFrame(rows, "a int, b int").repartition(5), [F.col("b").desc(), F.col("a")]).collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.n)] == sorted(rows, key=lambda r: (-r[1], r[0])) and sorted(r.n for r in got) == list(range(1, 1001))


def test_reports_do_not_cut_rows(spark):
    from actloom.sources.sinks import latex_rows

    df = spark.range(3).select("id", F.lit(None).cast("string").alias("x"))
    assert latex_rows(df.orderBy("id"), ["id", "x"]) == "\n".join(f"{i} & -- \\\\" for i in range(3))
    with pytest.raises(ValueError):
        latex_rows(df, ["id"], most=2)


def test_fixed_intents_where_none_are_given(spark):
    from actloom.sources.readers import INTENTS, intents

    empty = spark.createDataFrame([], "label string, intent string, pos long")
    assert [r.intent for r in intents(empty).orderBy("first").collect()] == list(INTENTS)
    some = spark.createDataFrame([("b", None, 2), ("", "a", 1), ("b", "c", 0), (None, None, 3)], empty.schema)
    assert [r.intent for r in intents(some).orderBy("first").collect()] == ["b", "a"]


def test_p_values_are_those_of_the_error_function(spark):
    import math

    ts = [0.0, 1e-9, -0.3, 1.0, 1.96, -2.5, 4.0, 6.9, 7.2, 9.0, 37.0, None, float("nan")]
    got = [r.p for r in spark.createDataFrame([(t,) for t in ts], "t double").select(stats.two_sided(F.col("t")).alias("p")).collect()]
    for t, p in zip(ts, got, strict=True):
        want = None if t is None or t != t else math.erfc(abs(t) / math.sqrt(2))
        assert p is None if want is None else abs(p - want) <= 1e-14 + 1e-4 * want * (abs(t) > 7)
