"""Threads, ledgers, schedules and run metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..plans import arena, grounding
from ..sources.scratch import scratch
from ..streaming import ledger
from ..streaming.ledger import kept_by_batch, ledgers, windowed_status
from ..views import view
from .acts import ROUTED

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


_REPLAY = """
RECURSIVE m AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY ts, event_id) AS n FROM moves),
f AS (
  SELECT thread_id, 0::BIGINT AS n, 'Open' AS phase, 6 AS budget, 0 AS observations, 0 AS requests, 0 AS commitments, NULL::VARCHAR AS last_role, 0 AS moves FROM m WHERE n = 1
  UNION ALL
  SELECT m.thread_id, m.n, CASE WHEN action_type = 'close' OR budget <= 1 THEN 'Closed' WHEN role = 'Reviewer' AND action_type IN ('request', 'clarification') THEN 'EvidencePending' WHEN role = 'Author' THEN 'Negotiation' ELSE phase END,
    greatest(budget - 1, 0), observations + (status = 'ok')::INT, CASE WHEN role = 'Author' AND status = 'ok' THEN 0 ELSE requests + n_requests END, commitments + n_commitments, role, f.moves + 1
  FROM f JOIN m ON m.thread_id = f.thread_id AND m.n = f.n + 1 WHERE phase <> 'Closed')
"""
_FINAL = "SELECT thread_id, phase, budget, observations, requests, commitments, last_role, moves FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY n DESC) AS r FROM f) WHERE r = 1"


def _states(s, d):
    return arena.replay(view(s, d, "moves"), "thread_id", ["ts", "event_id"])


@query("t04_ledger", f"WITH {_REPLAY.strip()} {_FINAL}")
def _ledger(s, d):
    return _states(s, d)


@query("t04_streamed_ledger", f"WITH {_REPLAY.strip()} {_FINAL}")
def _streamed(s, d):
    """The stateful operator over the moves as a stream: the last state of each thread."""
    source, out, check = (scratch(s, n) for n in ("moves", "states", "progress"))
    view(s, d, "moves").write.parquet(source)
    stream = ledgers(s.readStream.schema(s.read.parquet(source).schema).parquet(source), order=["ts", "event_id"])
    keep = lambda states, number: kept_by_batch(states, number, out)
    stream.writeStream.outputMode("update").option("checkpointLocation", check).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    states = s.read.parquet(out)
    rest = [c for c in states.columns if c not in ("thread_id", "batch")]
    return states.groupBy("thread_id").agg(F.max_by(F.struct(*rest), "batch").alias("x")).select("thread_id", "x.*")


#: Moves with the texts of what they ask for and promise.
_TEXTS = """SELECT *, 'O' || event_id AS observation, CASE WHEN n_requests > 0 THEN ['request ' || event_id, ''] ELSE [] END AS requests,
  CASE WHEN n_commitments > 0 THEN ['commitment ' || event_id] ELSE [] END AS commitments FROM moves"""
_SUMMARY = f"""WITH RECURSIVE m AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY ts, event_id) AS n FROM ({_TEXTS})),
f AS (
  SELECT thread_id, 0::BIGINT AS n, 'Open' AS phase, 6 AS budget, []::VARCHAR[] AS observations, []::VARCHAR[] AS requests, []::VARCHAR[] AS commitments, NULL::VARCHAR AS last_role, 0 AS moves FROM m WHERE n = 1
  UNION ALL
  SELECT m.thread_id, m.n, CASE WHEN action_type = 'close' OR budget <= 1 THEN 'Closed' WHEN role = 'Reviewer' AND action_type IN ('request', 'clarification') THEN 'EvidencePending' WHEN role = 'Author' THEN 'Negotiation' ELSE phase END,
    greatest(budget - 1, 0), CASE WHEN status = 'ok' THEN list_append(f.observations, m.observation) ELSE f.observations END,
    CASE WHEN role = 'Author' AND status = 'ok' THEN [] ELSE list_concat(f.requests, list_filter(m.requests, lambda x: x <> '')) END, list_concat(f.commitments, m.commitments), role, f.moves + 1
  FROM f JOIN m ON m.thread_id = f.thread_id AND m.n = f.n + 1 WHERE phase <> 'Closed')
SELECT thread_id, phase, budget, array_to_string(observations, '|') AS observations, array_to_string(requests, '|') AS requests, array_to_string(commitments, '|') AS commitments, last_role, moves
FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY n DESC) AS r FROM f) WHERE r = 1"""


def _with_texts(s, d):
    m, some = view(s, d, "moves"), F.array().cast("array<string>")
    text = lambda what: F.concat(F.lit(what + " "), F.col("event_id").cast("string"))
    asks = F.when(F.col("n_requests") > 0, F.array(text("request"), F.lit(""))).otherwise(some)
    return m.withColumns({"observation": F.concat(F.lit("O"), F.col("event_id").cast("string")), "requests": asks, "commitments": F.when(F.col("n_commitments") > 0, F.array(text("commitment"))).otherwise(some)})


def _joined(df):
    return df.select("thread_id", "phase", "budget", *[F.array_join(c, "|").alias(c) for c in ledger.LISTS], "last_role", "moves")


@query("t02_summaries", _SUMMARY)
def _summaries(s, d):
    return _joined(arena.summaries(_with_texts(s, d), "thread_id", ["ts", "event_id"]))


@query("t04_streamed_summaries", _SUMMARY)
def _streamed_summaries(s, d):
    """The stateful operator with list states, over the moves as a stream of two micro-batches by time and a restart."""
    source, out, check = (scratch(s, n) for n in ("moves", "states", "progress"))
    rows = _with_texts(s, d)
    cut = rows.agg(F.expr("min(ts) + (max(ts) - min(ts)) / 2").alias("cut"))  # one row
    name, store = "spark.sql.streaming.stateStore.providerClass", s.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    s.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in ("ts <= cut", "ts > cut"):  # the second run goes on from the first one's checkpoint
            rows.crossJoin(F.broadcast(cut)).filter(part).drop("cut").write.mode("append").parquet(source)
            stream = ledger.summaries(s.readStream.schema(rows.schema).parquet(source), order=["ts", "event_id"])
            keep = lambda states, number: kept_by_batch(states, number, out)
            stream.writeStream.outputMode("update").option("checkpointLocation", check).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    finally:
        s.conf.unset(name) if store is None else s.conf.set(name, store)
    states = s.read.parquet(out)
    rest = [c for c in states.columns if c not in ("thread_id", "batch")]
    return _joined(states.groupBy("thread_id").agg(F.max_by(F.struct(*rest), "batch").alias("x")).select("thread_id", "x.*"))


@query("t03_next_role", f"WITH {_REPLAY.strip()} SELECT thread_id, CASE WHEN phase = 'Negotiation' AND coalesce(last_role, '') <> 'Author' THEN 'Author' ELSE 'Reviewer' END AS next_role FROM ({_FINAL})")
def _next(s, d):
    return _states(s, d).select("thread_id", arena.next_role(F.col("phase"), F.col("last_role")).alias("next_role"))


@query("a06_close_rate", f"WITH {_REPLAY.strip()} SELECT round(count(*) FILTER (WHERE phase = 'Closed' AND requests = 0) / count(*), 6) AS close_rate FROM ({_FINAL})")
def _close(s, d):
    return arena.close_rate(_states(s, d))


_METRICS = """count(*) AS total_moves, round(count(*) FILTER (WHERE status = 'ok') / count(*), 6) AS ok_rate, round(count(*) FILTER (WHERE status <> 'ok') / count(*), 6) AS missing_or_fail_rate,
  round(count(*) FILTER (WHERE status <> 'ok' AND n_claims > 0) / count(*), 6) AS halluc_missing_rate, round(sum(least(n_cited, n_claims)) / sum(n_claims), 6) AS claim_support_proxy,
  round(count(*) FILTER (WHERE intent = gold_intent AND skill = gold_skill) / count(gold_intent), 6) AS plan_acc FROM moves"""


def _moves(s, d):
    return view(s, d, "moves").withColumn("n_cited", F.least("n_cited", "n_claims"))


@query("a06_metrics", f"SELECT {_METRICS}")
def _metrics(s, d):
    return arena.metrics(_moves(s, d))


@query("a10_policy_table", f"SELECT skill AS policy, {_METRICS} GROUP BY skill")
def _policies(s, d):
    return arena.metrics(_moves(s, d).withColumnRenamed("skill", "policy").withColumn("skill", F.col("policy")), ["policy"])


@query("a07_usage_totals", "SELECT action_type AS stage, count(*) AS calls, sum(n_claims)::BIGINT AS tokens FROM moves GROUP BY ROLLUP (action_type)")
def _usage(s, d):
    return arena.usage_totals(view(s, d, "moves").select(F.col("action_type").alias("stage"), F.col("n_claims").cast("long").alias("tokens")))


@query("t05_citable", """
WITH ok AS (SELECT thread_id, skill, min(event_id) AS event_id FROM moves WHERE status = 'ok' GROUP BY thread_id, skill)
SELECT m.event_id, count(ok.skill) OVER (PARTITION BY m.thread_id ORDER BY m.event_id) AS n_citable FROM moves m LEFT JOIN ok ON ok.thread_id = m.thread_id AND ok.event_id = m.event_id""")
def _citable(s, d):
    return arena.citable_so_far(view(s, d, "moves"), "thread_id", ["event_id"], "skill").select("event_id", "n_citable")


@query("t09_threads", """
WITH f AS (SELECT issue_id, arg_min({'forum_id': forum_id, 'role': role, 'action': action, 'ref': grounding_ref}, (timestamp, pos)) AS f FROM acts WHERE issue_id IS NOT NULL GROUP BY issue_id)
SELECT issue_id, f.forum_id AS forum_id, coalesce(nullif(f.action, ''), f.ref) AS issue_text, 'medium' AS severity, 6 AS budget, 'Open' AS phase,
  CASE WHEN lower(f.role) LIKE 'review%' THEN coalesce(nullif(f.action, ''), f.ref) END AS request FROM f""")
def _threads(s, d):
    return grounding.threads(view(s, d, "acts"))


@query("t10_oracle_seeds", f"""
SELECT coalesce(issue_id, act_id) AS issue_id, arg_min(action, pos) AS issue_text, string_agg(intent || ':' || call.skill, '|' ORDER BY pos, intent, call.skill) AS oracle_moves FROM ({ROUTED}) GROUP BY 1""")
def _seeds(s, d):
    return grounding.oracle_seeds(view(s, d, "acts")).withColumn("oracle_moves", F.array_join(F.transform("oracle_moves", lambda m: F.concat(m["intent"], F.lit(":"), m["skill"])), "|"))


_POOL = "SELECT user_id AS issue_id, min(event_id) AS pos, CASE user_id % 4 WHEN 0 THEN 'Open' WHEN 1 THEN 'EvidencePending' WHEN 2 THEN 'Negotiation' ELSE 'Closed' END AS phase, CASE user_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'medium' END AS severity, cast(user_id % 7 AS int) AS budget FROM {events} GROUP BY user_id"


def _pool(s, d):
    return s.sql(_POOL, events=view(s, d, "events"))


@query("t_schedule", f"""
SELECT issue_id, row_number() OVER (ORDER BY CASE phase WHEN 'Open' THEN 3 WHEN 'EvidencePending' THEN 2 ELSE 1 END DESC, CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, pos) AS rank
FROM ({_POOL.replace('{events}', 'events')}) WHERE phase <> 'Closed' AND budget > 0""")
def _schedule(s, d):
    return arena.scheduled(_pool(s, d)).select("issue_id", "rank")


@query("t08_fixed_rounds", f"""
SELECT issue_id, CASE WHEN severity = 'high' THEN 'Closed' ELSE 'Negotiation' END AS phase, CASE WHEN severity = 'high' THEN 1 ELSE 0 END AS observations, 1 AS requests, CASE WHEN severity = 'high' THEN 0 ELSE 1 END AS commitments
FROM ({_POOL.replace('{events}', 'events')})""")
def _fixed(s, d):
    return arena.fixed_rounds(_pool(s, d).select("issue_id", F.when(F.col("severity") == "high", "ok").otherwise("missing").alias("status")), "issue_id")


@query("j05_round_selection", f"SELECT issue_id FROM ({_POOL.replace('{events}', 'events')}) WHERE phase <> 'Closed' AND budget > 0 AND severity = 'high' ORDER BY pos LIMIT 10")
def _round(s, d):
    pool = _pool(s, d)
    active = pool.filter("phase <> 'Closed' and budget > 0")
    return arena.selected(active, pool.filter("severity = 'high'"), 10).select("issue_id")


@query("t06_stub_run", "SELECT DISTINCT issue_id, 'Closed' AS phase, 0 AS budget, 0 AS observations, 6 AS requests, 0 AS commitments, 'Reviewer' AS last_role, 6 AS moves FROM acts WHERE issue_id IS NOT NULL")
def _stub(s, d):
    return arena.stub_run(grounding.threads(view(s, d, "acts")))


@query("j13_gold_by_ordinal", """
WITH a AS (SELECT thread_id, intent, row_number() OVER (PARTITION BY thread_id ORDER BY event_id) AS n FROM moves), g AS (SELECT thread_id, gold_intent, row_number() OVER (PARTITION BY thread_id ORDER BY event_id) AS n FROM moves WHERE gold_intent IS NOT NULL)
SELECT a.thread_id, count(g.n) AS n_gold, count(*) FILTER (WHERE a.intent = g.gold_intent) AS n_right FROM a LEFT JOIN g ON a.thread_id = g.thread_id AND a.n = g.n GROUP BY a.thread_id""")
def _ordinal(s, d):
    w = Window.partitionBy("thread_id").orderBy("event_id")
    m = view(s, d, "moves").select("thread_id", "event_id", "intent", "gold_intent")
    a = m.select("thread_id", "intent", F.row_number().over(w).alias("n"))
    g = m.filter("gold_intent is not null").select("thread_id", "gold_intent", F.row_number().over(w).alias("n"))
    return a.join(g, ["thread_id", "n"], "left").groupBy("thread_id").agg(F.count("gold_intent").alias("n_gold"), F.count_if(F.col("intent") == F.col("gold_intent")).alias("n_right"))


@query("t_windowed_status", """
SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) FILTER (WHERE status = 'ok') AS n_ok, count(*) FILTER (WHERE status = 'missing') AS n_missing, count(*) FILTER (WHERE status = 'fail') AS n_fail FROM moves GROUP BY 1""")
def _windowed(s, d):
    return windowed_status(view(s, d, "moves"), length="1 day").drop("end")


_START = "SELECT user_id AS issue_id, min(event_id) AS pos, CASE WHEN user_id % 3 = 0 THEN 'ok' ELSE 'missing' END AS status FROM {events} GROUP BY user_id"
_RUN = """
RECURSIVE f AS (
  SELECT issue_id, pos, status, -1 AS round, 'Negotiation' AS phase, 6 AS budget, NULL::VARCHAR AS role, NULL::VARCHAR AS action_type, 0 AS n_claims FROM (@start)
  UNION ALL
  SELECT issue_id, pos, status, round + 1, CASE WHEN budget <= 1 THEN 'Closed' WHEN r = 'Author' THEN 'Negotiation' WHEN status <> 'ok' THEN 'EvidencePending' ELSE phase END, budget - 1, r,
    CASE WHEN status = 'ok' THEN 'evidence_response' ELSE 'clarification' END, (status = 'ok')::INT
  FROM (SELECT *, CASE WHEN phase = 'Negotiation' AND coalesce(role, '') <> 'Author' THEN 'Author' ELSE 'Reviewer' END AS r FROM f WHERE phase <> 'Closed' AND round < 5))
""".replace("@start", _START.replace("{events}", "events")).strip()


@query("t06_round_run", f"WITH {_RUN} SELECT issue_id, status, round, role, action_type, n_claims, n_claims AS n_cited, phase, budget FROM f WHERE round >= 0")
def _rounds(s, d):
    return arena.run_rounds(s.sql(_START, events=view(s, d, "events")), phase="Negotiation")


@query("t06_limited_rounds", f"WITH {_RUN} SELECT issue_id, status, round, role, action_type, n_claims, n_claims AS n_cited, phase, budget FROM f WHERE round >= 0 AND issue_id IN (SELECT issue_id FROM f WHERE round = -1 ORDER BY pos, issue_id LIMIT 20)")
def _limited(s, d):
    return arena.run_rounds(s.sql(_START, events=view(s, d, "events")), per_round=20, phase="Negotiation")


_DEMO = "SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN 'Author' ELSE 'Reviewer' END AS role, CASE event_type WHEN 'signup' THEN 'RequestEvidence' WHEN 'error' THEN 'CloseIssue' ELSE 'Respond' END AS intent, CASE WHEN event_id % 2 = 0 THEN 'ok' ELSE 'missing' END AS status FROM {events}"


@query("t07_demo_ledger", f"""
SELECT user_id, coalesce(arg_max(CASE WHEN role = 'Author' THEN 'Negotiation' WHEN intent = 'CloseIssue' THEN 'Closed' ELSE 'EvidencePending' END, event_id) FILTER (WHERE role = 'Author' OR intent = 'RequestEvidence' OR (intent = 'CloseIssue' AND status = 'ok')), 'Open') AS phase,
  count(*) FILTER (WHERE role = 'Author' AND status = 'ok')::INTEGER AS observations, count(*) FILTER (WHERE role = 'Reviewer' AND intent = 'RequestEvidence')::INTEGER AS requests, count(*) FILTER (WHERE role = 'Author' AND status <> 'ok')::INTEGER AS commitments
FROM ({_DEMO.replace('{events}', 'events')}) GROUP BY user_id""")
def _demo_ledger(s, d):
    return arena.demo_ledger(s.sql(_DEMO, events=view(s, d, "events")), "user_id", ["event_id"])


@query("p24_demo_needs", f"""
SELECT event_id, CASE WHEN intent = 'RequestEvidence' THEN CASE event_id % 3 WHEN 1 THEN 'metric_definition' WHEN 2 THEN 'figure_evidence' ELSE 'general_evidence' END END AS type FROM ({_DEMO.replace('{events}', 'events')})""")
def _needs(s, d):
    rows = s.sql(_DEMO, events=view(s, d, "events"))
    return rows.select("event_id", arena.demo_need(F.col("intent"), F.concat(F.lit("T"), F.col("event_id") % 3))["type"].alias("type"))
