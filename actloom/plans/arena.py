"""Threads as a budgeted state machine: scheduling, transitions, citable ids and run metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .numbering import numbered

BUDGET = 6
STATE = "struct<phase:string,budget:int,observations:int,requests:int,commitments:int,last_role:string,moves:int>"


def next_role(phase, last_role) -> Column:
    return F.when((phase == "Negotiation") & (F.coalesce(last_role, F.lit("")) != "Author"), F.lit("Author")).otherwise(F.lit("Reviewer"))


def start_state(budget: int = BUDGET, phase: str = "Open", requests: int = 0) -> Column:
    values = (("phase", phase, "string"), ("budget", budget or BUDGET, "int"), ("observations", 0, "int"), ("requests", requests, "int"), ("commitments", 0, "int"), ("last_role", None, "string"), ("moves", 0, "int"))
    return F.struct(*[F.lit(v).cast(t).alias(n) for n, v, t in values])


def transition(state: Column, move: Column) -> Column:
    """The state after a move (role, status, action_type, n_requests, n_commitments); counts stand for lists.

    A closed thread takes no more moves.
    """
    ok = F.coalesce(move["status"] == "ok", F.lit(False))
    asks = (move["role"] == "Reviewer") & move["action_type"].isin("request", "clarification")
    author = move["role"] == "Author"
    phase = F.when(asks, F.lit("EvidencePending")).when(author, F.lit("Negotiation")).otherwise(state["phase"])
    closes = F.coalesce(move["action_type"] == "close", F.lit(False)) | (state["budget"] <= 1)
    asked = state["requests"] + move["n_requests"].cast("int")
    after = F.struct(
        F.when(closes, F.lit("Closed")).otherwise(phase).alias("phase"),
        F.greatest(state["budget"] - 1, F.lit(0)).alias("budget"),
        (state["observations"] + ok.cast("int")).alias("observations"),
        F.when(author & ok, F.lit(0)).otherwise(asked).alias("requests"),
        (state["commitments"] + move["n_commitments"].cast("int")).alias("commitments"),
        move["role"].alias("last_role"),
        (state["moves"] + 1).alias("moves"),
    )
    return F.when(state["phase"] == "Closed", state).otherwise(after)


def replay(moves: DataFrame, key: str, order: list[str], budget: int = BUDGET) -> DataFrame:
    """Final state of each thread: an ordered fold inside its row. A thread ends at its budget, so only its
    first ``budget`` moves are gathered; the rank filter prunes before the shuffle."""
    w = Window.partitionBy(key).orderBy(*order)
    kept = moves.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= (budget or BUDGET))
    row = F.struct(F.col("__n"), *[F.col(c) for c in ("role", "status", "action_type", "n_requests", "n_commitments")])
    folded = kept.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("m"))
    state = F.aggregate("m", start_state(budget).cast(STATE), lambda s, m: transition(s, m).cast(STATE))
    return folded.select(key, state.alias("s")).select(key, "s.*")


TEXT_STATE = "struct<phase:string,budget:int,observations:array<string>,requests:array<string>,commitments:array<string>,last_role:string,moves:int>"


def text_transition(state: Column, move: Column) -> Column:
    """As :func:`transition`, with the lists themselves: ids of observations, texts of requests and commitments.

    A move has role, status, action_type, observation, requests and commitments; blank texts are left out.
    """
    ok = F.coalesce(move["status"] == "ok", F.lit(False))
    asks = (move["role"] == "Reviewer") & move["action_type"].isin("request", "clarification")
    author = move["role"] == "Author"
    phase = F.when(asks, F.lit("EvidencePending")).when(author, F.lit("Negotiation")).otherwise(state["phase"])
    closes = F.coalesce(move["action_type"] == "close", F.lit(False)) | (state["budget"] <= 1)
    told = lambda name: F.filter(F.coalesce(move[name], F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != "")
    none = F.array().cast("array<string>")
    after = F.struct(
        F.when(closes, F.lit("Closed")).otherwise(phase).alias("phase"),
        F.greatest(state["budget"] - 1, F.lit(0)).alias("budget"),
        F.when(ok, F.concat(state["observations"], F.array(move["observation"]))).otherwise(state["observations"]).alias("observations"),
        F.when(author & ok, none).otherwise(F.concat(state["requests"], told("requests"))).alias("requests"),
        F.concat(state["commitments"], told("commitments")).alias("commitments"),
        move["role"].alias("last_role"),
        (state["moves"] + 1).alias("moves"),
    )
    return F.when(state["phase"] == "Closed", state).otherwise(after)


def summaries(moves: DataFrame, key: str, order: list[str], budget: int = BUDGET) -> DataFrame:
    """Each thread's summary after its moves: phase, budget, ids of observations, open requests and commitments as texts.

    A thread ends at its budget, so its first ``budget`` moves are gathered, as in :func:`replay`.
    """
    w = Window.partitionBy(key).orderBy(*order)
    kept = moves.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= (budget or BUDGET))
    row = F.struct(F.col("__n"), *[F.col(c) for c in ("role", "status", "action_type", "observation", "requests", "commitments")])
    none = F.array().cast("array<string>")
    start = F.struct(F.lit("Open").alias("phase"), F.lit(budget or BUDGET).alias("budget"), none.alias("observations"), none.alias("requests"), none.alias("commitments"), F.lit(None).cast("string").alias("last_role"), F.lit(0).alias("moves"))
    folded = kept.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("m"))
    state = F.aggregate("m", start.cast(TEXT_STATE), lambda s, m: text_transition(s, m).cast(TEXT_STATE))
    return folded.select(key, state.alias("s")).select(key, "s.*")


def _schedule_order(order: str) -> list[Column]:
    value = lambda c, names, low: F.coalesce(*[F.when(F.col(c) == n, F.lit(v)) for n, v in names.items()], F.lit(low))
    return [F.desc(value("phase", {"Open": 3, "EvidencePending": 2, "Negotiation": 1}, 0)), F.desc(value("severity", {"high": 3, "medium": 2, "low": 1}, 1)), F.col(order)]


def schedule(threads: DataFrame, order: str = "pos") -> DataFrame:
    """Open and funded threads by phase, then severity, then order."""
    return threads.filter((F.col("phase") != "Closed") & (F.col("budget") > 0)).orderBy(*_schedule_order(order))


def scheduled(threads: DataFrame, order: str = "pos") -> DataFrame:
    """The same threads with their place in the schedule as ``rank``, numbered over range partitions."""
    return numbered(threads.filter((F.col("phase") != "Closed") & (F.col("budget") > 0)), _schedule_order(order), "rank")


def selected(active: DataFrame, order: DataFrame, per_round: int, pos: str = "pos", honor_order: bool = False) -> DataFrame:
    """Threads for a round: those in ``order``, cut to ``per_round`` by their own order, or by its rank."""
    if honor_order:
        return active.join(order.select("issue_id", "rank"), "issue_id").orderBy("rank").limit(per_round)
    return active.join(order.select("issue_id"), "issue_id", "left_semi").orderBy(pos).limit(per_round)


def citable_so_far(moves: DataFrame, key: str, order: list[str], observation: str) -> DataFrame:
    """Number of distinct ids that each move may cite: ok ids of its thread so far, its own included."""
    ok = moves.filter("status = 'ok'").groupBy(key, observation).agg(F.min(F.struct(*order)).alias("__first"))
    firsts = ok.select(key, "__first", F.lit(1).alias("__new"))
    rows = moves.withColumn("__first", F.struct(*order)).join(firsts, [key, "__first"], "left")
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("n_citable", F.sum(F.coalesce("__new", F.lit(0))).over(w)).drop("__first", "__new")


def metrics(moves: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rates over moves (status, n_claims, n_cited, plan and gold plan), in one aggregation; 0 for no moves."""
    bad = F.coalesce(F.col("status") != "ok", F.lit(True))
    gold = F.col("gold_intent").isNotNull()
    right = gold & (F.col("intent") == F.col("gold_intent")) & (F.col("skill") == F.col("gold_skill"))
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    n = F.count(F.lit(1))
    return moves.groupBy(*(by or [])).agg(
        n.alias("total_moves"), rate(F.count_if(~bad), n).alias("ok_rate"), rate(F.count_if(bad), n).alias("missing_or_fail_rate"),
        rate(F.count_if(bad & (F.col("n_claims") > 0)), n).alias("halluc_missing_rate"), rate(F.sum("n_cited"), F.sum("n_claims")).alias("claim_support_proxy"),
        F.round(F.try_divide(F.count_if(right), F.count_if(gold)), 6).alias("plan_acc"),
    )


def close_rate(states: DataFrame, by: list[str] | None = None) -> DataFrame:
    closed = F.count_if((F.col("phase") == "Closed") & (F.col("requests") == 0))
    return states.groupBy(*(by or [])).agg(F.round(closed / F.count(F.lit(1)), 6).alias("close_rate"))


def usage_totals(calls: DataFrame) -> DataFrame:
    """Tokens by stage, and in total (stage null)."""
    return calls.rollup("stage").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"))


def stub_run(threads: DataFrame) -> DataFrame:
    """A run whose first skill lacks its term, so every observation is missing: final state and moves."""
    state = start_state()
    move = F.struct(F.lit("Reviewer").alias("role"), F.lit("missing").alias("status"), F.lit("clarification").alias("action_type"), F.lit(1).alias("n_requests"), F.lit(0).alias("n_commitments"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(BUDGET)), state.cast(STATE), lambda s, _: transition(s, move).cast(STATE))
    return threads.select("issue_id", end.alias("s")).select("issue_id", "s.*")


# --- whole runs ------------------------------------------------------------------------------------------

EVENT = "struct<round:int,role:string,action_type:string,n_claims:int,n_cited:int,phase:string,budget:int>"


def stub_action(status) -> tuple[Column, Column, Column]:
    """(action_type, n_claims, n_requests) of the stub policy after the gate: a cited claim with evidence, else a
    clarification with one request."""
    ok = F.coalesce(status == "ok", F.lit(False))
    return F.when(ok, F.lit("evidence_response")).otherwise(F.lit("clarification")), ok.cast("int"), (~ok).cast("int")


def _move(state: Column, status: Column) -> Column:
    action, _, requests = stub_action(status)
    return F.struct(next_role(state["phase"], state["last_role"]).alias("role"), status.alias("status"), action.alias("action_type"), requests.alias("n_requests"), F.lit(0).alias("n_commitments"))


def _play(state: Column, status: Column, number: Column) -> tuple[Column, Column]:
    """State and event after one move of the stub policy."""
    move = _move(state, status)
    after = transition(state, move).cast(STATE)
    claims = stub_action(status)[1]
    event = F.struct(number.cast("int").alias("round"), move["role"].alias("role"), move["action_type"].alias("action_type"), claims.alias("n_claims"), claims.alias("n_cited"), after["phase"].alias("phase"), after["budget"].alias("budget"))
    return after, event.cast(EVENT)


def run_rounds(threads: DataFrame, max_rounds: int = BUDGET, per_round: int | None = None, phase: str = "Open") -> DataFrame:
    """Events of a run: threads (issue_id, pos, status of their evidence) play by the stub policy.

    Without ``per_round`` every active thread moves in each round, so a run is a fold inside each thread's row.
    With it, each round's first active threads by ``pos`` move. Rounds are few; only the selected ids of a round meet the
    threads, and what a round leaves is written, so the next one reads it once. Gives issue_id, the event's fields
    and the thread's status.
    """
    rows = threads.select("issue_id", "pos", "status").withColumn("state", start_state(phase=phase).cast(STATE))
    if not per_round:
        start = F.struct(F.col("state").alias("s"), F.array().cast(f"array<{EVENT}>").alias("e"))

        def play(acc, i):
            after, event = _play(acc["s"], F.col("status"), i)
            return F.when(acc["s"]["phase"] == "Closed", acc).otherwise(F.struct(after.alias("s"), F.concat(acc["e"], F.array(event)).alias("e")))

        folded = rows.select("issue_id", "status", F.aggregate(F.sequence(F.lit(0), F.lit(max_rounds - 1)), start, play, lambda a: a["e"]).alias("e"))
        return folded.select("issue_id", "status", F.explode("e").alias("x")).select("issue_id", "status", "x.*")
    events = None
    for i in range(max_rounds):
        active = rows.filter((F.col("state.phase") != "Closed") & (F.col("state.budget") > 0))
        chosen = active.orderBy("pos", "issue_id").limit(per_round).select("issue_id", F.lit(True).alias("plays"))
        after, event = _play(F.col("state"), F.col("status"), F.lit(i))
        played = rows.join(chosen, "issue_id", "left").withColumn("event", F.when(F.col("plays"), event)).withColumn("state", F.when(F.col("plays"), after).otherwise(F.col("state"))).drop("plays")
        played = written(played, "round")
        now = played.filter("event is not null").select("issue_id", "status", "event.*")
        events = now if events is None else events.unionAll(now)
        rows = played.drop("event")
    return events


def demo_ledger(moves: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The demo's ledger: requests are numbered and never cleared, an author without evidence commits, and closing
    needs evidence. Rows (role, intent, status); gives phase and the three counts."""
    ok, author = F.coalesce(F.col("status") == "ok", F.lit(False)), F.col("role") == "Author"
    asks = (F.col("role") == "Reviewer") & (F.col("intent") == "RequestEvidence")
    closes = (F.col("role") == "Reviewer") & (F.col("intent") == "CloseIssue") & ok
    phase = F.when(closes, F.lit("Closed")).when(author, F.lit("Negotiation")).when(asks, F.lit("EvidencePending"))
    # no move reads the state: the phase is that of the last move that sets one, and counts add up
    last = F.max_by(phase, F.when(phase.isNotNull(), F.struct(*order)))
    count = lambda c: F.count_if(c).cast("int")
    return moves.groupBy(key).agg(F.coalesce(last, F.lit("Open")).alias("phase"), count(author & ok).alias("observations"), count(asks).alias("requests"), count(author & ~ok).alias("commitments"))


def fixed_rounds(threads: DataFrame, key: str) -> DataFrame:
    """The demo's run: each thread's three moves, a request, an answer and a close, by the ledger of :func:`demo_ledger`.

    Threads have the status of the evidence that their moves find.
    """
    moves = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(role).alias("role"), F.lit(intent).alias("intent")) for n, (role, intent) in enumerate((("Reviewer", "RequestEvidence"), ("Author", "ProvideEvidence"), ("Reviewer", "CloseIssue")))])
    return demo_ledger(threads.select(key, "status", F.explode(moves).alias("m")).select(key, "status", "m.*"), key, ["n"])


def demo_need(intent, issue) -> Column:
    """struct<type, query>: the evidence that a request of the demo needs; null for other intents."""
    need = lambda kind, query: F.struct(F.lit(kind).alias("type"), F.lit(query).alias("query"))
    found = F.when(issue == "T1", need("metric_definition", "Metric M definition")).when(issue == "T2", need("figure_evidence", "Figure 1 ablation")).otherwise(need("general_evidence", "General evidence request"))
    return F.when(intent == "RequestEvidence", found)
