"""Thread ledgers over a stream of moves, by a stateful operator keyed on the thread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.arena import BUDGET

STATE = "phase string, budget int, observations int, requests int, commitments int, last_role string, moves int"


def step(state: tuple, role, status, action_type, n_requests, n_commitments) -> tuple:
    """One transition on a plain tuple, equal to the batch fold's expression."""
    phase, budget, observations, requests, commitments, last_role, moves = state
    if phase == "Closed":
        return state
    ok = status == "ok"
    if role == "Reviewer" and action_type in ("request", "clarification"):
        phase = "EvidencePending"
    elif role == "Author":
        phase = "Negotiation"
    requests = 0 if role == "Author" and ok else requests + n_requests
    if action_type == "close" or budget <= 1:
        phase = "Closed"
    return phase, max(budget - 1, 0), observations + ok, requests, commitments + n_commitments, role, moves + 1


def ledgers(moves: DataFrame, key: str = "thread_id", order: list[str] | None = None, budget: int = BUDGET) -> DataFrame:
    """Thread states after each micro-batch (update mode). Moves of one batch are taken in ``order``."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    order = order or ["event_id"]
    names = ["role", "status", "action_type", "n_requests", "n_commitments"]

    def update(k, frames, state):
        now = state.get if state.exists else ("Open", budget, 0, 0, 0, None, 0)
        rows = pd.concat(list(frames)).sort_values(order)
        for move in rows[names].itertuples(index=False):
            now = step(now, *move)
        now = tuple(int(x) if hasattr(x, "item") else x for x in now)
        state.update(now)
        yield pd.DataFrame([[*k, *now]], columns=[key, *[c.split()[0] for c in STATE.split(", ")]])

    kind = moves.schema[key].dataType.simpleString()
    return moves.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, {STATE}", STATE, "update", GroupStateTimeout.NoTimeout)


def windowed_status(moves: DataFrame, ts: str = "ts", length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Statuses in tumbling windows with a watermark; works on a stream and on a table."""
    each = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("ok", "missing", "fail")]
    return moves.withWatermark(ts, late).groupBy(F.window(ts, length)).agg(*each).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n_ok", "n_missing", "n_fail")


LISTS = ("observations", "requests", "commitments")
SUMMARY = "phase string, budget int, observations array<string>, requests array<string>, commitments array<string>, last_role string, moves int"


def summaries(moves: DataFrame, key: str = "thread_id", order: list[str] | None = None, budget: int = BUDGET) -> DataFrame:
    """The summaries of :func:`..plans.arena.summaries` over a stream (update mode).

    A thread's state is one value (phase, budget, last role, moves) and three lists, each in the state store on its
    own, so that a move appends and reads back no list that it does not change. Needs the RocksDB state store.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    order = order or ["event_id"]
    kind = moves.schema[key].dataType.simpleString()

    class Ledger(StatefulProcessor):
        def init(self, handle) -> None:
            self.head = handle.getValueState("head", "phase string, budget int, last_role string, moves int")
            self.lists = {n: handle.getListState(n, "text string") for n in LISTS}

        def handleInputRows(self, k, rows, timers):
            import pandas as pd

            held = self.head.get()  # each call of the store is a message: a new thread has no lists to ask for
            phase, budget_left, last_role, count = held or ("Open", budget, None, 0)
            before = {n: [r[0] for r in self.lists[n].get()] if held else [] for n in LISTS}
            new: dict[str, list] = {n: [] for n in LISTS}
            cleared = False
            if phase != "Closed":
                moves = pd.concat(list(rows))
                for move in moves.sort_values(order).itertuples(index=False):
                    if phase == "Closed":
                        break
                    ok = move.status == "ok"
                    told = {n: [t for t in (getattr(move, n) if getattr(move, n) is not None else ()) if t] for n in LISTS[1:]}
                    if ok:
                        new["observations"].append(move.observation)
                    if ok and move.role == "Author":
                        cleared, new["requests"] = True, []
                    else:
                        new["requests"] += told["requests"]
                    new["commitments"] += told["commitments"]
                    phase, budget_left, _, _, _, last_role, count = step((phase, budget_left, 0, 0, 0, last_role, count), move.role, move.status, move.action_type, 0, 0)
                self.head.update((phase, int(budget_left), last_role, int(count)))
            if cleared and before["requests"]:
                self.lists["requests"].clear()
                before["requests"] = []
            for n in LISTS:
                if new[n]:
                    self.lists[n].appendList([(t,) for t in new[n]])
            told = {n: [before[n] + new[n]] for n in LISTS}
            yield pd.DataFrame({key: [k[0]], "phase": [phase], "budget": [int(budget_left)], **told, "last_role": [last_role], "moves": [int(count)]})

        def close(self) -> None:
            pass

    used = dict.fromkeys([key, *order, "role", "status", "action_type", "observation", *LISTS[1:]])  # each column of each move goes to Python
    return moves.select(*used).groupBy(key).transformWithStateInPandas(Ledger(), f"{key} {kind}, {SUMMARY}", "Update", "None")


def kept_by_batch(states: DataFrame, number: int, path: str) -> None:
    """Writes a micro-batch under its number; a batch that is tried again replaces what it wrote."""
    states.write.mode("overwrite").parquet(f"{path}/batch={number}")
