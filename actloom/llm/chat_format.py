"""Preference formatting with DataFrame and SQL functions only.

A pair is a chosen and a rejected conversation. Their longest common turn prefix is found and rendered once
as the prompt; what follows on either side is rendered as a completion, with the character spans of the
assistant's turns, on which alone a loss is taken. Turns meet by pair in one shuffle; a conversation is one
row when rendered, like any whole text, and everything after is an expression over that row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load

HEAD, TAIL = "<|{role}|>\n", "<|end|>\n"  # around each turn's text
TRAINED = "assistant"


def _head(role):
    before, after = HEAD.split("{role}")
    return F.concat(F.lit(before), role, F.lit(after))


def _rendered(turns):
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t["role"]), t["text"], F.lit(TAIL))), "")


def _spans(turns):
    """Start and end of each assistant text and its closing mark, counted in characters of the completion."""
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(s, t):
        start = s["at"] + F.length(_head(t["role"]))
        end = start + F.length(t["text"]) + F.length(F.lit(TAIL))
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(t["role"] == TRAINED, F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(turns, state, step, lambda s: s["spans"])


_TURNS = "array<struct<turn:bigint,role:string,text:string>>"


def _turn():
    return F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def gather_turns(turns: DataFrame) -> DataFrame:
    """Rows (pair_id, chosen boolean, turn, role, text) to one row a pair: pair_id, chosen_turns, rejected_turns.

    Null roles and texts count as empty strings. Turns are ordered by turn, then role, then text, so ties and
    repeated rows have one order. Rows without a pair_id or side are left out, as they belong to no pair.
    """
    side = lambda flag: F.array_sort(F.collect_list(F.when(F.col("chosen") == F.lit(flag), _turn())))
    return turns.filter("pair_id is not null and chosen is not null").groupBy("pair_id").agg(side(True).alias("chosen_turns"), side(False).alias("rejected_turns"))


def preference_format(pairs: DataFrame) -> DataFrame:
    """One row for each pair (pair_id, chosen_turns, rejected_turns) that has both sides.

    Gives pair_id, n_prompt_turns, prompt, chosen, rejected (strings), chosen_spans, rejected_spans (arrays of
    start, end). If one side is a prefix of the other its completion is empty; if no turn is shared the prompt
    is.
    """
    both = pairs.select("pair_id", F.col("chosen_turns").alias("a"), F.col("rejected_turns").alias("b")).filter((F.size("a") > 0) & (F.size("b") > 0))
    same = F.zip_with("a", "b", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    prefix = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size("a"))
    cut = both.withColumn("n", prefix.cast("int"))
    rest = lambda name: F.slice(name, F.col("n") + 1, F.size(name))
    return cut.select(
        "pair_id",
        F.col("n").alias("n_prompt_turns"),
        _rendered(F.slice("a", 1, F.col("n"))).alias("prompt"),
        _rendered(rest("a")).alias("chosen"),
        _rendered(rest("b")).alias("rejected"),
        _spans(rest("a")).alias("chosen_spans"),
        _spans(rest("b")).alias("rejected_spans"),
    )


def answer_pairs(conversations: DataFrame) -> DataFrame:
    """Preference pairs from plain conversations, in the form that :func:`preference_format` takes.

    Chosen is the conversation itself. Rejected is the same up to its last assistant turn, which is
    replaced by the last assistant turn of the neighbouring conversation (ids 2k and 2k + 1) and ends it.
    Conversations without an assistant turn, or whose neighbour has none, make no pair, nor do two equal answers, which
    prefer nothing. Both neighbours come together in one shuffle.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").filter("conv_id is not null")
    turn = F.struct(F.col("conv_id").bitwiseAND(1).alias("odd"), *[_turn()[k].alias(k) for k in ("turn", "role", "text")])
    met = rows.groupBy(F.shiftright("conv_id", 1).alias("k")).agg(F.array_sort(F.collect_list(turn)).alias("t"))
    for odd in (0, 1):
        met = met.withColumn(f"t{odd}", _of("t", odd).cast(_TURNS)).withColumn(f"last{odd}", F.array_max(F.filter(f"t{odd}", lambda x: x["role"] == TRAINED)))
    made = []
    for odd in (0, 1):
        own, last, answer = F.col(f"t{odd}"), F.col(f"last{odd}"), F.col(f"last{1 - odd}")
        swapped = F.struct(last["turn"].alias("turn"), F.lit(TRAINED).alias("role"), answer["text"].alias("text"))
        kept = _before(own, last["turn"])
        pair = F.struct((F.shiftleft("k", 1) + odd).alias("pair_id"), own.alias("chosen_turns"), F.concat(kept, F.array(swapped)).cast(_TURNS).alias("rejected_turns"))
        made.append(F.when(last.isNotNull() & answer.isNotNull() & (last["text"] != answer["text"]), pair))
    return met.select(F.explode(F.array_compact(F.array(*made))).alias("p")).select("p.*")


def _of(name: str, odd: int):
    return F.transform(F.filter(name, lambda x: x["odd"] == odd), lambda x: F.struct(x["turn"].alias("turn"), x["role"].alias("role"), x["text"].alias("text")))


def _before(turns, limit):
    return F.filter(turns, lambda x: x["turn"] < limit)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = preference_format(answer_pairs(load(spark, sf_dir, "conversations")))
    written = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return out.withColumns({"chosen_spans": written("chosen_spans"), "rejected_spans": written("rejected_spans")})


SQL = {
    "op6_chat_format": """
WITH t AS (SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
answers AS (
  SELECT conv_id, max(turn) AS last, arg_max(text, (turn, text)) AS answer FROM t WHERE role = 'assistant' GROUP BY conv_id),
known AS (SELECT a.conv_id, a.last, b.answer FROM answers a JOIN answers b ON b.conv_id = xor(a.conv_id, 1) WHERE coalesce(a.answer, '') <> coalesce(b.answer, '')),
turns AS (
  SELECT conv_id AS pair_id, true AS chosen, turn, role, text FROM t SEMI JOIN known USING (conv_id)
  UNION ALL SELECT t.conv_id, false, turn, role, text FROM t JOIN known USING (conv_id) WHERE turn < last
  UNION ALL SELECT conv_id, false, last, 'assistant', answer FROM known),
numbered AS (
  SELECT pair_id, chosen, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY pair_id, chosen ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS i FROM turns),
sizes AS (SELECT pair_id, count(*) FILTER (WHERE chosen) AS na, count(*) FILTER (WHERE NOT chosen) AS nb FROM numbered GROUP BY pair_id),
differ AS (
  SELECT a.pair_id, min(a.i) AS i FROM numbered a JOIN numbered b ON a.pair_id = b.pair_id AND a.i = b.i AND a.chosen AND NOT b.chosen
  WHERE a.role <> b.role OR a.text <> b.text GROUP BY a.pair_id),
cut AS (SELECT pair_id, coalesce(differ.i - 1, least(na, nb)) AS n FROM sizes LEFT JOIN differ USING (pair_id) WHERE na > 0 AND nb > 0),
r AS (
  SELECT pair_id, chosen, role, i, n, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS line,
         length('<|' || role || '|>') + 1 AS head
  FROM numbered JOIN cut USING (pair_id)),
s AS (
  SELECT *, coalesce(sum(length(line)) OVER (PARTITION BY pair_id, chosen, i > n ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM r)
SELECT pair_id, n::INTEGER AS n_prompt_turns,
       coalesce(string_agg(line, '' ORDER BY i) FILTER (WHERE chosen AND i <= n), '') AS prompt,
       coalesce(string_agg(line, '' ORDER BY i) FILTER (WHERE chosen AND i > n), '') AS chosen,
       coalesce(string_agg(line, '' ORDER BY i) FILTER (WHERE NOT chosen AND i > n), '') AS rejected,
       coalesce(string_agg((pos + head) || '-' || (pos + length(line)), ',' ORDER BY i) FILTER (WHERE chosen AND i > n AND role = 'assistant'), '') AS chosen_spans,
       coalesce(string_agg((pos + head) || '-' || (pos + length(line)), ',' ORDER BY i) FILTER (WHERE NOT chosen AND i > n AND role = 'assistant'), '') AS rejected_spans
FROM s GROUP BY pair_id, n
"""
}
