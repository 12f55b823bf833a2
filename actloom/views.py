"""Review-style logical tables derived from the driver's tables, by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .sources.scratch import files

#: The hint deals lines by order, which serves the grouping by line and every later grouping by context, so
#: one shuffle does for both. DuckDB takes it for a comment.
#: (ctx, id, text): segments of paper-like prose, in which every extraction pattern is met and missed.
PAPERS = """
SELECT l_orderkey AS ctx, l_linenumber AS id,
  CASE (l_partkey + l_linenumber) % 12
    WHEN 0 THEN concat('Table ', n, ': accuracy = 0.', s, p, ' and F1 of ', p, '.5% on the test split')
    WHEN 1 THEN concat('We compare against Net', s, ' and BERT-base in the Baseline table')
    WHEN 2 THEN concat('Figure ', n, ' shows the ablation without variant ', s, ' [', n, ', ', p, ']')
    WHEN 3 THEN concat('Equation (', n, ') gives the loss; we define the margin as a bound; alpha denotes rate ', s)
    WHEN 4 THEN concat('Algorithm ', n, ': learning rate = 1e-', s, ', batch size ', p, ', epochs: ', n, ', dropout 0.', s, '.')
    WHEN 5 THEN concat('Trained on ', n, ' x A100 for ', p, ' hours with an optimizer and a schedule')
    WHEN 6 THEN concat('3.', n, ' Method: see Section ', s, '; training and validation split of dataset ', s)
    WHEN 7 THEN concat('Code: https://github.com/lab', s, '/repo', p, '. Data: http://data.org/', n, ').')
    WHEN 8 THEN concat('- item one ', s, chr(10), '* item two ', p, chr(10), n, '. third item', chr(10), 'tail')
    WHEN 9 THEN 'no ablation and no limitations are reported; no training here'
    WHEN 10 THEN concat('Limitations: future work on corpus ', s, '; weight decay 1e-4. momentum 0.9')
    ELSE concat('Interval [0.', s, ', 0.', p, '] and 1.5 ± 0.', n, '; Results and Experiments are significant')
  END AS text
FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, cast(l_linenumber AS string) AS n,
             cast(min(l_suppkey) % 10 AS string) AS s, cast(10 + min(l_partkey) % 20 AS string) AS p
      FROM (SELECT /*+ REPARTITION(l_orderkey) */ l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem) GROUP BY l_orderkey, l_linenumber)
"""

#: Acts with roles, references and calls of every kind; ``operation`` and ``target_type`` are the first call's.
ACTS = """
SELECT concat(cast(l_orderkey AS string), '#', lpad(cast(l_linenumber AS string), 4, '0')) AS act_id,
  cast(l_orderkey AS string) AS forum_id, l_linenumber AS act_index,
  CASE m % 9 WHEN 0 THEN 'reviewer' WHEN 1 THEN 'Area_Chair' WHEN 2 THEN 'author & Reviewer 2' WHEN 3 THEN 'meta-review; AC'
    WHEN 4 THEN 'Associate Editor' WHEN 5 THEN 'program chair' WHEN 6 THEN 'guest  speaker' WHEN 7 THEN '' ELSE 'Authors / rebuttal, authors' END AS role,
  CASE m % 13 WHEN 0 THEN 'Table 3' WHEN 1 THEN 'fig. 7a' WHEN 2 THEN 'Eq (2)' WHEN 3 THEN 'see Algorithm 4' WHEN 4 THEN 'Section 2'
    WHEN 5 THEN 'appendix B' WHEN 6 THEN 'N/A' WHEN 7 THEN 'not_required' WHEN 8 THEN 'None' WHEN 9 THEN 'establish the second claim'
    WHEN 10 THEN 'na table' WHEN 11 THEN 'the main claim' ELSE '' END AS grounding_ref,
  CASE m % 5 WHEN 0 THEN '' WHEN 1 THEN 'n/a' ELSE concat('check claim ', cast(l_linenumber AS string)) END AS action,
  CASE m % 4 WHEN 0 THEN '' WHEN 1 THEN 'Request_Evidence' WHEN 2 THEN 'Clarify' ELSE 'none' END AS intent,
  CASE m % 3 WHEN 0 THEN 'thinks about it' ELSE '' END AS cognitive_chain,
  CASE m % 7 WHEN 0 THEN 'table' WHEN 1 THEN 'figure' ELSE '' END AS target_type,
  CASE m % 6 WHEN 0 THEN 'lookup' WHEN 1 THEN 'N/A' ELSE '' END AS operation,
  CASE WHEN m % 8 = 0 THEN NULL ELSE concat('issue_', cast(l_suppkey % 50 AS string)) END AS issue_id,
  concat('turn', cast(l_linenumber % 3 AS string), '_', cast(l_partkey % 4 AS string)) AS seg_id,
  CASE m % 10 WHEN 0 THEN 0.0 WHEN 1 THEN 1500000000000.0 ELSE 1400000000.0 + 40000000.0 * (l_orderkey % 9) END AS timestamp,
  l_orderkey * 10 + l_linenumber AS pos
FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_partkey) + min(l_suppkey) + l_linenumber AS m
      FROM lineitem GROUP BY l_orderkey, l_linenumber)
"""

#: Moves of threads: a thread is a user, a move an event.
MOVES = """
SELECT concat('f', cast(user_id % 20 AS string), '#', cast(user_id AS string)) AS thread_id, user_id, event_id, ts,
  CASE event_type WHEN 'purchase' THEN 'ok' WHEN 'error' THEN 'fail' ELSE 'missing' END AS status,
  CASE event_type WHEN 'signup' THEN 'request' WHEN 'view' THEN 'clarification' WHEN 'error' THEN 'close' ELSE 'evidence_response' END AS action_type,
  CASE WHEN event_id % 3 = 0 THEN 'Author' ELSE 'Reviewer' END AS role,
  cast(event_id % 4 AS int) AS n_claims, cast(event_id % 3 AS int) AS n_cited,
  CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS n_requests,
  CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS n_commitments,
  concat('I', cast(event_id % 3 AS string)) AS intent, concat('S', cast(event_id % 5 AS string)) AS skill,
  CASE WHEN event_id % 2 = 0 THEN concat('I', cast(event_id % 2 AS string)) END AS gold_intent,
  CASE WHEN event_id % 2 = 0 THEN concat('S', cast(event_id % 4 AS string)) END AS gold_skill
FROM events
"""

#: Dialogue turns of the conversations as acts.
TURNS = """
SELECT concat(cast(conv_id AS string), '#', lpad(cast(turn AS string), 4, '0')) AS act_id, cast(conv_id AS string) AS forum_id, conv_id,
  turn AS act_index, CASE role WHEN 'user' THEN 'Reviewer' WHEN 'assistant' THEN 'Author' ELSE 'Meta' END AS role, text AS action
FROM conversations
"""

#: Year and score change of a forum.
META = """
SELECT cast(o_custkey AS string) AS forum_id, min(year(o_orderdate)) AS year, max(o_orderkey % 4) AS score_change
FROM orders GROUP BY o_custkey
"""

#: Replies of a labelling policy, one a document: JSON bare, fenced, broken, unclosed or among the document's own words.
REPLIES = """
SELECT doc_id, CASE doc_id % 14
    WHEN 0 THEN concat('```json', chr(10), obj, chr(10), '```')
    WHEN 1 THEN concat('Here it is:', chr(10), '```', chr(10), arr, chr(10), '``` and ', text)
    WHEN 2 THEN obj
    WHEN 3 THEN concat('  ', arr, chr(10))
    WHEN 4 THEN concat(text, ' ', obj, ' ', text)
    WHEN 5 THEN concat(text, ' ', arr, ' tail')
    WHEN 6 THEN concat('{not json} ', obj)
    WHEN 7 THEN concat(arr, ' and [1, 2')
    WHEN 8 THEN concat('```json ', left(obj, length(obj) - 1), ' ``` ', arr)
    WHEN 9 THEN left(obj, 30)
    WHEN 10 THEN concat('say "[" then ', obj)
    WHEN 11 THEN concat('```', chr(10), '```json ', obj, ' ``````')
    WHEN 12 THEN text
  END AS reply
FROM (SELECT doc_id, text, obj, concat('[1, "{", {"other": []}, ', obj, ', {"label": "later"}]') AS arr
  FROM (SELECT doc_id, text,
      concat('{"action": "', CASE WHEN doc_id % 3 = 0 THEN 'reuse' ELSE 'new' END, '", "label": "', lang, ' ', cast(doc_id % 7 AS string), '", "note": "',
        replace(replace(replace(text, chr(92), concat(chr(92), chr(92))), '"', concat(chr(92), '"')), chr(10), concat(chr(92), 'n')),
        '", "nested": {"a": [1, {"b": "]}"}, []]}}') AS obj
    FROM (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents)))
"""

#: Bytes of a table's files for a shuffle partition of its views, so that a task's memory does not grow with the table.
PART_BYTES = 4 << 20


def parts(spark: SparkSession, sf_dir: str, table: str, size: int = PART_BYTES) -> int:
    """Shuffle partitions for a table: one a ``size`` bytes of its files, no fewer than there are cores or partitions set."""
    fs, path = files(spark, f"{sf_dir}/{table}.parquet")
    few = min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(few, fs.getContentSummary(path).getLength() // size)


VIEWS = {"replies": REPLIES, "papers": PAPERS, "acts": ACTS, "moves": MOVES, "turns": TURNS, "meta": META}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A logical view, or a driver's table, as a DataFrame; nothing is registered in the catalog."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text, bound = VIEWS[name].replace("{", "{{").replace("}", "}}"), {}
    for t in TABLES:
        if f"FROM {t}" in text:
            text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
            bound[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
    if "lineitem" in bound:  # the hint is given a number, which is not coalesced; without a hint the lines are dealt here
        n, hint = parts(spark, sf_dir, "lineitem"), "REPARTITION(l_orderkey)"
        if hint in text:
            text = text.replace(hint, f"REPARTITION({n}, l_orderkey)")
        else:
            bound["lineitem"] = bound["lineitem"].repartition(n, "l_orderkey")
    return spark.sql(text, **bound)


def with_views(sql: str) -> str:
    """DuckDB SQL with the views it names put before it as common table expressions."""
    used = [f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in sql]
    body, recursive = sql.strip(), ""
    if body.upper().startswith("WITH RECURSIVE "):
        body, recursive = "WITH " + body[15:], "RECURSIVE "
    if not used:
        return sql.strip()
    return "WITH " + recursive + ", ".join(used) + (", " + body[5:] if body.upper().startswith("WITH ") else " " + body)
