"""Which texts hold which queries, for a whole table of queries: Aho-Corasick automata over shards of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_BYTES = 16 << 20  # of queries in one automaton, with 64 bytes more for each


def _search(shared):
    """Rows of keys and a text to rows of keys and a query, each once."""

    def run(batches):
        import ahocorasick
        import pyarrow as pa

        automaton = ahocorasick.Automaton()
        for q in shared.value:
            automaton.add_word(q, q)
        if shared.value:
            automaton.make_automaton()
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if text and shared.value:
                    held = {q for _, q in automaton.iter(text)}
                    at += [i] * len(held)
                    found += held
            keys = batch.select(list(range(batch.num_columns - 1))).take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(found, pa.string())], names=[*keys.schema.names, "query"])

    return run


def contained(texts: DataFrame, queries: DataFrame, keys: list[str], text: str = "text", query: str = "query", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(keys, query): each row of ``texts`` with every distinct query that its text contains, letter case aside.

    One pass over a text finds all queries of a shard, so the cost follows the texts and the matches, not texts times queries.
    Queries are dealt by hash into as many shards as their size needs; a shard is broadcast, whatever the table's
    size, and the texts are read once a shard. Null and empty queries match nothing, null texts hold nothing. Queries
    come back in lower case.
    """
    spark = texts.sparkSession
    asked = queries.select(F.lower(F.col(query)).alias("query")).filter("query <> ''").distinct()
    size = asked.agg(F.coalesce(F.sum(F.octet_length("query") + 64), F.lit(0))).first()[0]
    shards = max(1, -(-size // shard_bytes))
    src = texts.select(*keys, F.lower(F.col(text)).alias("__text"))
    types = dict(src.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "query string"])
    found = None
    for i in range(shards):
        held = [r.query for r in asked.filter(F.pmod(F.xxhash64("query"), F.lit(shards)) == i).toLocalIterator()]
        part = src.mapInArrow(_search(spark.sparkContext.broadcast(held)), schema)
        found = part if found is None else found.unionAll(part)
    return found


def claims_supported(texts: DataFrame, claims: DataFrame, keys: list[str], claim: str = "claim", text: str = "text", query: str = "query") -> DataFrame:
    """(keys, claim, matched): for each text and claim of which it holds a query, these queries in order.

    ``claims`` has a row a claim and query. What has no row here is unsupported.
    """
    hits = contained(texts, claims, keys, text, query)
    named = claims.select(F.col(claim).alias("claim"), F.lower(F.col(query)).alias("query")).distinct()
    return hits.join(named, "query").groupBy(*keys, "claim").agg(F.array_sort(F.collect_list("query")).alias("matched"))
