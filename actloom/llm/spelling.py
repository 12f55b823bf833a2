"""Spelling variants: words one edit apart, found by Levenshtein automata run over compact trie shards.

Words are counted in tasks before they are shuffled. The vocabulary is range-partitioned and sorted; each partition cuts
its words into shards of SHARD_WORDS words and SHARD_CHARS code points at most and writes each as a compact trie:
nodes in level order, so that a node's children are one slice of a string of edge labels, and a subtree of
one word is that word. Shards are broadcast in rounds of ROUND_BYTES at most, whatever the vocabulary's size. A
task intersects the distance-one automaton of each of its words with every shard of the round, depth first:
along the word's own path it tries each edit once, behind which only the rest of the word is accepted. Accepting neighbours
are counted in the task, the best form with them, and reduced over rounds. Forms lead from word to word; ends of such
chains are found by pointer doubling.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import text_bytes
from .common import PIECE, drop_table, load, small_batches, table

MIN_CHARS = 7
MIN_COUNT = 2
RATIO = 10  # a form is so many times as frequent as the word
DROP_EVERY = 31  # the query deletes a code point from one in so many (document, run) pairs
SHARD_WORDS = 500_000
SHARD_CHARS = 8_000_000
ROUND_BYTES = 48 << 20
TASK_WORDS = 20_000  # words that a task of a round intersects
COUNTED = 300_000  # words counted in a task before they are sent on
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_RUN = re.compile("[a-zÀ-ÿ]+")
_GAP = re.compile("[^a-zÀ-ÿ]")


def runs_of(body: bytes):
    """Lists of the lower-cased letter runs of a text, of about PIECE bytes each."""
    text = body.translate(_LOWER).decode()
    begin = 0
    while begin < len(text):
        gap = _GAP.search(text, begin + PIECE) if len(text) > begin + PIECE else None
        stop = gap.start() if gap else len(text)
        yield _RUN.findall(text, begin, stop)
        begin = stop


def _counts(min_chars: int, drop_every: int | None):
    def run(batches):
        import pyarrow as pa

        held: dict[str, int] = {}

        def out():
            made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return made

        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                prefix = zlib.crc32(f"{doc}:".encode())
                for runs in runs_of(body):
                    for word in runs:
                        if len(word) < min_chars:
                            continue
                        if drop_every and not (h := zlib.crc32(word.encode(), prefix)) % drop_every:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < min_chars:
                                continue
                        held[word] = held.get(word, 0) + 1
                    if len(held) >= COUNTED:
                        yield out()
        if held:
            yield out()

    return run


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, drop_every: int | None = None) -> DataFrame:
    """(word, n) of the letter runs of whole texts, A-Z lower-cased; null texts have none.

    With ``drop_every``, a run loses code point h % length where h, the crc32 of ``<id>:<run>``, is a multiple of it; a null
    id is the empty string there.
    """
    small_batches(docs.sparkSession)
    src = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), text_bytes(F.col(text_col)))
    some = src.mapInArrow(_counts(min_chars, drop_every), "word string, n long")
    return some.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


class Trie:
    """A shard: sorted words, and nodes in level order. Edge k leads to node k + 1."""

    __slots__ = ("counts", "ends", "first", "labels", "lone", "words")

    def __init__(self, words: list[str], counts):
        self.words, self.counts = words, counts

    @classmethod
    def built(cls, words: list[str], counts) -> Trie:
        trie = cls(words, counts)
        labels, first, ends, lone, queue = [], [0], [], [], [(0, len(words), 0)]
        for low, high, depth in queue:  # grows as it is read
            ends.append(-1)
            lone.append(-1)
            if high - low == 1:
                lone[-1] = low
            else:
                if low < high and len(words[low]) == depth:
                    ends[-1] = low
                    low += 1
                while low < high:
                    label, begin = words[low][depth], low
                    while low < high and words[low][depth] == label:
                        low += 1
                    labels.append(label)
                    queue.append((begin, low, depth + 1))
            first.append(len(labels))
        trie.labels, trie.first, trie.ends, trie.lone = "".join(labels), first, ends, lone
        return trie

    def to_bytes(self) -> bytes:
        """Letter runs hold no line break, so one joins the words."""
        parts = ["\n".join(self.words).encode(), self.labels.encode(), np.array(self.counts, np.int64).tobytes(), *(np.array(x, np.int32).tobytes() for x in (self.first, self.ends, self.lone))]
        return np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> Trie:
        from array import array

        stops = 48 + np.cumsum(np.frombuffer(data, np.int64, 6))
        words, labels, counts, *nodes = (data[b:e] for b, e in zip([48, *stops[:-1].tolist()], stops.tolist(), strict=True))
        trie = cls(words.decode().split("\n"), array("q", counts))
        trie.labels = labels.decode()
        trie.first, trie.ends, trie.lone = (array("i", x) for x in nodes)
        return trie

    def rest(self, word: str, i: int, node: int, depth: int) -> int:
        """The word of the subtree of ``node`` whose code points from ``depth`` on are word[i:], or -1."""
        labels, first, lone, n = self.labels, self.first, self.lone, len(word)
        while True:
            if (k := lone[node]) >= 0:
                x = self.words[k]
                return k if len(x) - depth == n - i and (i == n or x.endswith(word[i:])) else -1
            if i == n:
                return self.ends[node]
            at = labels.find(word[i], first[node], first[node + 1])
            if at < 0:
                return -1
            node, i, depth = at + 1, i + 1, depth + 1

    def near(self, word: str) -> list[int]:
        """Words at distance one, each once.

        An edit in a run of equal code points is tried where the run ends only: anywhere else it gives the same word.
        """
        labels, first, found, rest = self.labels, self.first, [], self.rest
        n, node, i = len(word), 0, 0
        while True:
            if (k := self.lone[node]) >= 0:
                if one_edit(word, self.words[k], i):
                    found.append(k)
                break
            here = word[i] if i < n else ""
            if i < n and (i + 1 == n or word[i + 1] != here) and (k := rest(word, i + 1, node, i)) >= 0:
                found.append(k)  # word[i] deleted
            own = -1
            for at in range(first[node], first[node + 1]):
                if labels[at] == here:
                    own = at
                    continue
                if (k := rest(word, i, at + 1, i + 1)) >= 0:
                    found.append(k)  # a code point inserted before word[i]
                if i < n and (k := rest(word, i + 1, at + 1, i + 1)) >= 0:
                    found.append(k)  # word[i] replaced
            if own < 0:
                break
            node, i = own + 1, i + 1
        return found


def one_edit(a: str, b: str, at: int = 0) -> bool:
    """Whether two different words are one edit apart, their first ``at`` code points being equal."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    high = min(len(a), len(b))
    step = 64
    while at < high and a[at : at + step] == b[at : at + step]:
        at, step = min(at + step, high), step * 2
    while step > 1:  # the first difference lies within the step
        step //= 2
        if a[at : at + step] == b[at : at + step]:
            at = min(at + step, high)
    return a[at + (len(a) >= len(b)) :] == b[at + (len(b) >= len(a)) :]


def _shards(batches):
    import pyarrow as pa

    words, counts, chars = [], [], 0

    def out():
        data = Trie.built(words, counts).to_bytes()
        return pa.RecordBatch.from_arrays([pa.array([words[0]], pa.string()), pa.array([len(data)], pa.int64()), pa.array([data], pa.binary())], names=["start", "size", "trie"])

    for batch in batches:
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if words and (len(words) >= SHARD_WORDS or chars + len(word) > SHARD_CHARS):
                yield out()
                words, counts, chars = [], [], 0
            words.append(word)
            counts.append(n)
            chars += len(word)
    if words:
        yield out()


def _intersect(shared):
    """Words in; those with neighbours in this round's shards out."""

    def run(batches):
        import pyarrow as pa

        tries = [Trie.from_bytes(x) for x in shared.value]
        for batch in batches:
            out = []
            for word in batch.column(0).to_pylist():
                near, best, form = 0, 0, None
                for trie in tries:
                    for k in trie.near(word):
                        near, n = near + 1, trie.counts[k]
                        if n > best or (n == best and trie.words[k] < form):
                            best, form = n, trie.words[k]
                if near:
                    out.append((word, near, best, form))
            types = (pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["word", "near", "best", "form"])

    return run


def rounds_of(sizes: list[tuple[str, int]], most: int = 0) -> list[list[str]]:
    """Shards (first word, bytes) in order, in rounds of ``most`` bytes; a larger one is a round alone."""
    rounds, held = [], most or ROUND_BYTES
    for start, size in sizes:
        if not rounds or held + size > (most or ROUND_BYTES):
            rounds.append([])
            held = 0
        rounds[-1].append(start)
        held += size
    return rounds


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best): how many words are one edit away, and the most frequent of them.

    ``vocabulary`` has (word, n), each word once. Ties go to the smallest word in the order of code points. Words
    without a neighbour have no row. The driver keeps a row a shard and one round's shards.
    """
    spark = vocabulary.sparkSession
    shards = table(vocabulary.select("word", "n").repartitionByRange("word").sortWithinPartitions("word").mapInArrow(_shards, "start string, size long, trie binary"), "tries", "uncompressed")
    tasks = max(1, -(-vocabulary.count() // TASK_WORDS))
    parts = []
    for starts in rounds_of([(r.start, r["size"]) for r in shards.select("start", "size").orderBy("start").toLocalIterator()]):
        held = shards.filter(F.col("start").isin(starts)).select("trie").collect()  # ROUND_BYTES at most
        shared = spark.sparkContext.broadcast([bytes(r.trie) for r in held])
        parts.append(table(vocabulary.select("word").repartition(tasks).mapInArrow(_intersect(shared), "word string, near long, best long, form string"), "near"))
        shared.destroy()
    drop_table(shards)
    if not parts:
        return vocabulary.limit(0).select("word", F.lit(0).cast("long").alias("n_near"), F.col("n").alias("best_n"), F.col("word").alias("best"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionAll(part)
    best = F.min(F.struct((-F.col("best")).alias("less"), "form"))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.form").alias("best"))


def chain_ends(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form): the last word of each chain, by pointer doubling. Chains have no cycle."""
    now = table(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        then = table(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = then.filter("moved").limit(1).count()
        drop_table(now)
        now = then.select("word", "root")
        if not moved:
            return now


def spelling_groups(words: DataFrame, ratio: float = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word of (word, n), each word being there once.

    A word's form is its most frequent neighbour, if ``ratio`` times as frequent, else null; its root is the last of
    its chain of forms, or itself. An empty table gives an empty result.
    """
    vocabulary = table(words.select("word", F.col("n").cast("long").alias("n")), "vocabulary")
    near = neighbours(vocabulary)
    formed = F.col("best_n") >= F.lit(ratio) * F.col("n")
    judged = vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n")
    )
    judged = table(judged, "judged")
    roots = chain_ends(judged.filter("form IS NOT NULL"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: float = RATIO, drop_every: int | None = None) -> DataFrame:
    """The words of whole texts with their spelling groups; columns as in :func:`spelling_groups`.

    Null and empty texts have no words; repeated rows count each time. A very long text is read in pieces, a very
    long run is one word. Extra columns are ignored, whatever their names; an empty table gives an empty result.
    """
    return spelling_groups(word_counts(docs, id_col, text_col, min_chars, min_count, drop_every), ratio)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(load(spark, sf_dir, "documents"), drop_every=DROP_EVERY)


SQL = {
    "op12_spelling_variants": r"""
WITH RECURSIVE table_of_crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)),
                          lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) r(i))),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run
  FROM documents),
counted AS (
  SELECT run, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS told, count(*) AS n
  FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hexed AS (SELECT run, n, hex(encode(told)) AS x FROM counted),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, 1 + length(x), 2),
             lambda i: (instr('0123456789ABCDEF', substr(x, i, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(x, i + 1, 1)) - 1)),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM hexed, table_of_crc),
spelt AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n
  FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (
  SELECT DISTINCT word, n, spot, substr(word, 1, spot - 1) || substr(word, spot + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, 1 + length(word))) AS spot FROM words)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.spot = b.spot AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, encode(near)) AS near, max(near_n) AS near_n
  FROM pairs GROUP BY word),
judged AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near,
         CASE WHEN b.near_n >= 10 * w.n THEN b.near END AS form, CASE WHEN b.near_n >= 10 * w.n THEN b.near_n END AS form_n
  FROM words w LEFT JOIN best b USING (word)),
chain AS (
  SELECT word, word AS root, 0 AS steps FROM judged
  UNION ALL
  SELECT c.word, j.form, c.steps + 1 FROM chain c JOIN judged j ON j.word = c.root WHERE j.form IS NOT NULL)
SELECT j.word, j.form, c.root, j.n, j.n_near, j.form_n
FROM judged j JOIN (SELECT word, arg_max(root, steps) AS root FROM chain GROUP BY word) c USING (word)
"""
}
