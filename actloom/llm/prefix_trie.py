"""The trie of conversation prefixes: globally sorted turn arrays, longest common prefixes, one stack sweep.

A conversation becomes one array: a 16-byte digest (of SHA-256) of role and text, and a word count, a turn. The arrays
are range-partitioned by (digests, conversation) and sorted, so equal prefixes lie together and a hot prefix spreads over
as many partitions as its rows need. Each partition is streamed once. Of the longest common prefixes of adjacent
arrays a stack holds one entry an interval: a run of nodes, each the only child of the one above, which have the same
members. A popped interval gives its nodes.

Intervals that hold a partition's first or last row may go on next door. Their sums so far, which leave out what else is
open, make up one summary a partition; a second sweep of the summaries in order stitches them. That sweep is one
streaming task over a row a partition, holding one path. Two things come late: the parent of a node whose parent
was open (or had more than HELD children), and the digest of members that end at a node in several partitions or more
than CHUNK times. Both are joined by node digest; ids are hashed in order from packed chunks.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, n_words, table

DIGEST = 16  # bytes of a turn
HELD = 10_000  # children of an interval that a task holds until their parent is known
CHUNK = 50_000  # members ending at a node that a task holds
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NODES, SUMMARY, CHUNKS = 0, 1, 2  # kinds of swept rows
COLUMNS = [x.split()[0] for x in NODE.split(", ")]
_SWEPT = f"{NODE}, node_id binary, parent_id binary, kind int, part int, seq long, payload binary"


def ordered_turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, pos, digest, words) of every turn, pos from 1; null turns first, ties by role and text.

    Null roles and texts are empty. Rows without a conversation's id belong to none.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    src = conversations.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")).filter("conv_id IS NOT NULL")
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    told = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    digest = F.substring(F.unhex(F.sha2(told, 256)), 1, DIGEST)
    return src.withColumn("pos", F.row_number().over(order)).select("conv_id", "pos", digest.alias("digest"), n_words(F.col("text")).cast("int").alias("words"))


def turn_arrays(turns: DataFrame) -> DataFrame:
    """(conv_id, key, words): a conversation's digests in one string of bytes, and its word counts.

    A null pos stands for a conversation without turns. One conversation is one row of 20 bytes a turn.
    """
    held = F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "digest", "words"))))
    key = F.unhex(F.array_join(F.transform("held", lambda t: F.hex(t["digest"])), ""))
    return turns.groupBy("conv_id").agg(held.alias("held")).select("conv_id", key.alias("key"), F.col("held.words").alias("words"))


class _Run:
    """An interval on the stack: nodes above ``depth`` down to the next entry, with equal members.

    Sums hold what is closed: members that end here, and children's whole subtrees.
    """

    __slots__ = ("children", "chunks", "depth", "ended", "first", "ids", "least", "leaves", "members", "pending", "saved", "wide")

    def __init__(self, depth: int, first: bool = False):
        self.depth, self.first = depth, first  # first: a partition's first row is a member
        self.members = self.leaves = self.saved = self.children = self.ended = self.chunks = 0
        self.least, self.ids, self.pending, self.wide = None, [], [], False

    def sums(self):
        return self.depth, self.members, self.least, self.leaves, self.saved, self.children, self.ended

    def add(self, members, least, leaves, saved, children, ended=0):
        self.members += members
        self.leaves += leaves
        self.saved += saved
        self.children += children
        self.ended += ended
        if least is not None and (self.least is None or least < self.least):
            self.least = least


def shared_turns(a: bytes, b: bytes) -> int:
    """Turns that two arrays have in common at their start."""
    high = min(len(a), len(b)) // DIGEST
    if a[: high * DIGEST] == b[: high * DIGEST]:
        return high
    low = 0
    while high - low > 1:
        mid = (low + high) // 2
        if a[low * DIGEST : mid * DIGEST] == b[low * DIGEST : mid * DIGEST]:
            low = mid
        else:
            high = mid
    return low


def node_id(key: bytes, depth: int) -> bytes:
    return hashlib.blake2b(memoryview(key)[: depth * DIGEST], digest_size=16, salt=b"node").digest()


class _Sweep:
    """The stack and what it gives: nodes as tuples in the order of ``_SWEPT``."""

    def __init__(self, root: int, part: int, stitching: bool):
        self.root, self.part, self.stitching = root, part, stitching
        self.stack, self.first_row = [_Run(0, not stitching)], True
        self.key, self.words, self.out, self.left = b"", np.zeros(0, np.int32), [], []

    def close(self, depth: int):
        """Pops what is deeper than ``depth``, of which the path keeps a node there."""
        while self.stack[-1].depth > depth:
            run = self.stack.pop()
            if self.stack[-1].depth < depth:
                self.stack.append(_Run(depth, run.first))
            self._finish(run, self.stack[-1])

    def _chunk(self, run: _Run):
        ids = ",".join(map(str, run.ids)).encode()
        self.out.append((*[None] * 8, node_id(self.key, run.depth), None, CHUNKS, self.part, run.chunks, ids))
        run.chunks, run.ids = run.chunks + 1, []

    def end(self, conv: int):
        """A member of the whole path ends at its lowest node."""
        run = self.stack[-1]
        run.add(1, conv, 0, 0, 0, 1)
        run.ids.append(conv)
        if len(run.ids) >= CHUNK:
            self._chunk(run)

    def _flush(self, run: _Run):
        if run.pending:
            parent = node_id(self.key, run.depth)
            self.out += [(*row[:9], parent, *row[10:]) for row in run.pending]
            run.pending, run.wide = [], True

    def set_aside(self, run: _Run):
        """The sums so far of an interval whose members are not all known; it gives no node."""
        if run.ids:
            self._chunk(run)
        self._flush(run)
        return run.sums()

    def _finish(self, run: _Run, up: _Run | None):
        if run.first:
            self.left.append(self.set_aside(run))
            return
        n, saved, leaves = run.members, run.saved, run.leaves or 1
        above = up.depth if up else -1
        late = self.stitching or run.chunks
        if run.chunks and run.ids:
            self._chunk(run)
        ends = (None if late else hashlib.sha256(",".join(map(str, run.ids)).encode()).hexdigest()) if run.ended else EMPTY
        named = node_id(self.key, run.depth) if late or run.wide else None
        children, parent = run.children, None
        for depth in range(run.depth, above, -1):
            saved += (n - 1) * int(self.words[depth - 1]) if depth else 0
            top = depth == above + 1
            parent = None if depth == 0 else run.least if not top else self.root if above == 0 else None
            row = (run.least, depth, parent, n, children, leaves, saved, ends, named, None, NODES, self.part, None, None)
            if top and above > 0:
                up.pending.append(row)
                if len(up.pending) > HELD:
                    self._flush(up)
            else:
                self.out.append(row)
            children, ends, named = 1, EMPTY, None
        self.out += [(*row[:2], run.least, *row[3:]) for row in run.pending]
        if up:
            up.add(n, run.least, leaves, saved, 1)

    def row(self, key: bytes, words, conv: int):
        """The next array in order."""
        self.close(shared_turns(self.key, key))
        depth = len(key) // DIGEST
        if self.stack[-1].depth < depth:
            self.stack.append(_Run(depth, self.first_row))
        self.key, self.words, self.first_row = key, words, False
        self.end(conv)

    def put(self, key: bytes, words, runs):
        """The sums of a path's intervals, in the order of depth, join those that are open."""
        self.close(shared_turns(self.key, key))
        self.key, self.words = key, words
        for depth, *sums in sorted(runs):
            at = next(i for i in range(len(self.stack), 0, -1) if self.stack[i - 1].depth <= depth)
            if self.stack[at - 1].depth < depth:
                self.stack.insert(at, _Run(depth))
                at += 1
            self.stack[at - 1].add(*sums)

    def taken(self):
        out, self.out = self.out, []
        return out


def _batch(rows):
    import pyarrow as pa

    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32()}
    names, types = zip(*(x.split() for x in _SWEPT.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, t in enumerate(types)], names=list(names))


def _sweep(root: int):
    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        sweep, first = _Sweep(root, part, False), None
        for batch in batches:
            values, offsets = batch.column(1).flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *(batch.column(1).value_lengths().to_pylist())])
            for i, (key, conv) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                words = values[offsets[i] : offsets[i + 1]]
                first = first or (key, words.tobytes())
                sweep.row(key, words, conv)
                if len(sweep.out) > 20_000:
                    yield _batch(sweep.taken())
        if first is None:
            return
        right = []
        for at in sweep.stack:
            (sweep.left if at.first else right).append(sweep.set_aside(at))
        told = pickle.dumps((*first, sweep.left, sweep.key, np.asarray(sweep.words, np.int32).tobytes(), right))
        sweep.out.append((*[None] * 10, SUMMARY, part, None, told))
        yield _batch(sweep.taken())

    return run


def _stitch(root: int):
    def run(batches):
        sweep = None
        for batch in batches:
            for told in batch.column(0).to_pylist():
                first, words, left, last, last_words, right = pickle.loads(told)
                sweep = sweep or _Sweep(root, 0, True)
                sweep.put(first, np.frombuffer(words, np.int32), left)
                sweep.put(last, np.frombuffer(last_words, np.int32), right)
                yield _batch(sweep.taken())
        if sweep:
            sweep.close(0)
            sweep._finish(sweep.stack.pop(), None)
            yield _batch(sweep.taken())

    return run


def _hash_chunks(batches):
    """Chunks in the order of node, partition and number to one digest a node."""
    import pyarrow as pa

    node, so_far = None, None
    for batch in batches:
        out = []
        for n, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if n == node:
                so_far.update(b",")
            else:
                if node is not None:
                    out.append((node, so_far.hexdigest()))
                node, so_far = n, hashlib.sha256()
            so_far.update(ids)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.binary(), pa.string()))], names=["node_id", "late_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([so_far.hexdigest()])], names=["node_id", "late_sha256"])


def prefix_trie(arrays: DataFrame) -> DataFrame:
    """One row per distinct prefix of the arrays (conv_id, key, words), conv_id being unique.

    conv_id is the smallest member; depth; parent_conv_id the parent's conv_id, null at the root; n_convs; n_children;
    n_leaves; saved_tokens; ends_sha256 of the ids of members that end here, ascending and comma-joined. An empty
    table has no node. Turns are equal if their 16-byte digests are.
    """
    arrays = table(arrays, "arrays")
    root = arrays.agg(F.min("conv_id")).first()[0]
    dealt = arrays.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").select("key", "words", "conv_id")
    swept = table(dealt.mapInArrow(_sweep(root), _SWEPT), "swept")
    told = swept.filter(F.col("kind") == SUMMARY).repartition(1).sortWithinPartitions("part").select("payload")  # a row a partition
    stitched = table(told.mapInArrow(_stitch(root), _SWEPT), "stitched")
    nodes = swept.filter(F.col("kind") == NODES).unionByName(stitched)
    hashed = swept.filter(F.col("kind") == CHUNKS).repartition("node_id").sortWithinPartitions("node_id", "part", "seq").select("node_id", "payload")
    ends = table(hashed.mapInArrow(_hash_chunks, "node_id binary, late_sha256 string"), "ends")
    # what comes late joins the few rows that lack it; a hot parent's children are many, their parents few
    plain = nodes.filter("parent_id IS NULL AND ends_sha256 IS NOT NULL").select(*COLUMNS)
    parents = nodes.filter("node_id IS NOT NULL").select(F.col("node_id").alias("parent_id"), F.col("conv_id").alias("late_parent"))
    orphans = nodes.filter("parent_id IS NOT NULL").join(parents, "parent_id").withColumn("parent_conv_id", F.col("late_parent"))
    known = orphans.filter("ends_sha256 IS NOT NULL").select(*COLUMNS)
    unhashed = orphans.select(*COLUMNS, "node_id").unionByName(nodes.filter("parent_id IS NULL").select(*COLUMNS, "node_id")).filter("ends_sha256 IS NULL")
    late = unhashed.join(ends, "node_id").withColumn("ends_sha256", F.col("late_sha256")).select(*COLUMNS)
    return plain.unionAll(known).unionAll(late)


def conversation_trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of all conversations as they are; columns as in :func:`prefix_trie`.

    Turns stand by turn, null first, ties by role and text, so repeated rows are repeated turns. Null roles and texts
    are empty; rows without a conversation's id are left out. Very long texts count by their digest and words, and
    extra columns are ignored, whatever their names. An empty table gives an empty result.
    """
    return prefix_trie(turn_arrays(ordered_turns(conversations, id_col, turn_col, role_col, text_col)))


def rebuilt(turns: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """Turns (conv_id, pos, digest, words) of conversations that borrow their start from their family's first one.

    The first h turns are those of conversation c - c % family, then come the own turns after the first h, h being
    crc32(c) % most. A conversation without turns left has one row of null pos.
    """
    turns = table(turns, "turns")
    convs = turns.groupBy("conv_id").agg(F.lit(None).cast("int").alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("int").alias("words"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    heads = turns.filter((F.col("conv_id") % family == 0) & (F.col("pos") < most)).select(F.col("conv_id").alias("base"), "pos", "digest", "words")
    asking = convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), h.alias("h")).filter("h > 0")
    borrowed = asking.join(heads, "base").filter("pos <= h").select("conv_id", "pos", "digest", "words")
    return convs.unionByName(borrowed).unionByName(turns.filter(F.col("pos") > h))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(turn_arrays(rebuilt(ordered_turns(load(spark, sf_dir, "conversations")))))


SQL = {
    "op13_prefix_trie": r"""
WITH table_of_crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)),
                          lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) r(i))),
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
         xor(list_reduce(list_prepend(4294967295, list_transform(range(1, 1 + length(conv_id::VARCHAR)), lambda i: ascii(substr(CAST(conv_id AS VARCHAR), i, 1)))),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM turns), table_of_crc),
made AS (
  SELECT c.conv_id, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL
  SELECT c.conv_id, t.pos, t.role, t.text FROM convs c JOIN turns t USING (conv_id) WHERE t.pos > c.h),
placed AS (
  SELECT conv_id, text, sha256(length(role) || ':' || role || text) AS one,
         row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth,
         count(*) OVER (PARTITION BY conv_id) AS len
  FROM made),
paths AS (
  SELECT conv_id, 0 AS depth, coalesce(max(len), 0) AS len, '' AS path, 0 AS words
  FROM convs LEFT JOIN placed USING (conv_id) GROUP BY conv_id
  UNION ALL
  SELECT conv_id, depth, len, string_agg(one, '') OVER (PARTITION BY conv_id ORDER BY depth),
         len(regexp_extract_all(text, '[^ 	-]+'))
  FROM placed),
nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len = depth), '')) AS ends_sha256
  FROM paths GROUP BY path, depth),
family AS (
  SELECT n.*, p.conv_id AS parent_conv_id,
         (SELECT count(*) FROM nodes k WHERE k.depth = n.depth + 1 AND k.path[:64 * n.depth] = n.path) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.path[:64 * (n.depth - 1)]),
below AS (
  SELECT path, depth, unnest(range(depth + 1)) AS top, n_children, (n_convs - 1) * words AS saved FROM family),
sums AS (
  SELECT path[:64 * top] AS path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM below GROUP BY 1)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM family JOIN sums USING (path)
"""
}
