"""Removal of repeated 50-byte strings by distributed prefix doubling over sampled positions.

A byte is removed if a 50-byte string covering it also starts in a document with a smaller id.

Doubling that sorts a (position, rank) row for every byte in every round shuffles more than ten times the
input. Positions are therefore sampled by content: of every 50-byte window the 20-byte gram of smallest hash is the
anchor, so equal windows have equal anchors and neighbouring windows mostly share one (one anchor in 17 bytes).
Spark then sorts narrow rows (rank pair, document, batch) round by round, and each round asks only for what the
rounds before left open:

round 1   rank of length 20: the anchor alone. An anchor found in one document only is unique and drops out with all
          its windows, as no equal window can exist elsewhere.
round 2   the rank pair (anchor, block), a block being the run of windows that share an anchor: its first window, its
          last window and their distance, 50 to 99 bytes. Rows are range-partitioned and sorted by the pair; the first
          row of a run names the smallest document, which settles all windows of the block in later documents.
round 3   past the threshold: for anchors that head several blocks, the pair (anchor, window) of length exactly 50,
          for the first document of each block.

Rows grow in proportion to the input: a batch gives one row for each distinct pair, so a string that a third of
all documents hold costs one row a batch, and runs are streamed in sort order with constant memory. The partitions of
round 2 are cut by pair, so an anchor with many contexts is spread; where a partition's edge cuts an anchor it counts
as heading several blocks, which costs a question and never a result. Texts are packed once into zstd batches,
bucketed in the shared folder, and never move again; all that a round needs is computed from them anew.

Two strings are taken as equal if the anchors' 64 bits and the pair's other 64 bits agree.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import BATCH_BYTES, column, each_batch, pack_batches, rows_of, text_bytes, with_replies
from .common import drop_table, load, small_batches, table

LENGTH = 50
GRAM = 20
WINDOWS = LENGTH - GRAM + 1  # grams in a window
RUN = LENGTH  # windows a block may hold, so that its first and last window cover it
CHUNK_BYTES = 1 << 16
ID_MAX = np.iinfo(np.int64).max

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S1, _S2 = np.uint64(29), np.uint64(32)


def _mix(a, b):
    x = a * _M1
    x ^= x >> _S1
    x += b
    x *= _M2
    x ^= x >> _S2
    return x


def _loads(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position, as little-endian numbers."""
    return np.ndarray((len(buf) - 7,), "<u8", buf, 0, (1,))


def _window_rank(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit rank of the LENGTH bytes from each position in ``at``."""
    words = _loads(buf)
    h = words[at] * _M2
    for offset in (8, 16, 24, 32, 40, LENGTH - 8):
        h = _mix(h, words[at + offset])
    return h


def _blocks(buf: np.ndarray, ends: np.ndarray):
    """(anchor rank, first window, last window, document index) of each run of windows with one anchor.

    Works in pieces of CHUNK_BYTES, long documents included. A piece's edge cuts a run in two, which changes blocks but
    not the windows they hold.
    """
    keys, firsts, lasts = [], [], []
    for begin in range(0, len(buf) - LENGTH + 1, CHUNK_BYTES):
        part = buf[begin : begin + CHUNK_BYTES + LENGTH - 1]
        words = _loads(part)
        n = len(part) - GRAM + 1
        gram = _mix(_mix(words[:n] * _M2, words[8 : 8 + n]), words[GRAM - 8 : GRAM - 8 + n])
        low, span = gram, 1
        while span * 2 <= WINDOWS:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < WINDOWS:
            low = np.minimum(low[: -(WINDOWS - span)], low[WINDOWS - span :])
        new = np.empty(len(low), bool)
        new[0] = True
        np.not_equal(low[1:], low[:-1], out=new[1:])
        valid = np.ones(len(low), bool)  # windows that stay inside their document
        inside = ends[np.searchsorted(ends, begin, side="right") : np.searchsorted(ends, begin + len(part), side="left")]
        for b in np.unique(inside - begin).tolist():
            valid[max(0, b - LENGTH + 1) : b] = False
            if b < len(low):
                new[b] = True
        new[1:] |= valid[1:] & ~valid[:-1]
        first = np.flatnonzero(new & valid)
        if not len(first):
            continue
        tail = np.flatnonzero(new | ~valid)
        at = np.searchsorted(tail, first, side="right")
        last = np.where(at < len(tail), tail[np.minimum(at, len(tail) - 1)], len(low)) - 1
        if (extra := (last - first) // RUN).any():  # long runs, as in a text of one repeated word
            rep = np.repeat(np.arange(len(first)), extra + 1)
            step = np.arange(len(rep)) - np.repeat(np.cumsum(extra + 1) - extra - 1, extra + 1)
            f = first[rep] + step * RUN
            last = np.minimum(last[rep], f + RUN - 1)
            first = f
        keys.append(low[first])
        firsts.append(first + begin)
        lasts.append(last + begin)
    if not keys:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, empty, empty
    first = np.concatenate(firsts)
    return np.concatenate(keys), first, np.concatenate(lasts), np.searchsorted(ends, first, side="right")


def _block_rank(buf, first, last):
    """Rank of a whole block: those of its first and last window, and their distance."""
    if not len(first):
        return np.zeros(0, np.uint64)
    return _mix(_mix(_window_rank(buf, first), _window_rank(buf, last)), (last - first).astype(np.uint64))


def _distinct(k1, k2, docs):
    """Distinct pairs, their smallest documents, and whether they stand in several documents."""
    order = np.lexsort((docs, k2, k1))
    a, b, d = k1[order], k2[order], docs[order]
    if not len(a):
        return a, b, d, np.zeros(0, bool)
    start = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    stop = np.r_[start[1:], len(a)] - 1
    return a[start], b[start], d[start], d[start] != d[stop]


def _owner(batch_id: int, several):
    """A row's batch and its flag in one number."""
    return np.int64(batch_id) * 2 + several.astype(np.int64)


def _anchors(batch_id, meta, ends, buf):
    """Round 1: the distinct anchors of a batch."""
    keys, _, _, doc = _blocks(buf, ends)
    keys, _, _, several = _distinct(keys, np.zeros(len(keys), np.uint64), _ids(meta)[doc])
    return rows_of({"anchor": keys, "owner": _owner(batch_id, several)})


def _ids(meta):
    """Ids of a batch; null counts as the largest number."""
    import pyarrow.compute as pc

    return pc.fill_null(meta.column("id"), ID_MAX).to_numpy()


def _shared(batches):
    """Anchors in rank order: those of two batches or documents, to each batch that holds them."""
    import pyarrow as pa

    held = None  # the last row, whose next one is not known yet

    def out(k, owner, shared):
        owner = owner[shared] >> 1
        return pa.RecordBatch.from_arrays([pa.array(owner), pa.array(k[shared])], names=["batch_id", "anchor"])

    for batch in batches:
        k, owner = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(k):
            continue
        before = None if held is None else held[2]  # whether the held row's predecessor is equal to it
        if held is not None:
            k, owner = np.r_[held[0], k], np.r_[held[1], owner]
        same = k[1:] == k[:-1]
        shared = (owner & 1).astype(bool)
        shared[1:] |= same
        shared[:-1] |= same
        if before:
            shared[0] = True
        if len(k) > 1:
            yield out(k[:-1], owner[:-1], shared[:-1])
        held = k[-1:], owner[-1:], bool(same[-1]) if len(same) else bool(before)
    if held is not None:
        yield out(held[0], held[1], np.array([held[2] or bool(held[1][0] & 1)]))


def _pairs(batch_id, meta, ends, buf, live):
    """Round 2: the distinct (anchor, block) pairs of a batch whose anchors are shared."""
    keys, first, last, doc = _blocks(buf, ends)
    keep = _within(keys, column(live, "anchor", np.uint64))
    keys, first, last, doc = keys[keep], first[keep], last[keep], doc[keep]
    a, b, d, several = _distinct(keys, _block_rank(buf, first, last), _ids(meta)[doc])
    return rows_of({"anchor": a, "pair": b, "doc": d, "owner": _owner(batch_id, several)})


def _within(values, some):
    import pyarrow as pa
    import pyarrow.compute as pc

    return pc.is_in(pa.array(values), value_set=pa.array(some)).to_numpy(zero_copy_only=False) if len(some) else np.zeros(len(values), bool)


def _settle(ask: bool):
    """Rows (anchor, pair, doc, owner) in sort order to replies (batch_id, kind, anchor, pair, least).

    ``least`` is the smallest document of a run of equal pairs. Kind 0: later documents hold the pair. Kind 1, only if
    ``ask``: besides, the anchor heads other pairs, so the windows of the first document are still open. Rows that
    nothing follows from get no reply. A run is never cut by a partition's edge; an anchor may be, and then asks.
    """

    def run(batches):
        import pyarrow as pa

        held, now, begun = [], None, False  # rows whose anchor has had one pair so far are told later
        lead = None  # (anchor, pair, least) of the run that the last row belongs to
        many = False  # whether the last row's anchor is known to have several pairs
        edge = True  # whether the last row's anchor is the partition's first
        for batch in batches:
            a, b, d, owner = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            n = len(a)
            if not n:
                continue
            new1 = np.r_[lead is None or a[0] != lead[0], a[1:] != a[:-1]]
            new2 = new1 | np.r_[lead is None or b[0] != lead[1], b[1:] != b[:-1]]
            start = np.flatnonzero(new2)
            run_of = np.cumsum(new2) - 1
            least = np.where(run_of >= 0, d[start[np.maximum(run_of, 0)]] if len(start) else 0, lead[2] if lead else 0)
            told = (d != least) | ((owner & 1) > 0)
            if ask:
                group = np.cumsum(new1)  # 0: the anchor that the batch before ended with
                pairs = np.bincount(group, weights=new2, minlength=group[-1] + 1).astype(np.int64)
                several = pairs > 1
                if not new1[0]:
                    several[0] = many or pairs[0] > 0  # a further pair of an anchor that had one
                touches = np.zeros(len(pairs), bool)
                touches[0] = edge and not new1[0]
                if not begun:
                    touches[group[0]] = True
                open_ = (several | touches)[group]
                # the batch's last anchor may go on: hold its rows back while it has one pair
                last = group == group[-1]
                wait = last & ~open_
                if len(held) and (not new1[0]):  # rows held from before share this batch's first anchor
                    if several[0]:
                        yield from _reply(pa, held, True)
                        held = []
                    elif group[-1] > 0:
                        yield from _reply(pa, held, False)
                        held = []
                elif len(held):
                    yield from _reply(pa, held, False)
                    held = []
                many, edge = bool(several[-1]), bool(touches[-1])
                some = ~wait & (told | open_)
                if some.any():
                    yield _settled(pa, a[some], b[some], least[some], owner[some], open_[some])
                if wait.any():
                    # of one pair: only its first row can ask later, others are told now
                    now_told = wait & told
                    if now_told.any():
                        yield _settled(pa, a[now_told], b[now_told], least[now_told], owner[now_told], np.zeros(int(now_told.sum()), bool))
                    head = np.flatnonzero(wait & (d == least))[:1]
                    if len(head) and not held:
                        held = [(a[head], b[head], least[head], owner[head])]
            elif told.any():
                yield _settled(pa, a[told], b[told], least[told], owner[told], np.zeros(int(told.sum()), bool))
            lead, begun = (a[-1], b[-1], least[-1]), True
        if held:  # the partition's last anchor may go on in the next partition
            yield from _reply(pa, held, True)

    return run


def _reply(pa, held, ask: bool):
    if ask:
        for a, b, least, owner in held:
            yield _settled(pa, a, b, least, owner, np.ones(len(a), bool))


def _settled(pa, a, b, least, owner, ask):
    return pa.RecordBatch.from_arrays([pa.array(owner >> 1), pa.array(ask.astype(np.int32)), pa.array(a), pa.array(b), pa.array(least)], names=["batch_id", "kind", "anchor", "pair", "least"])


def _lookup(k1, k2, replies):
    """For each pair: the smallest document a reply names (its own place in order otherwise), and whether any asks."""
    least = np.full(len(k1), ID_MAX, np.int64)
    ask = np.zeros(len(k1), bool)
    a, b = column(replies, "anchor", np.uint64), column(replies, "pair", np.uint64)
    if not len(a) or not len(k1):
        return least, ask
    names = np.unique(np.concatenate([a, k1]), return_inverse=True)[1].astype(np.uint64)
    others = np.unique(np.concatenate([b, k2]), return_inverse=True)[1].astype(np.uint64)
    code = (names << np.uint64(32)) | others
    known, want = code[: len(a)], code[len(a) :]
    order = np.argsort(known, kind="stable")
    known = known[order]
    start = np.flatnonzero(np.r_[True, known[1:] != known[:-1]])
    low = np.minimum.reduceat(column(replies, "least")[order], start)
    asks = np.maximum.reduceat(replies.column("kind").to_numpy()[order], start) > 0
    known = known[start]
    at = np.minimum(np.searchsorted(known, want), len(known) - 1)
    hit = known[at] == want
    least[hit] = low[at[hit]]
    ask[hit] = asks[at[hit]]
    return least, ask


def _open_windows(ids, ends, buf, replies):
    """Blocks settled by round 2 and the windows it leaves open, found from the batch and its replies."""
    keys, first, last, doc = _blocks(buf, ends)
    keep = _within(keys, column(replies, "anchor", np.uint64))
    keys, first, last, doc = keys[keep], first[keep], last[keep], doc[keep]
    least, ask = _lookup(keys, _block_rank(buf, first, last), replies)
    gone = least < ids[doc]
    ask &= least == ids[doc]
    rep = (last - first + 1)[ask]
    at = np.repeat(first[ask], rep) + (np.arange(rep.sum()) - np.repeat(np.cumsum(rep) - rep, rep))
    return first[gone], last[gone], np.repeat(keys[ask], rep), at, np.repeat(doc[ask], rep)


def _windows(batch_id, meta, ends, buf, replies):
    """Round 3: the distinct (anchor, window) pairs that round 2 left open."""
    ids = _ids(meta)
    _, _, keys, at, doc = _open_windows(ids, ends, buf, replies)
    a, b, d, several = _distinct(keys, _window_rank(buf, at) if len(at) else np.zeros(0, np.uint64), ids[doc])
    return rows_of({"anchor": a, "pair": b, "doc": d, "owner": _owner(batch_id, several)})


def _finish(batch_id, meta, ends, buf, replies):
    """Removed spans and kept bytes of each document."""
    import pyarrow as pa
    import pyarrow.compute as pc

    ids = _ids(meta)
    last_round = pc.equal(replies.column("round"), 3)
    first, last, keys, at, doc = _open_windows(ids, ends, buf, replies.filter(pc.invert(last_round)))
    if len(at):
        least, _ = _lookup(keys, _window_rank(buf, at), replies.filter(last_round))
        at = at[least < ids[doc]]
    edge = np.zeros(len(buf) + 1, np.int32)
    np.add.at(edge, first, 1)
    np.add.at(edge, last + LENGTH, -1)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + LENGTH, -1)
    drop = np.cumsum(edge[:-1]) > 0
    begins = np.r_[0, ends[:-1]]
    first_byte = np.zeros(len(buf) + 1, bool)
    first_byte[begins] = True
    first_byte[-1] = True
    turn = np.flatnonzero(np.r_[drop[:1], drop[1:] != drop[:-1]] | (drop & first_byte[:-1])) if len(buf) else np.zeros(0, np.int64)
    start = turn[drop[turn]]  # a span starts where removal does, and at each document's first byte
    stop = np.flatnonzero(drop & np.r_[~drop[1:] | first_byte[1:-1], True]) + 1 if len(buf) else start
    of = np.searchsorted(ends, start, side="right")
    cuts = np.searchsorted(of, np.arange(len(ends) + 1))
    pairs = pa.StructArray.from_arrays([pa.array(start - begins[of]), pa.array(stop - begins[of])], names=["start", "end"])
    kept = [buf[b:e][~drop[b:e]].tobytes() if j > i else buf[b:e].tobytes() for b, e, i, j in zip(begins.tolist(), ends.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    return pa.table({
        "id": meta.column("id"), "n_bytes": pa.array(ends - begins), "spans": pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pairs), "kept": pa.array(kept, pa.binary()),
    })


_ROW = "anchor long, pair long, doc long, owner long"
_REPLY = "batch_id long, kind int, anchor long, pair long, least long"


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row per input row: id, n_bytes, spans (array of start, end in bytes, removed), kept (the bytes left).

    Null and empty texts have no bytes and lose none. A null id counts as larger than every id, so such a row loses to
    rows with an id and never to another null (nor to the id 2^63 - 1). Rows repeating an id do not remove each other's
    bytes. Texts shorter than 50 bytes are never touched; a very long text is a batch of its own and is worked through
    in pieces. Extra columns are ignored and an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = pack_batches(docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(F.col(text_col))), batch_bytes)
    anchors = texts.mapInArrow(each_batch(_anchors), "anchor long, owner long")
    live = table(anchors.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_shared, "batch_id long, anchor long"), "anchors")
    pairs = table(with_replies(texts, live, _pairs, _ROW), "pairs")
    drop_table(live)
    dealt = pairs.repartitionByRange("anchor", "pair").sortWithinPartitions("anchor", "pair", "doc")
    settled = table(dealt.mapInArrow(_settle(True), _REPLY), "blocks")
    drop_table(pairs)
    asked = with_replies(texts, settled, _windows, _ROW).repartition("anchor", "pair").sortWithinPartitions("anchor", "pair", "doc")
    windows = table(asked.mapInArrow(_settle(False), _REPLY), "windows")
    replies = settled.withColumn("round", F.lit(2)).unionAll(windows.withColumn("round", F.lit(3)))
    out = with_replies(texts, replies, _finish, "id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return out.withColumnRenamed("id", id_col)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The digest of :func:`repeated_spans`: id, n_bytes, n_removed, n_spans, kept_sha256."""
    out = repeated_spans(docs, id_col, text_col, **options)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select(id_col, "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(load(spark, sf_dir, "documents"))


#: Every 50-byte window of every text, in pieces of 1,000 positions so that no long string is walked for each of them.
SQL = {
    "op5_substring_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
chunks AS (
  SELECT doc_id, c, substr(h, 2 * c + 1, 2 * 1049) AS h
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2, 1000)) AS c FROM d)),
windows AS (
  SELECT doc_id, c + i AS i, substr(h, 2 * i + 1, 100) AS w
  FROM (SELECT doc_id, c, h, unnest(range(0, least(1000, length(h) // 2 - 49))) AS i FROM chunks WHERE length(h) >= 100)),
hits AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY w) AS least FROM windows) WHERE least < doc_id),
marked AS (SELECT doc_id, i, coalesce(i > lag(i) OVER o + 50, true) AS new FROM hits WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (SELECT doc_id, i, sum(new::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM marked),
spans AS (SELECT doc_id, n, min(i) AS b, max(i) + 50 AS e FROM numbered GROUP BY doc_id, n),
gaps AS (
  SELECT doc_id, coalesce(lag(e) OVER o, 0) AS b, b AS e FROM spans WINDOW o AS (PARTITION BY doc_id ORDER BY b)
  UNION ALL SELECT d.doc_id, coalesce(last, 0), length(h) // 2 FROM d LEFT JOIN (SELECT doc_id, max(e) AS last FROM spans GROUP BY doc_id) USING (doc_id)),
kept AS (SELECT doc_id, coalesce(string_agg(substr(h, 2 * b + 1, 2 * (e - b)), '' ORDER BY b), '') AS k FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
gone AS (SELECT doc_id, sum(e - b) AS removed, count(*) AS n FROM spans GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)
"""
}
