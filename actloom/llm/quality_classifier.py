"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The units are UTF-8 bytes, none of them folded, so the model knows every script and word form; n-grams of ORDER bytes
are one long number, their context and suffix its leading and trailing bytes. All tables are sharded by n-gram and grow
with the text; none is sent to the driver or broadcast.

Training, over trusted texts only: each batch counts its n-grams, partial counts meet by n-gram, lower orders take
continuation counts from the order above, and each order's probabilities join counts with context totals (by context)
and with the order below (by suffix):

    p_k(w | h) = max(c(hw) - D(c(hw)), 0) / c(h.) + (D1 N1(h) + D2 N2(h) + D3 N3+(h)) / c(h.) * p_(k-1)(w | h')

with D1, D2, D3+ of each order from its counts of counts, and order 1 interpolated with 1/256.

Scoring: each batch of documents asks for its distinct n-grams once; the distinct n-grams of all batches join the
model order by order, backing off with the contexts' weights where they are not seen, and the probabilities go back to
the batches that asked. Texts never move. A document is kept if its perplexity is at most a quantile of its language's
held-out trusted documents: one trusted document in HELD is not trained on, so that the limit is not that of
documents the model knows by heart. Short texts have unsteady perplexities, so the quantile is taken by
language and class of length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .batches import Rows, column, each_batch, meta_rows, pack_batches, rows_of, text_bytes, with_replies
from .common import drop_table, load, small_batches, table

ORDER = 5  # 7 at most, as an n-gram is a positive long
BATCH_BYTES = 32 << 20
HELD = 4  # one trusted document in so many sets limits and is not trained on
QUANTILE = 0.99
SLACK = 1.05
CLASSES = (200, 1000)  # bytes from which a text is of the next class of length
FEW = 100  # held-out documents below which a limit also looks at all languages and lengths together
GRID = 1000  # bins of perplexity for a unit of its logarithm
PIECE = 1 << 17  # bytes that are worked on at once: an array of them as longs is 1 MB
SEED = 31
PAD = 10  # texts start after line ends


def is_held(id_col: str):
    """Whether a trusted document sets limits instead of training."""
    return F.pmod(F.xxhash64(id_col, F.lit(SEED)), F.lit(HELD)) == 0


def pieces(ends: np.ndarray, buf: np.ndarray, order: int = ORDER):
    """(first position, n-gram that ends at each position) for pieces of the texts, long ones included."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    for begin in range(0, len(buf), PIECE):
        stop = min(len(buf), begin + PIECE)
        code = buf[begin:stop].astype(np.uint64)
        doc = np.searchsorted(ends, begin, side="right")
        inside = starts[doc : np.searchsorted(starts, stop, side="left")]
        for k in range(1, order):
            back = np.full(stop - begin, PAD, np.uint64)
            low = max(0, k - begin)
            if low < stop - begin:
                back[low:] = buf[begin - k + low : stop - k]
            # the first k positions of a text look back past its start
            at = (inside[:, None] + np.arange(k)).ravel() - begin
            owner_end = np.repeat(ends[np.searchsorted(ends, inside, side="right")] if len(inside) else inside, k) - begin
            at = at[(at >= 0) & (at < stop - begin) & (at < owner_end)]
            back[at] = PAD
            code |= np.left_shift(back, np.uint64(8 * k), out=back)
        yield begin, code.view(np.int64)


def merged(parts, merge):
    """All of ``parts`` merged, as far as there are any; they are merged as they come, so that about twice what is left is held."""
    found, held, most = [], 0, PIECE
    for part in parts:
        found.append(part)
        held += len(part)
        if held > most:
            found = [merge(found)]
            held = len(found[0])
            most = 2 * held + PIECE
    return merge(found)


def _counts(order: int):
    """n-grams of the rows that ``marks`` (row) names."""

    def step(batch_id, meta, ends, buf, marks):
        import pyarrow as pa

        rows = np.unique(column(marks, "row"))
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        some = np.concatenate([buf[:0], *(buf[starts[i] : ends[i]] for i in rows.tolist())])
        none = pa.table({"code": pa.array([], pa.int64()), "c": pa.array([], pa.int64())})
        counted = (np.unique(code, return_counts=True) for _, code in pieces(np.cumsum((ends - starts)[rows]), some, order))
        parts = (pa.table({"code": values, "c": n.astype(np.int64)}) for values, n in counted)
        return merged(parts, lambda x: pa.concat_tables([none, *x]).group_by("code").aggregate([("c", "sum")]).rename_columns(["code", "c"]))

    return step


def _wanted(order: int):
    """The distinct n-grams of a batch."""

    def step(batch_id, meta, ends, buf):
        import pyarrow as pa
        import pyarrow.compute as pc

        found = (pc.unique(pa.array(code)) for _, code in pieces(ends, buf, order))
        codes = merged(found, lambda x: pc.unique(pa.chunked_array(x, pa.int64()))).to_numpy()
        return rows_of({"batch_id": np.full(len(codes), batch_id, np.int64), "code": codes})

    return step


def _score(order: int):
    """Rows of a batch with their size in bytes and perplexity."""

    def step(batch_id, meta, ends, buf, replies):
        import pyarrow as pa

        known = column(replies, "code")
        by_code = np.argsort(known)
        known, log_p = known[by_code], np.log(replies.column("p").to_numpy()[by_code].astype(np.float64))
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        total = np.zeros(len(ends), np.float64)
        for begin, code in pieces(ends, buf, order):
            asked = pa.array(code).dictionary_encode()  # every n-gram of the batch has a reply
            run = np.concatenate([[0.0], np.cumsum(log_p[np.searchsorted(known, asked.dictionary)][asked.indices])])
            first = np.searchsorted(ends, begin, side="right")
            last = np.searchsorted(starts, begin + len(code), side="left")
            a = np.clip(starts[first:last] - begin, 0, len(code))
            b = np.clip(ends[first:last] - begin, 0, len(code))
            total[first:last] += run[b] - run[a]
        sizes = ends - starts
        with np.errstate(divide="ignore", invalid="ignore"):
            value = np.round(np.exp(-total / sizes), 6)
        place = {"batch_id": pa.array(np.full(len(sizes), batch_id, np.int64)), "row": pa.array(np.arange(len(sizes), dtype=np.int32))}
        return pa.table(place | {c: meta.column(c) for c in ("id", "fp", "lang")} | {"size": pa.array(sizes), "perplexity": pa.array(value, pa.float64(), mask=sizes == 0)})

    return step


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Chen and Goodman's D1, D2, D3+ from the counts of counts.

    0.5, 1, 1.5 where these are missing or odd: without a discount a context leaves nothing to unseen n-grams.
    """
    plain = (0.5, 1.0, 1.5)
    if not (n1 and n2 and n3 and n4):
        return plain
    y = n1 / (n1 + 2 * n2)
    found = tuple(k - (k + 1) * y * more / n for k, n, more in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))
    return found if min(found) > 0 else plain


def _suffixes(code: str, order: int):
    """(k, last k bytes) of an n-gram for k from 1 to ``order``, as rows."""
    return F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(code).bitwiseAND((1 << 8 * k) - 1).alias("code")) for k in range(1, order + 1)])).alias("s")


def _tail():
    """The last k - 1 bytes of a k-gram ``code``."""
    return F.expr("code & (shiftleft(1L, 8 * (k - 1)) - 1)")


def train(grams: DataFrame, order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """From counted n-grams (code, c) the two tables of the model, for orders k from 1 to ``order``:

    (k, code, a), the discounted share of each seen k-gram in its context, and (k, ctx, g), the weight that each seen
    context gives to the order below. No rows: empty tables. A context has 256 followers at most, so no key is hot.
    """
    counted = grams.groupBy("code").agg(F.sum("c").alias("c")).select(_suffixes("code", order), "c")
    seen = table(counted.select("s.k", "s.code", "c").groupBy("k", "code").agg(F.sum("c").alias("c")), "grams")
    lower = seen.filter("k > 1").select((F.col("k") - 1).alias("k"), _tail().alias("code")).groupBy("k", "code").agg(F.count(F.lit(1)).alias("c"))
    counts = table(lower.unionAll(seen.filter(F.col("k") == order)), "counts")
    drop_table(seen)
    n = {(r.k, r.c): r.n for r in counts.filter("c <= 4").groupBy("k", "c").agg(F.count(F.lit(1)).alias("n")).collect()}  # 4 an order
    cut = F.lit(None).cast("double")
    for k in range(1, order + 1):
        d1, d2, d3 = discounts(*(n.get((k, i), 0) for i in (1, 2, 3, 4)))
        cut = F.when(F.col("k") == k, F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)).otherwise(cut)
    c = counts.withColumn("ctx", F.shiftright("code", 8)).withColumn("d", cut)
    totals = table(c.groupBy("k", "ctx").agg(F.sum("c").alias("total"), F.sum("d").alias("cut")), "totals")
    shares = c.join(totals.drop("cut"), ["k", "ctx"]).select("k", "code", ((F.col("c") - F.col("d")) / F.col("total")).alias("a"))
    return table(shares, "shares"), totals.select("k", "ctx", (F.col("cut") / F.col("total")).alias("g"))


def probabilities(wanted: DataFrame, model: tuple[DataFrame, DataFrame], order: int = ORDER) -> DataFrame:
    """(code, p) for every distinct n-gram of ``wanted``: the shares of its suffixes, weighted by their contexts."""
    shares, weights = model
    suffixes = wanted.select("code").distinct().select(_suffixes("code", order)).select("s.k", "s.code").distinct()
    met = suffixes.join(shares, ["k", "code"], "left").withColumn("ctx", F.shiftright("code", 8)).join(weights, ["k", "ctx"], "left")
    met = table(met.select("k", "code", F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("g", F.lit(1.0)).alias("g")), "met")
    p = met.filter("k = 1").select("code", (F.col("a") + F.col("g") / 256).alias("p"))
    for k in range(2, order + 1):
        below = p.select(F.col("code").alias("tail"), F.col("p").alias("q"))
        p = met.filter(F.col("k") == k).withColumn("tail", _tail()).join(below, "tail").select("code", (F.col("a") + F.col("g") * F.col("q")).alias("p"))
    return p


def _limits(sure: DataFrame, quantile: float) -> tuple[DataFrame, DataFrame]:
    """(lang, class, limit, n), and the same over everything; exact over a grid of 1/GRID in the logarithm."""
    binned = sure.select("lang", "class", F.ceil(F.log("perplexity") * GRID).alias("bin"))

    def cut(rows, keys):
        counted = rows.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("c"))
        upto = F.sum("c").over(Window.partitionBy(*keys).orderBy("bin"))
        whole = F.sum("c").over(Window.partitionBy(*keys))
        found = counted.withColumns({"upto": upto, "n": whole}).filter(F.col("upto") >= quantile * F.col("n"))
        return found.groupBy(*keys).agg(F.exp(F.min("bin") / GRID).alias("limit"), F.max("n").alias("n"))

    return cut(binned, ["lang", "class"]), cut(binned, [])


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    quantile: float = QUANTILE,
    slack: float = SLACK,
    order: int = ORDER,
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """One row per input row: id, fp (hash of the text), lang, trusted, perplexity, limit, kept.

    Trusted documents are those labelled quality 1 and not toxic. Null and empty texts have no perplexity and are
    rejected. Null languages form one language of their own. A language (or length) with fewer than FEW held-out
    documents takes the larger of its limit and that over all of them; without any held-out document everything with
    text is kept. Null ids are never trusted; repeated ids share their label. A very long text is worked through in
    pieces. Extra columns are ignored and an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    texts = pack_batches(docs.select(*[c.alias(n) for n, c in _known(id_col, text_col, lang_col).items()], text_bytes(F.col(text_col))), batch_bytes)
    out = _judged(texts, labels, quantile, slack, order)
    drop_table(texts)
    return out.select("id", "fp", "lang", "trusted", "perplexity", "limit", "kept")


def _known(id_col: str, text_col: str, lang_col: str) -> dict:
    """What is known of a row beside its text."""
    return {"id": F.col(id_col).cast("long"), "fp": F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), "lang": F.coalesce(F.col(lang_col).cast("string"), F.lit("\0"))}


def _judged(texts: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK, order: int = ORDER) -> DataFrame:
    """The columns of :func:`quality_scores`, and batch_id and row, for batches with what :func:`_known` gives."""
    spark, kept_columns = texts.sparkSession, "id long, fp long, lang string"
    good = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("x")).filter("id is not null and q = 1 and x = 0").select("id")
    good = table(good.withColumn("held", is_held("id")), "trusted")
    marks = meta_rows(texts, kept_columns).select("batch_id", "row", "id").join(good.filter("not held"), "id").select("batch_id", "row")
    model = train(with_replies(texts, marks, _counts(order), "code long, c long"), order)
    wanted = table(texts.mapInArrow(each_batch(_wanted(order)), "batch_id long, code long"), "wanted")
    p = table(probabilities(wanted, model, order), "p")
    replies = table(wanted.join(p, "code").select("batch_id", "code", F.col("p").cast("float").alias("p")), "replies")
    drop_table(wanted)
    scored = table(with_replies(texts, replies, _score(order), f"batch_id long, row int, {kept_columns}, size long, perplexity double"), "scores")
    drop_table(replies)
    kind = sum(((F.col("size") >= c).cast("int") for c in CLASSES), F.lit(0))
    scored = scored.withColumn("class", kind).join(good, "id", "left").withColumn("trusted", F.col("held").isNotNull())
    own, every = _limits(scored.filter("held and perplexity is not null"), quantile)
    most = every.select(F.col("limit").alias("most"))  # one row or none
    most = most.unionAll(spark.range(1).select(F.lit(float("inf")).alias("most"))).agg(F.min("most").alias("most")).first().most
    own = table(own.select("lang", "class", F.when(F.col("n") < FEW, F.greatest("limit", F.lit(most))).otherwise(F.col("limit")).alias("own")), "limits")
    # a (language, length) may hold a third of all rows: they are met by AQE's skew join, as both sides are written
    limit = F.coalesce("own", F.lit(most)) * slack
    out = scored.join(own, ["lang", "class"], "left").withColumn("limit", limit)
    return out.select("batch_id", "row", "id", "fp", F.nullif("lang", F.lit("\0")).alias("lang"), "trusted", "perplexity", "limit", (F.col("perplexity").isNotNull() & (F.col("perplexity") <= F.col("limit"))).alias("kept"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, perplexity, limit, kept for every document."""
    scores = quality_scores(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return scores.select(F.col("id").alias("doc_id"), "lang", "perplexity", "limit", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents that the classifier keeps, with their columns, whatever their names.

    Null and empty texts have no perplexity and go; rows of one id and text have one verdict. A very long text is scored
    whole. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    rows = Rows(docs, text_col, _known(id_col, text_col, lang_col))
    return rows.without(table(_judged(rows.batches, labels).filter("NOT kept").select("batch_id", "row"), "rejected"))
