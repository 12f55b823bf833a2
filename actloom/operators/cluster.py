"""Grouping of texts by SimHash, group centroids, assignment to centroids, k-means and cluster reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.quantiles import quantiles
from ..sources.scratch import written

#: Words that take no part in a text's fingerprint. Fixed values.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "can", "could", "did", "do", "does", "for", "from", "has", "have", "if", "in", "is", "it", "its", "may", "might", "of", "on", "or", "our",
    "please", "should", "that", "the", "their", "this", "to", "we", "were", "will", "with", "would", "you", "your",
)


def hash_tokens(text) -> Column:
    c = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    return F.filter(F.regexp_extract_all(c, F.lit("[a-z0-9]+"), 0), lambda w: ~w.isin(*STOPWORDS))


KNOWN = 50_000  # words whose digests a task keeps
PIECE = 1 << 20  # bytes of text that are worked on at once


def _pieces(texts):
    """Slices of an array of texts, each of about PIECE bytes or one text."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(texts):
        before = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, before + PIECE, "right")))
        stop = min(stop, begin + 2048)
        yield begin, texts.slice(begin, stop - begin)
        begin = stop


def _fingerprints(bits: int):
    """Texts to group keys, a piece of an Arrow batch at a time: words are split and numbered in Arrow, each distinct word
    is digested once, and a text's votes are sums over its words' numbers. A task holds a batch, a piece's words and
    KNOWN digests, whatever the table's size."""
    import hashlib

    import numpy as np

    weights, stop = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64), frozenset(STOPWORDS)
    known: dict[str, bytes] = {}  # digests of words met before, in bounded number

    def digest(word: str) -> bytes:
        if (found := known.get(word)) is None:
            found = hashlib.md5(word.encode()).digest()[:8]
            if len(known) >= KNOWN:
                known.clear()
            if len(word) <= 64:
                known[word] = found
        return found

    def votes(words) -> np.ndarray:
        """A row of -1 and 1 for each word; of 0 for words that take no part."""
        digests = np.frombuffer(b"".join(map(digest, words)), np.uint8).reshape(-1, 8)
        out = np.unpackbits(digests, axis=1)[:, :bits].astype(np.int8) * 2 - 1
        out[[i for i, w in enumerate(words) if not w or w in stop]] = 0
        return out

    def run(texts):
        import pyarrow as pa
        import pyarrow.compute as pc

        out = np.zeros(len(texts), np.int64)
        for begin, part in _pieces(texts):
            part = part.fill_null("")
            split = pc.split_pattern(pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(part), "[^a-z0-9]+", " "), " "), " ")
            numbered = pc.list_flatten(split).dictionary_encode()
            table, code = votes(numbered.dictionary.to_pylist()), numbered.indices.to_numpy()
            starts = split.offsets.to_numpy()[:-1]  # an empty text is one empty word, so no text is without one
            total = np.add.reduceat(table[code], starts, axis=0, dtype=np.int32)
            some = np.add.reduceat(table.any(axis=1)[code], starts, dtype=np.int32) > 0
            out[begin : begin + len(part)] = np.where(some, (total >= 0) @ weights, 0)
        pa.default_memory_pool().release_unused()
        return pa.array(out)

    return run


def with_group_key(df: DataFrame, text: str = "text", bits: int = 12, name: str = "group_key") -> DataFrame:
    """Adds the top ``bits`` bits of each text's 64-bit SimHash over MD5 of its tokens; 0 without tokens.

    A bit is set if at least half of the tokens set it. ``bits`` is 1 to 63, a key being a signed long.
    """
    if not 1 <= bits <= 63:
        raise ValueError("bits must be 1 to 63")
    from pyspark.sql.types import LongType

    return df.withColumn(name, F.arrow_udf(_fingerprints(bits), LongType())(F.col(text)))


def representatives(df: DataFrame, key: list[str], text: str, pos: str, reps: int = 1, seed: int = 42) -> DataFrame:
    """The longest text of each group (the first on a tie), and ``reps - 1`` others by a seeded hash."""
    longest = df.groupBy(*key).agg(F.count(F.lit(1)).alias("size"), F.max_by(F.struct(pos, text), F.struct(F.length(text), -F.col(pos))).alias("top"))
    if reps <= 1:
        return longest.select(*key, "size", F.col(f"top.{pos}").alias(pos), F.col(f"top.{text}").alias(text), F.lit(1).alias("rank"))
    order = Window.partitionBy(*key).orderBy((F.col(pos) != F.col("__top")).cast("int"), *seeded(pos, seed))
    named = df.join(longest.select(*key, "size", F.col(f"top.{pos}").alias("__top")), key)
    return named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= reps).select(*key, "size", pos, text, "rank")


def l2_norm(v) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(v) -> Column:
    """Unit vector; a zero vector stays as it is."""
    c = F.col(v) if isinstance(v, str) else v
    n = l2_norm(c)
    return F.transform(c, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))


def centroids(df: DataFrame, key: list[str], vector: str) -> DataFrame:
    """Mean vector of each group, renormalised: one row per group and dimension meets in the shuffle."""
    long = df.select(*key, F.posexplode(vector).alias("i", "x"))
    mean = long.groupBy(*key, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    rows = mean.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("d"))
    return rows.select(*key, normalized(F.transform("d", lambda s: s["m"])).alias("centroid"))


def squared_distance(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def assign(vectors: DataFrame, centers: DataFrame, id_col: str, vector: str, center_id: str = "cid", center: str = "centroid", most: int = 10_000) -> DataFrame:
    """Nearest center of each vector, the smallest id on a tie.

    The centers, k rows by definition, travel as arrays of about ``most`` in broadcast rows; the argmin runs inside each
    vector's row, block after block, so nothing is multiplied out or shuffled.
    """
    blocks = max(1, -(-centers.count() // most))
    best, rows = None, vectors
    for i in range(blocks):
        some = centers.filter(F.pmod(F.xxhash64(center_id), F.lit(blocks)) == i) if blocks > 1 else centers
        packed = some.agg(F.array_sort(F.collect_list(F.struct(F.col(center_id).alias("c"), F.col(center).alias("v")))).alias("__centers"))
        near = F.array_min(F.transform("__centers", lambda s: F.struct(squared_distance(F.col(vector), s["v"]).alias("d"), s["c"].alias("c"))))
        rows = rows.join(F.broadcast(packed)).withColumn("__best", near if best is None else F.least(F.col("__best"), near)).drop("__centers")
        best = True
    return rows.select(id_col, F.col("__best.c").alias(center_id), F.col("__best.d").alias("distance"))


def kmeans(df: DataFrame, vector: str, k: int, seed: int = 42, max_iter: int = 50) -> DataFrame:
    """k-means clusters of the whole table by Spark's own KMeans (k-means|| start), which iterates over partial sums by
    partition. Its block solver compares blocks of vectors with all centers; the row solver sends the k * k distances between
    centers to the driver in every round."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = df.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))
    model = KMeans(k=k, seed=seed, maxIter=max_iter, solver="block", featuresCol="__v", predictionCol="cluster_id").fit(data)
    return model.transform(data).drop("__v")


def seeded(pos: str, seed: int) -> list[Column]:
    """A random order that any engine can repeat: MD5 of position and seed."""
    return [F.md5(F.concat_ws(":", F.col(pos).cast("string"), F.lit(str(seed)))), F.col(pos)]


def kmeans_scoped(df: DataFrame, scope: str, vector: str, pos: str, k: int, seed: int = 42, max_iter: int = 10) -> DataFrame:
    """k-means inside each scope (a forum, a source): adds cluster_id, numbered from 0 in each.

    All scopes are iterated together: a round joins rows with their scope's centers, those at hand and those before (one
    row a scope), and takes partial means by (scope, cluster, dimension) with the labels that changed. Ends when no label
    changes, all being 0 before the first round, or after ``max_iter`` rounds. A scope with fewer rows than k has one cluster
    a row at the start; a cluster that loses all members goes on from a row of its scope by a seeded hash.
    """
    start = Window.partitionBy(scope).orderBy(*seeded(pos, seed))
    first = df.withColumn("__n", F.row_number().over(start)).filter(F.col("__n") <= k)  # each task keeps k rows a scope
    centers = written(first.select(scope, (F.col("__n") - 1).alias("cluster_id"), F.col(vector).cast("array<double>").alias("centroid"), F.lit(None).cast("array<double>").alias("before")), "centers")

    def joined(now):
        held = F.array_sort(F.collect_list(F.struct("cluster_id", "centroid", "before")))
        packed = written(now.groupBy(scope).agg(held.alias("__centers")), "packed")
        near = lambda which: F.array_min(F.transform("__centers", lambda c: F.struct(squared_distance(F.col(vector), c[which]).alias("d"), c["cluster_id"].alias("cluster_id"))))["cluster_id"]
        return df.join(packed, scope), near

    for i in range(1, max_iter + 1):
        rows, near = joined(centers)
        old = near("before") if i > 1 else F.lit(0)
        told = rows.select(scope, near("centroid").alias("cluster_id"), old.alias("old"), vector)  # a row is labelled before it is exploded
        dims = told.select(scope, "cluster_id", "old", F.posexplode(vector).alias("i", "x"))
        changed = F.sum(((F.col("i") == 0) & (F.col("cluster_id") != F.col("old"))).cast("int"))
        long = dims.groupBy(scope, "cluster_id", "i").agg(F.avg(F.col("x").cast("double")).alias("m"), changed.alias("c"))
        means = written(long.groupBy(scope, "cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"), F.sum("c").alias("c")), "means")
        if i == max_iter or not means.filter("c > 0").limit(1).count():
            break
        moved = centers.join(means, [scope, "cluster_id"], "left").select(scope, "cluster_id", F.col("mean").alias("centroid"), F.col("centroid").alias("before"))
        empty = moved.filter("centroid IS NULL").select(scope, "cluster_id")
        draw = F.min_by(F.col(vector).cast("array<double>"), F.struct(F.md5(F.concat_ws(":", F.col(pos).cast("string"), F.lit(str(seed)), F.lit(str(i)), F.col("cluster_id").cast("string"))), F.col(pos)))
        drawn = df.join(empty, scope).groupBy(scope, "cluster_id").agg(draw.alias("drawn"))
        centers = written(moved.join(drawn, [scope, "cluster_id"], "left").withColumn("centroid", F.coalesce("centroid", "drawn")).drop("drawn"), "centers")
    rows, near = joined(centers)
    return rows.withColumn("cluster_id", near("centroid")).drop("__centers")


def kmeans_minibatch(df: DataFrame, vector: str, pos: str, k: int, seed: int = 42, max_iter: int = 50, batch: int = 1024) -> DataFrame:
    """Mini-batch k-means for large n times k: (pos, cid, distance) of every row; see :func:`.kmeans.minibatch`."""
    from .kmeans import minibatch

    return minibatch(df, pos, vector, k, seed, max_iter, batch).withColumnRenamed("cluster_id", "cid")


def cluster_sizes(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("size"))


def size_summary(sizes: DataFrame) -> DataFrame:
    sizes = written(sizes.select("size"), "sizes")
    median = quantiles(sizes, [], "size", {"size_median": 0.5})
    rest = sizes.agg(F.min("size").alias("size_min"), F.avg("size").alias("size_mean"), F.max("size").alias("size_max"))
    return rest.join(median, F.lit(True), "left").select("size_min", "size_median", "size_mean", "size_max")  # one row each


def largest(sizes: DataFrame, key: list[str], n: int = 10) -> DataFrame:
    return sizes.orderBy(F.desc("size"), *key).limit(n)


def samples(df: DataFrame, key: list[str], pos: str, n: int = 6, seed: int = 42) -> DataFrame:
    """Up to ``n`` members of each cluster by a seeded hash; the rank filter prunes before the shuffle."""
    order = Window.partitionBy(*key).orderBy(*seeded(pos, seed))
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def row_sample(df: DataFrame, pos: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows by a seeded hash, in their own order."""
    return df.orderBy(*seeded(pos, seed)).limit(n).orderBy(pos)


def label_memory(df: DataFrame, scope: str, order: str, cluster: str, label: str, memory: int = 50) -> DataFrame:
    """(scope, cluster, taken, reused): a label met among the scope's last ``memory`` new ones takes that cluster.

    Sequential by definition, so each scope's clusters, k by definition, are folded in order inside one row.
    """
    entry = "struct<id:string,label:string>"
    rows = df.groupBy(scope).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("n"), F.col(cluster).cast("string").alias("id"), F.col(label).alias("label")))).alias("r"))
    start = F.struct(F.array().cast(f"array<{entry}>").alias("memory"), F.array().cast("array<struct<id:string,taken:string,reused:boolean>>").alias("out"))

    def step(s, r):
        known = F.get(F.filter(s["memory"], lambda m: m["label"] == r["label"]), F.lit(0))
        longer = F.concat(s["memory"], F.array(F.struct(r["id"].alias("id"), r["label"].alias("label"))))
        kept = F.slice(longer, F.greatest(F.size(longer) - memory + 1, F.lit(1)), F.lit(memory))
        told = F.struct(r["id"].alias("id"), F.coalesce(known["id"], r["id"]).alias("taken"), known.isNotNull().alias("reused"))
        return F.struct(F.when(known.isNull(), kept).otherwise(s["memory"]).alias("memory"), F.concat(s["out"], F.array(told)).alias("out"))

    folded = rows.select(scope, F.explode(F.aggregate("r", start, step, lambda s: s["out"])).alias("x"))
    return folded.select(scope, F.col("x.id").alias(cluster), "x.taken", "x.reused")
