"""Functions that give back the caller's columns keep their values, whatever their names."""

import pytest
from pyspark.sql import functions as F

from actloom.llm.line_dedup import drop_lines, line_bitmaps
from actloom.llm.mixing import mixed_documents
from actloom.llm.near_copies import near_copy_rows
from actloom.llm.quality_classifier import keep_good
from actloom.llm.quality_rules import cleaned_documents

NAMES = (
    "__id __fp __own __print __pos __bits __rid __key __times __time __copies __rows __kept_id __kept_fp id fp rid row batch_id no_text body c0 c1 meta lens node root best place size at n "
    "turn shard shards number quotas keep_bits pos held q x trusted limit kept target taken copies hi lo bands a.b".split()
)


def documents(spark):
    words = "some words of a text that nobody else has written here in quite this order".split()
    rows = [(i, " ".join(w + "abcdefgh"[(i + k) % 8] * (1 + i % 3) for k, w in enumerate(words * 5)), "en", f"s{i % 2}", 0, *[1000 * i + k for k in range(len(NAMES))]) for i in range(12)]
    return spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "lang string", "source string", "n_chars long", *(f"`{n}` long" for n in NAMES)])).repartition(3)


def labels(spark):
    return spark.createDataFrame([(i, 1, 0) for i in range(0, 12, 2)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(
    "keep",
    [
        lambda spark, d: keep_good(d, labels(spark)),
        lambda spark, d: drop_lines(d, line_bitmaps(d)),
        lambda spark, d: near_copy_rows(d),
        lambda spark, d: mixed_documents(d),
        lambda spark, d: cleaned_documents(d),
    ],
    ids=["keep_good", "drop_lines", "near_copy_rows", "mixed_documents", "cleaned_documents"],
)
def test_values_stay(spark, keep):
    docs = documents(spark)
    out = keep(spark, docs)
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    found = {tuple(r)[5:] for r in out.collect()}
    assert found and found <= {tuple(r)[5:] for r in docs.collect()}


def test_texts_and_nulls_come_back(spark):
    rows = [(1, None, "a"), (2, "x y z é\n", None), (3, "", "b"), (4, "Long " * 400_000, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, more string")
    got = sorted((tuple(r) for r in near_copy_rows(docs).collect()), key=lambda r: r[0])
    assert got == [rows[0], rows[1], rows[3]]  # the empty text is a copy of the null one


def test_no_text_is_shuffled_for_near_copies(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * 20) for i in range(50)], "doc_id long, text string")
    plan = near_copy_rows(docs)._jdf.queryExecution().executedPlan().toString()
    # what is sorted for the batches' side comes from its bucketed scan, not from an exchange
    side = plan.split("FlatMapCoGroupsInArrow")[1]
    scan = next(line for line in side.splitlines() if "FileScan" in line and "meta" in line)
    before = side[: side.index(scan)]
    assert "Exchange" not in before


def test_rows_of_one_id_and_text(spark):
    """A third of all rows, or all of them, may have no id and one text."""
    text = "this line is long enough to count as one, as it has more than forty characters\nshort " + "word " * 60
    docs = spark.range(40_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    docs = docs.unionByName(docs.limit(30).withColumn("doc_id", F.monotonically_increasing_id()))
    assert drop_lines(docs, line_bitmaps(docs)).groupBy(F.length("text").alias("n")).count().count() == 2
    from actloom.llm.mixing import mix

    taken = mix(docs).agg(F.count(F.lit(1)), F.sum("size"), F.sum("taken"), F.max(F.col("taken") / F.col("size"))).first()
    assert taken[0] == 40_030 and abs(taken[2] - 1.5 * taken[1]) < 0.01 * taken[1] and taken[3] <= 2
    from actloom.llm.exact_dedup import exact_dedup

    kept = exact_dedup(docs).groupBy("keep_id", "group_size").count().collect()
    assert [(r.group_size, r["count"]) for r in kept] == [(40_030, 40_030)]
