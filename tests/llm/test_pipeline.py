"""The pipeline's stages on their own inputs, against brute force where SQL has no word for them."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

from .test_near_copies import groups


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen, where = [docs], tmp_path_factory.mktemp("stages")
    for i, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, seen[-1], sf_dir).write.parquet(f"{where}/{i}")
        seen.append(spark.read.parquet(f"{where}/{i}"))
    return seen


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "simhash near-dedup", "mixing", "packing"]
    assert all(x.columns == stages[0].columns for x in stages[1:-1])


def test_clean_documents_pass_the_classifier(spark, tmp_path):
    """Half of the labels train the stage, the other half judges it."""
    whole = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{whole}/documents.parquet"), spark.read.parquet(f"{whole}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)) == 0
    labels.filter(half).write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.quality(spark, docs, str(tmp_path)).select("doc_id")
    judged = labels.filter(~half).join(docs.filter("text <> ''").select("doc_id"), "doc_id")
    rate = lambda rows: rows.join(kept, "doc_id").count() / rows.count()
    assert rate(judged.filter("quality = 1 and toxic = 0")) >= 0.95
    assert rate(judged.filter("quality = 0")) <= 0.10


def test_lines_equal_brute_force(stages):
    rows = [(r.doc_id, r.text or "") for r in stages[1].collect()]
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\v\f\r"))
    held: dict[str, set] = {}
    for d, t in rows:
        for x in t.split("\n"):
            if len(key(x)) >= 40:
                held.setdefault(key(x), set()).add(d)
    want = {d: "\n".join(x for x in t.split("\n") if not (len(held.get(key(x), ())) >= 5 and d < max(held[key(x)]))) for d, t in rows}
    assert {r.doc_id: r.text or "" for r in stages[2].collect()} == want
    assert all(r.n_chars == len(r.text or "") for r in stages[2].collect())


def test_one_document_of_each_group_of_near_copies(stages):
    """All pairs by brute force: five words, similarity of 0.8 or more, recall and precision of the groups are whole."""
    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted(min(rows[i][0] for i in g) for g in groups(rows))


def test_mix_repeats_whole_texts(stages):
    words = lambda t: sum(1 for w in (t or "").translate({i: " " for i in (9, 10, 11, 12, 13)}).split(" ") if w)
    before = {r.doc_id: r.text for r in stages[3].collect()}
    total, copies = 0, Counter()
    for r in stages[4].collect():
        assert before[r.doc_id] == r.text
        total += words(r.text)
        copies[r.doc_id] += 1
    assert max(copies.values()) <= 2
    most = max(map(words, before.values()))  # a shard's selection may start and end inside a document
    assert abs(total - 1.5 * sum(map(words, before.values()))) <= 0.01 * total + 20 * most


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_a_stage_takes_an_empty_table_and_odd_rows(spark, sf_dir, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp long, __rid int"
    assert stage(spark, spark.createDataFrame([], schema), sf_dir).collect() == []
    odd = [(None, None, None, None, None, 1, 1), (None, "", "en", "a", 0, 1, 1), (1, "a b", "en", None, 3, 1, 1), (1, "a b", "en", None, 3, 1, 1)]
    out = stage(spark, spark.createDataFrame(odd, schema), sf_dir)
    assert len(out.collect()) <= 2 * len(odd) and (stage is corpus_pipeline.packing or out.columns == spark.createDataFrame([], schema).columns)


def test_run_gives_the_same_rows(spark, sf_dir, stages):
    got = Counter(map(str, corpus_pipeline.run(spark, sf_dir).select("doc_id", "n_tokens").collect()))
    assert got == Counter(map(str, stages[5].select("doc_id", "n_tokens").collect()))


def test_recall_and_precision_of_near_copies(spark):
    """Against all pairs of sf0.01: every near copy goes, and nothing else."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {min(rows[i][0] for i in g) for g in groups(rows)}
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    copies = len(rows) - len(want)
    assert len(got - want) <= 0.02 * copies and not want - got
