"""File layouts, page trees, the pushing sink, list state and written rounds."""

import json

import pytest
from pyspark.sql import functions as F

from actloom.plans import arena
from actloom.queries.files import _pdf
from actloom.sources import push, readers
from actloom.sources.pdf import page_count
from actloom.streaming import ledger


def test_layouts_by_file(spark, tmp_path):
    texts = {
        "array.json": '\n [{"a": 1},\n {"a": 2}]', "lines.json": '{"a": 3}\n\n{"a": 4}\n', "one.json": '{\n "a": 5\n}', "line.json": '{"a": 6}', "short.json": '[{"a": 7}, {"a": 8}]', "empty.json": "", "blank.json": "\n  \n",
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    got = sorted(r.a for r in readers.sniff_records(spark, f"file://{tmp_path}", "a int").collect())
    assert got == [1, 2, 3, 4, 5, 6, 7, 8]
    whole = {r.file.rsplit("/", 1)[1]: r.whole for r in readers.file_layouts(spark, f"file://{tmp_path}").collect()}
    assert whole == {"array.json": True, "lines.json": False, "one.json": True, "line.json": False, "short.json": True}


def test_layout_of_a_file_in_many_splits(spark, tmp_path):
    (tmp_path / "big.json").write_text("\n".join(['{"a": 0}', *(f'{{"a": {i},' + f'"b": "{"x" * 200}"}}' for i in range(1, 3000))]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        assert readers.sniff_records(spark, f"file://{tmp_path}", "a int").agg(F.count("a"), F.sum("a")).first()[:] == (3000, 2999 * 3000 // 2)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("pages", [1, 2, 9, 10, 11, 105])
def test_compressed_page_trees(pages):
    assert page_count(_pdf(pages).encode()) == pages


def test_page_trees():
    plain = b"1 0 obj <</Type/Catalog /Pages 2 0 R>> endobj 2 0 obj <</Type/Pages /Kids [3 0 R 4 0 R]>> endobj 3 0 obj <</Type /Page>> endobj 4 0 obj <</Type/Pages /Kids 7 0 R>> endobj 5 0 obj <</Type/Page>> endobj 7 0 obj [5 0 R 2 0 R] endobj trailer <</Root 1 0 R>>"
    assert page_count(plain) == 2  # a loop in the tree ends
    # a later version of an object counts, a page that no tree holds does not
    assert page_count(plain + b" 7 0 obj [5 0 R 6 0 R] endobj 6 0 obj <</Type/Page>> endobj 8 0 obj <</Type/Page>> endobj") == 3
    assert page_count(b"/Type /Pages\n/Type /Page\n/Type/Page>>") == 2 and page_count(None) == page_count(b"junk") == 0
    assert page_count(b"1 0 obj <</Type/ObjStm/N 1/First 4/Filter/FlateDecode>>\nstream\nnot deflated\nendstream\nendobj") == 0


def test_a_replayed_epoch_is_pushed_once(spark, tmp_path):
    target = f"{tmp_path}/out"
    writer = push.PushWriter(target, "move")
    for epoch, rows in ((0, ["a", "b"]), (0, ["a", "b"]), (1, ["c"]), (2, [])):
        messages = [writer.write(iter([(json.dumps({"v": v}),) for v in rows])), None]
        writer.commit(messages, epoch)
    writer.abort([writer.write(iter([('{"v": "lost"}',)])), None], 3)
    writer.write(iter([('{"v": "of a task that was tried again"}',)]))
    got = sorted((r.event, json.loads(r.data)["v"]) for r in push.pushed(spark, f"file://{target}").collect())
    assert got == [("move", "a"), ("move", "b"), ("move", "c")]


def test_a_restarted_stream_pushes_each_row_once(spark, tmp_path):
    source, target, check = (f"file://{tmp_path}/{n}" for n in ("in", "out", "check"))
    for some in ([1, 2], [3]):
        spark.createDataFrame([(i,) for i in some], "i int").write.mode("append").parquet(source)
        push.push(spark.readStream.schema("i int").parquet(source), target, "n", check).awaitTermination()
    assert sorted(r.data for r in push.pushed(spark, target).collect()) == ['{"i":1}', '{"i":2}', '{"i":3}']


def test_a_retried_batch_replaces_itself(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "x int")
    for _ in range(2):
        ledger.kept_by_batch(df, 4, f"file://{tmp_path}/out")
    assert [tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()] == [(1, 4)]


def test_limited_rounds_read_what_the_last_one_left(spark):
    threads = spark.createDataFrame([(f"i{n}", n, "ok") for n in range(5)], "issue_id string, pos int, status string")
    for rounds in (2, 5):
        plan = arena.run_rounds(threads, rounds, per_round=2)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation") == rounds  # one written table a round


def test_summaries_keep_texts(spark):
    moves = [
        (1, "Reviewer", "ok", "request", "O1", ["why?", "", None], None), (2, "Author", "missing", "evidence_response", "O2", None, ["will add"]),
        (3, "Author", "ok", "evidence_response", "O3", ["lost"], []), (4, "Reviewer", "fail", "clarification", None, ["how?"], None), (5, "Reviewer", "ok", "close", "O5", None, None), (6, "Author", "ok", "x", "O6", None, ["no"]),
    ]
    df = spark.createDataFrame([("t", *m) for m in moves], "thread_id string, event_id int, role string, status string, action_type string, observation string, requests array<string>, commitments array<string>")
    got = arena.summaries(df, "thread_id", ["event_id"]).first()
    assert got[:] == ("t", "Closed", 1, ["O1", "O3", "O5"], ["how?"], ["will add"], "Reviewer", 5)


def test_library_index(spark, tmp_path):
    rows = ['{"name": "a", "kind": "skill", "code_path": "x", "needs": ["b", "z"]}', '{"name": "b", "kind": "primitive", "code_path": "y"}', '{"name": "", "kind": "skill", "code_path": "x"}', '{"name": "c", "kind": "skill"}']
    (tmp_path / "one.jsonl").write_text("\n".join(rows))
    got = {r.name: (r.kind, r.missing) for r in readers.read_library(spark, f"file://{tmp_path}").collect()}
    assert got == {"a": ("skill", ["z"]), "b": ("primitive", [])}
    (tmp_path / "two.jsonl").write_text('{"name": "b", "kind": "skill", "code_path": "w"}')
    assert {r.name: r.code_path for r in readers.read_library(spark, f"file://{tmp_path}", last_wins=True).collect()} == {"a": "x", "b": "w"}
    with pytest.raises(Exception, match="duplicate artifact b"):
        readers.read_library(spark, f"file://{tmp_path}").collect()
