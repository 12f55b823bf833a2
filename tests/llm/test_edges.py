"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest

from actloom.llm import common
from actloom.llm.chat_format import answer_pairs, gather_turns, preference_format
from actloom.llm.exact_dedup import exact_dedup
from actloom.llm.license_scan import license_scan
from actloom.llm.line_dedup import drop_lines, line_bitmaps, line_dedup
from actloom.llm.mixing import mix, mixed_documents
from actloom.llm.packing import pack
from actloom.llm.quality_classifier import keep_good, quality_scores
from actloom.llm.quality_rules import quality_rules
from actloom.llm.simhash_dedup import simhash_components
from actloom.llm.substring_dedup import substring_dedup

LONG = "word " * 60_000
SCHEMA = "text string, doc_id long, source string, lang string, n_chars long, id long, key string, bucket int, fp long, size int, kept boolean, body string"
ROWS = [
    (None, 1, "a", "en", None), ("", 2, None, None, 0), (" \t\n", 3, "a", "en", 3), ("x", 3, "a", "en", 1), ("x", 3, "a", "en", 1), ("x", None, None, "de", 1), ("x", None, None, "de", 1),
    (LONG, 4, "b", "en", len(LONG)), ("ünï çødé 文字", 5, "b", "", 9), ("All rights reserved.", 6, "c", "en", 20), ("plain words in a line that is long enough to count\n" * 3, 7, "c", "fr", 5),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, 9, "k", 1, 2, 3, True, "b") for r in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0, "x"), (7, 1, None, "x"), (6, 1, 1, "x"), (None, 1, 0, "x"), (3, 0, 0, "x"), (5, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")


def operators(labels):
    return {
        "license_scan": license_scan, "quality_rules": quality_rules, "mix": mix, "exact_dedup": exact_dedup, "substring_dedup": substring_dedup,
        "simhash": simhash_components, "pack": pack, "line_dedup": line_dedup, "quality_scores": lambda d: quality_scores(d, labels),
    }


NAMES = sorted(operators(None))


@pytest.mark.parametrize("name", NAMES)
def test_a_row_for_every_row(docs, labels, name):
    out = operators(labels)[name](docs)
    rows = out.collect()
    assert len(rows) == len(ROWS)
    key = "id" if name == "quality_scores" else "doc_id"
    assert sorted(str(r[key]) for r in rows) == sorted(str(r[1]) for r in ROWS)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, labels, name):
    empty = spark.createDataFrame([], SCHEMA)
    assert operators(labels)[name](empty).collect() == []


@pytest.mark.parametrize("name", NAMES)
def test_reruns_agree(docs, labels, name):
    run = lambda: sorted(map(str, operators(labels)[name](docs.repartition(2)).collect()))
    assert run() == run()


def test_stages_keep_the_columns(docs, labels):
    assert keep_good(docs, labels).columns == docs.columns
    kept = drop_lines(docs, line_bitmaps(docs))
    assert kept.columns == docs.columns and kept.count() == len(ROWS)
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    mixed.collect()


def test_chat_edges(spark):
    turns = [(1, 0, "user", "hi", 9), (1, 1, "assistant", None, 9), (0, 0, None, "hi", 9), (0, 1, "assistant", "yes", 9), (0, 1, "assistant", "yes", 9), (None, 0, "user", "x", 9), (4, 0, "user", "alone", 9), (None, None, None, None, 9)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, chosen int")
    rows = {r.pair_id: r for r in preference_format(answer_pairs(df)).collect()}
    assert set(rows) == {0, 1}
    assert rows[0].n_prompt_turns == 1 and rows[0].prompt == "<||>\nhi<|end|>\n" and rows[0].chosen.count("yes") == 2
    same = spark.createDataFrame([(7, c, i, "user", "a") for c in (True, False) for i in range(3)] + [(8, True, 0, "user", "a")], "pair_id long, chosen boolean, turn long, role string, text string")
    (r,) = preference_format(gather_turns(same)).collect()
    assert (r.pair_id, r.n_prompt_turns, r.chosen, r.rejected, r.chosen_spans) == (7, 3, "", "", [])
    assert preference_format(gather_turns(spark.createDataFrame([], same.schema))).collect() == []


def test_equal_answers_make_no_pair_and_long_turns_stay_whole(spark):
    long = "a long turn " * (10 << 20 >> 3)
    turns = [(2, 0, "user", "q"), (2, 1, "assistant", "same"), (3, 0, "user", "p"), (3, 1, "assistant", "same"), (4, 0, "user", "q"), (4, 1, "assistant", long), (5, 0, "user", "q"), (5, 1, "assistant", None)]
    rows = {r.pair_id: r for r in preference_format(answer_pairs(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).collect()}
    assert set(rows) == {4, 5}
    assert long in rows[4].chosen and rows[4].rejected == "<|assistant|>\n<|end|>\n" and rows[5].rejected == rows[4].chosen


def test_spans_cover_the_assistant(spark):
    rows = [(1, True, 0, "user", "q"), (1, True, 1, "assistant", "good"), (1, True, 2, "user", "more"), (1, True, 3, "assistant", "fine"), (1, False, 0, "user", "q"), (1, False, 1, "assistant", "bad")]
    (r,) = preference_format(gather_turns(spark.createDataFrame(rows, "pair_id long, chosen boolean, turn long, role string, text string"))).collect()
    assert [r.chosen[s.start : s.end] for s in r.chosen_spans] == ["good<|end|>\n", "fine<|end|>\n"]
    assert [r.rejected[s.start : s.end] for s in r.rejected_spans] == ["bad<|end|>\n"]


def test_the_shared_folder_is_the_named_one(spark):
    class Conf:
        def get(self, key, default=None):
            return "file:///named/" if key == "spark.checkpoint.dir" else default

    class Session:
        conf = Conf()

    assert common.shared_dir(Session()) == "file:///named"
