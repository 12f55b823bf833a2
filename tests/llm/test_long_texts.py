"""Texts of 50 MB in one row beside short ones: operators work in pieces and agree with the plain way."""

import resource

import pytest

from actloom.llm import common
from actloom.llm.common import word_pieces
from actloom.llm.line_dedup import line_dedup
from actloom.llm.near_copies import near_copy_rows, shingles
from actloom.llm.packing import pack
from actloom.llm.quality_rules import base_counts, quality_rules
from actloom.llm.simhash_dedup import fingerprint, simhash_components

from .test_simhash_dedup import print_of

TEXT = "some words of a line that is long enough\n" * (50 << 20 >> 5) + "END"


def test_pieces_change_nothing(monkeypatch):
    text = ("Ab\u00e9 c\td  e\x0bf\n" * 300 + "x" * 900 + " \n\n y z").encode()
    whole = base_counts(text), fingerprint(text), shingles(text).tolist()
    for size in (1, 7, 100, 1000):
        monkeypatch.setattr(common, "PIECE", size)
        assert sum(word_pieces(text), []) == text.split()
        assert (base_counts(text), fingerprint(text), shingles(text).tolist()) == whole
    assert whole[1] == print_of(text.decode())


@pytest.mark.parametrize("operator", [quality_rules, simhash_components, near_copy_rows, line_dedup, pack])
def test_long_text(spark, operator):
    rows = [(1, TEXT, "a"), (2, "short", "a"), (3, "some words of a line that is long enough", "a")]
    out = operator(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted(r.doc_id for r in out) == [1, 2, 3]


def test_a_long_text_takes_few_times_its_size():
    """The scan of one 50 MB text in this process, by the greatest resident size before and after."""
    body = TEXT.encode()
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    fingerprint(body)
    grown = (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024
    assert grown < 4 * len(body) / 1e6
