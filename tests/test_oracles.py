"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import importlib
import os

import pytest

from oracle_check import check, connect
from reelgrid.plans import load_all
from reelgrid.plans.registry import ORACLES, QUERIES

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
load_all()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


#: Queries that SQL can't say (difflib ratios, packed chunks, model input, screen tiles), and where
#: their operators are held against brute force.
WITHOUT_TWIN = {
    "ag39_stable_boxes": "test_repairs.test_boxes_equal_brute_force", "dd5_nms": "test_repairs.test_boxes_equal_brute_force",
    "jn11_align_cues": "test_scale.test_align_repeats_take_the_nearest_interval", "jn12_coverage_report": "test_functions.test_coverage_reports_missing_and_drift",
    "jn12_coverage_rows": "test_repairs.test_a_run_over_a_gap_covers_its_cues", "jn9_leak_suspects": "test_search.test_lines_of_the_band_leak",
    "rt10_chunk_search": "test_search.test_best_chunk_counts", "rt19_embed": "test_search.test_vectors_come_from_the_function", "rt7_chunk_paragraphs": "test_functions.test_chunk_paragraphs_against_a_loop",
    "rt9_chunk_lines": "test_functions.test_chunk_lines", "sc11_text_similarity": "test_search.test_similarity_of_captions", "wn14_frames_to_intervals": "test_search.test_runs_of_similar_text",
    "wn9_merge_flicker": "test_functions.test_flicker_fixture",
}


def test_every_query_has_a_twin_or_a_test():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == set(WITHOUT_TWIN)
    for where in set(WITHOUT_TWIN.values()):
        module, name = where.split(".")
        assert callable(getattr(importlib.import_module(module), name))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    message, _, _ = check(spark, con, SF, name)
    assert message == ""
