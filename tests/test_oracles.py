"""Registered queries against their SQL. ALL_QUERIES=1 runs every one of them."""

import os

import pytest
from harness import compare, duck

from callweave.plans import registry

registry.load()
FOLDER = "/root/testdata/sf0.001"
QUICK = """worst_calls_and_why jn1_word_alignment wn1_merge_adjacent so1_all_violations fx1_fusion fx7_acoustic_emotion
ag12_document_summary ag12_call_summary ag18_prosody ag14_snr_by_silence ag19_silhouette_confidence wn12_sequence_decode
ag22_boundary_features ud3_frame_features ag17_band_power_drop wn13_moving_loudness io9_store_lookup st1_job_progress fx9_verdict_json
jn11_review_merge ag26_kappa""".split()
NAMES = sorted(registry.ORACLES) if os.environ.get("ALL_QUERIES") else QUICK


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, name, registry.QUERIES[name], registry.ORACLES[name], FOLDER) == ""


def test_every_oracle_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
