"""A fast subset of the driver's correctness gate: Spark query vs DuckDB oracle."""

import pytest

from conftest import SF01
from harness import compare, duck

import __spark_entry__ as E

FAST = ["k2_minimum_slice", "c1_ssl_split", "c3_ssl_split_longtail", "c12_epoch_sample", "c14_weighted_sample_replacement",
        "e2_mask_relative", "e3_mask_flex", "e4_mask_selfadaptive", "e5_weight_soft_per_class", "e7_mask_adsh",
        "f1_align_ema", "f2_align_queue", "f7_smooth_bank", "g7_contrast", "g8_fairness", "l5_confusion", "l9_mean_std",
        "h2_crest_pick", "a1_read_views", "s1_stream_align"]


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


@pytest.mark.parametrize("name", FAST)
def test_matches_oracle(spark, con, name):
    r = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], SF01)
    assert r["hash_match"], r
