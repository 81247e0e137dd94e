"""Every engine query over texts that repeat something tens of thousands of times: no overflow, no row lost."""

from pathlib import Path

import pytest

from tamarack.plans import registry
from tests import long_texts

SOURCE = Path("/root/testdata/sf0.001")
NO_TEXTS = {"bounded_shortlist", "two_band_rerank", "rank_change_audit", "weighted_score", "strict_adjust", "calibrated_score", "piecewise_penalty", "hireability_signals", "event_json_props", "ablation_overlap", "validator_checks", "breakdown_checks", "windowed_stream_counts"}
A_ROW_EACH = {"phrase_density", "token_stats", "clean_text_basic", "sentence_snippets", "sha_digest", "tfidf_similarity", "html_strip_clean", "fingerprint_profiles", "score_profiles", "audit_profiles"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    if not SOURCE.exists():
        pytest.skip("no tables here")
    folder = str(tmp_path_factory.mktemp("long"))
    long_texts.write(spark, str(SOURCE), folder)
    return folder


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - NO_TEXTS))
def test_query_survives(spark, folder, name):
    n = len(registry.QUERIES[name](spark, folder).collect())
    assert n == len(long_texts.TEXTS) if name in A_ROW_EACH else n >= 0
