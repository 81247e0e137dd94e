"""Every corpus query over texts that repeat something tens of thousands of times: no overflow, and a row for each document."""

from pathlib import Path

import pytest

import corpus_pipeline
from tamarack.llm import queries
from tests import long_texts

SOURCE = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    if not SOURCE.exists():
        pytest.skip("no tables here")
    folder = str(tmp_path_factory.mktemp("long"))
    long_texts.write(spark, str(SOURCE), folder)
    return folder


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_survives(spark, folder, name):
    n = len(queries.QUERIES[name](spark, folder).collect())
    assert n == len(long_texts.TEXTS) if name not in ("op1_decontamination", "op6_fixity") else n >= 0


def test_pipeline_survives(spark, folder):
    assert 0 < corpus_pipeline.run(spark, folder).count() < len(long_texts.TEXTS)
