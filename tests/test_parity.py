"""A few registered queries against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as contract
from checks.parity import connect, difference

SF_DIR = "/root/testdata/sf0.001"
NAMES = ["text_chunks", "html_chunks", "keyword_tags", "bm25_filtered", "hybrid_filtered",
         "upsert_documents", "remote_listing", "prompt_routing", "manifest_blocks"]


def test_every_query_has_sql():
    from checks import registry

    assert set(registry.ORACLES) == set(registry.QUERIES)
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    ours = contract.queries()[name](spark, SF_DIR).toPandas()
    theirs = connect(SF_DIR).execute(contract.oracle_sql()[name]).fetchdf()
    assert len(ours) and difference(ours, theirs) is None
