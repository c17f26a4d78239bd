"""The registered queries: SQL where there is some, and the pipeline's effects."""

import os

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from checks.parity import connect, difference
from folioscan.llm import queries

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(llm, name):
    ours = contract.queries()[name](llm, SF_DIR).toPandas().astype(object)
    theirs = connect(SF_DIR).execute(contract.oracle_sql()[name]).fetchdf().astype(object)
    ours, theirs = ours.where(ours.notna(), None), theirs.where(theirs.notna(), None)
    assert len(ours) and difference(ours, theirs) is None


def test_all_operators_and_the_pipeline():
    numbers = {int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")}
    assert numbers == set(range(1, 14)) and "pipeline" in contract.queries()


def test_pipeline_stages(llm):
    docs = llm.read.parquet(f"{SF_DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(llm, docs, SF_DIR).cache()
        assert kept.columns == docs.columns
        assert 0.5 * docs.count() < kept.count() <= docs.count()
        assert not kept.select("doc_id").exceptAll(docs.select("doc_id")).count()
        docs = kept
    encoded = corpus_pipeline.STAGES[-1][1](llm, docs, SF_DIR)
    whole = corpus_pipeline.run(llm, SF_DIR)
    assert whole.exceptAll(encoded).count() == 0 and whole.count() == docs.count()
