"""Vectors in the catalog."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscan.functions import vectors as vx
from folioscan.operators import dense
from folioscan.plans.backfill import HASHING_MODEL, backfill
from folioscan.sources.catalog import Catalog
from folioscan.sources.vector_store import vector_store
from tests.helpers import toy_embed, toy_factory


def small_catalog(spark, path):
    made = Catalog(spark, str(path), parts=2)
    chunks = spark.createDataFrame([
        ("d1-00000", "d1", 0, "the quick brown fox", "part 1", 4),
        ("d2-00000", "d2", 0, "invoice totals and payment terms", "page 1", 8),
    ], made.table("chunks").schema)
    made.replace("chunks", chunks, chunks.select("doc_id"))
    return made


def test_backfill_covers_every_chunk(embedded):
    assert embedded.written == embedded.table("chunks").count()
    assert embedded.table("chunk_embeddings").count() == embedded.written
    assert backfill(embedded, "toy-model", toy_factory) == 0


def test_model_lock(spark, tmp_path, caplog):
    made = small_catalog(spark, tmp_path)
    store = vector_store(made)
    assert store.locked_model() is None
    assert store.ensure_model("small") == "small"
    assert store.ensure_model("large") == "small"
    assert "locked" in caplog.text


def test_unknown_chunks_are_not_stored(spark, tmp_path):
    made = small_catalog(spark, tmp_path)
    items = spark.createDataFrame(
        [("d1-00000", [1.0, 0.0]), ("nope", [0.0, 1.0])], "chunk_id string, embedding array<float>")
    assert vector_store(made).upsert(items) == 1
    assert [r[0] for r in dense.unknown_chunks(made.table("chunks"), items).select("chunk_id").collect()] == ["nope"]
    assert [r["chunk_id"] for r in vector_store(made).missing_chunks().collect()] == ["d2-00000"]


def test_other_dimensions_are_refused(spark, tmp_path):
    made = small_catalog(spark, tmp_path)
    store = vector_store(made)
    schema = "chunk_id string, embedding array<float>"
    store.upsert(spark.createDataFrame([("d1-00000", [1.0, 0.0])], schema))
    with pytest.raises(ValueError):
        store.upsert(spark.createDataFrame([("d2-00000", [1.0, 0.0, 0.0])], schema))


def test_replacing_chunks_drops_their_vectors(spark, tmp_path):
    made = small_catalog(spark, tmp_path)
    assert backfill(made) == 2
    touched = spark.createDataFrame([("d1",)], "doc_id string")
    empty = made.table("chunk_embeddings").limit(0)
    made.replace("chunk_embeddings", empty, touched)
    assert vector_store(made).count() == 1
    assert [r[0] for r in vector_store(made).missing_chunks().select("chunk_id").collect()] == ["d1-00000"]
    assert backfill(made, doc_id="d2") == 0 and backfill(made, doc_id="d1") == 1
    assert vector_store(made).locked_model() == HASHING_MODEL


def test_failed_calls_leave_chunks_pending(spark, tmp_path):
    made = small_catalog(spark, tmp_path)

    def flaky(model):
        def call(texts):
            if any("invoice" in t for t in texts):
                raise RuntimeError("refused")
            return [toy_embed(t) for t in texts]
        return call

    assert backfill(made, "flaky", flaky) == 1
    assert backfill(made, "flaky", toy_factory) == 1


def test_hashing_embedder_equals_python(spark):
    texts = ["the quick brown fox", "Fox FOX fox", "", "é!? 42"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r[0] for r in df.select(vx.hashing_embedding(F.col("text"))).collect()]
    np.testing.assert_allclose(got, [toy_embed(t) for t in texts], rtol=1e-12)


@pytest.mark.parametrize("per_block", [1000, 3])
def test_batch_search_equals_brute_force(spark, per_block):
    rng = np.random.default_rng(0)
    vectors = rng.integers(-2, 3, (400, 6)).astype(float)
    queries = rng.integers(-2, 3, (9, 6)).astype(float)
    queries[4] = 0
    rows = spark.createDataFrame(
        [(f"c{i:03d}", f"d{i % 7}", v.tolist()) for i, v in enumerate(vectors)],
        "chunk_id string, doc_id string, embedding array<float>").repartition(5)
    table = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(queries)], "query_id bigint, embedding array<float>")
    found = dense.search_batch(rows, table, 5, per_block).collect()
    got = {(r["query_id"], r["rank"]): (r["chunk_id"], r["score"]) for r in found}
    expected = {}
    for q, query in enumerate(queries):
        with np.errstate(invalid="ignore", divide="ignore"):
            score = np.round(vectors @ query / np.linalg.norm(vectors, axis=1) / np.linalg.norm(query), 9)
        order = sorted((-s, f"c{i:03d}") for i, s in enumerate(score) if not np.isnan(s))[:5]
        expected |= {(q, k): (c, -s) for k, (s, c) in enumerate(order)}
    assert got.keys() == expected.keys()
    for key, (chunk, score) in expected.items():
        assert got[key][0] == chunk and got[key][1] == pytest.approx(score, abs=1e-8)


def test_batch_search_of_odd_rows(spark):
    schema = "chunk_id string, doc_id string, embedding array<float>"
    rows = spark.createDataFrame(
        [("a", "d", [1.0, 0.0]), ("b", "d", [0.0, 0.0]), ("c", "d", None), ("e", "d", [1.0])],
        schema)
    # The same id many times, more often than a block holds.
    table = spark.createDataFrame([(1, [2.0, 0.0])] * 7 + [(2, [0.0, 0.0]), (3, None)],
                                  "query_id bigint, embedding array<float>")
    found = dense.search_batch(rows, table, 2, per_block=3).collect()
    assert {(r["query_id"], r["chunk_id"], r["score"]) for r in found} == {(1, "a", 1.0)}
    assert dense.search_batch(rows.limit(0), table, 2).count() == 0
    assert dense.search_batch(rows, table.limit(0), 2).count() == 0


def test_batch_search_broadcasts_no_side(spark, tmp_path):
    rng = np.random.default_rng(3)
    path = str(tmp_path / "vectors")
    spark.createDataFrame(
        [(f"c{i:03d}", "d", v.tolist()) for i, v in enumerate(rng.normal(size=(300, 4)))],
        "chunk_id string, doc_id string, embedding array<float>").write.parquet(path)
    rows = spark.read.parquet(path)
    found = dense.search_batch(rows, rows.select(F.col("chunk_id").alias("query_id"), "embedding"), 1)
    assert "Broadcast" not in found._jdf.queryExecution().toString()
    assert all(r["query_id"] == r["chunk_id"] for r in found.collect())


def test_batch_search_in_many_cells(spark, monkeypatch):
    monkeypatch.setattr(dense, "QUERIES_SENT", 1)
    monkeypatch.setattr(dense, "VECTORS_PER_PART", 50)
    monkeypatch.setattr(dense, "QUERIES_PER_PART", 20)
    monkeypatch.setattr(dense, "ROWS_PER_PRODUCT", 16)
    rng = np.random.default_rng(4)
    vectors = rng.integers(-1, 2, (300, 4)).astype(float) + 0.5
    rows = spark.createDataFrame(
        [(None if i == 7 else f"c{i:03d}", "d", v.tolist()) for i, v in enumerate(vectors)],
        "chunk_id string, doc_id string, embedding array<float>").repartition(3)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors[:60])],
                                  "query_id bigint, embedding array<float>").repartition(2)
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    expected = {}
    for q, scores in enumerate(np.round(unit[:60] @ unit.T, 9)):
        order = sorted((-s, "" if i == 7 else f"c{i:03d}") for i, s in enumerate(scores))[:4]
        expected |= {(q, rank): chunk for rank, (_, chunk) in enumerate(order)}
    found = dense.search_batch(rows, table, 4, per_block=8).collect()
    assert {(r["query_id"], r["rank"]): r["chunk_id"] or "" for r in found} == expected
