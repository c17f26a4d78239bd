"""The stored catalog: batches, commits, merging reads, compaction."""

import os
import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folioscan import schemas
from folioscan.operators import joins
from folioscan.plans.backfill import backfill
from folioscan.plans.ingest import ingest_folder
from folioscan.sources import catalog as module
from folioscan.sources.catalog import Catalog
from folioscan.sources.vector_store import vector_store


def files(root):
    return {str(p): p.stat().st_mtime_ns for p in Path(root).rglob("*.parquet")
            if "commits" not in p.parts and "catalog_meta" not in p.parts}


def chunks(spark, rows):
    return spark.createDataFrame(
        [(f"{d}-{i:05d}", d, i, text, "part 1", 1) for d, i, text in rows], schemas.CHUNKS)


def documents_of(rows, spark):
    return spark.createDataFrame([(d,) for d in rows], "doc_id string")


def test_a_change_writes_only_itself(spark, tmp_path):
    made = Catalog(spark, str(tmp_path), parts=4)
    first = chunks(spark, [(f"d{i}", 0, f"text {i} " * 50) for i in range(400)])
    made.replace("chunks", first, first.select("doc_id"))
    before = files(tmp_path)
    new = chunks(spark, [("d7", 0, "new"), ("d7", 1, "more")])
    made.replace("chunks", new, new.select("doc_id"))
    after = files(tmp_path)
    assert before.items() <= after.items()
    written = sum(os.path.getsize(f) for f in after.keys() - before.keys())
    assert written < sum(map(os.path.getsize, before)) / 3
    texts = {r.chunk_id: r.text for r in made.table("chunks").collect()}
    assert len(texts) == 401 and texts["d7-00000"] == "new" and texts["d7-00001"] == "more"
    assert {r.text for r in made.changes("chunks", 1).collect()} == {"new", "more"}
    assert all("batch=2" in f for f in made.changes("chunks", 1).inputFiles()
               if "/chunks/" in f)


def test_a_first_load_names_no_replaced_documents(spark, tmp_path):
    made = Catalog(spark, str(tmp_path), parts=1)
    for d in ("a", "b"):
        rows = chunks(spark, [(d, 0, d)])
        made.replace("chunks", rows, rows.select("doc_id"))
    assert [c.replaced for c in made.log()] == [0, 0]


def test_versions_read_as_they_were(spark, tmp_path):
    made = Catalog(spark, str(tmp_path), parts=2)
    for text in ("one", "two"):
        rows = chunks(spark, [("d", 0, text)])
        made.replace("chunks", rows, rows.select("doc_id"))
    made.replace("chunks", rows.limit(0), rows.select("doc_id"))
    states = [[r.text for r in made.table("chunks", v).collect()] for v in (1, 2, 3)]
    assert states == [["one"], ["two"], []]


def test_an_uncommitted_batch_is_invisible_and_overwritten(spark, tmp_path):
    made = Catalog(spark, str(tmp_path), parts=2)
    rows = chunks(spark, [("d", 0, "kept")])
    made.replace("chunks", rows, rows.select("doc_id"))
    with pytest.raises(RuntimeError), made.change() as change:
        change.replace("chunks", chunks(spark, [("d", 0, "lost"), ("e", 0, "lost")]),
                       documents_of(["d", "e"], spark))
        raise RuntimeError("executor lost")
    assert [r.text for r in made.table("chunks").collect()] == ["kept"]
    other = chunks(spark, [("f", 0, "next")])
    made.replace("chunks", other, other.select("doc_id"))
    assert {r.text for r in made.table("chunks").collect()} == {"kept", "next"}


def test_random_changes_equal_a_plain_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(module, "MOST_BATCHES", 3)
    rng = random.Random(4)
    made = Catalog(spark, str(tmp_path), parts=3)
    expected = {}
    for step in range(9):
        touched = rng.sample("abcdefgh", rng.randint(1, 4))
        rows = [(d, i, f"step {step}") for d in touched for i in range(rng.randint(0, 2))]
        made.replace("chunks", chunks(spark, rows), documents_of(touched, spark))
        expected = {k: v for k, v in expected.items() if k[0] not in touched}
        expected |= {(d, i): text for d, i, text in rows}
        found = {(r.doc_id, r.ordinal): r.text for r in made.table("chunks").collect()}
        assert found == expected
    assert any(c.merges for c in made.log()) and len(made.live()) <= 4
    gone = made.vacuum()
    assert gone and made.vacuum() == gone
    assert {(r.doc_id, r.ordinal): r.text for r in made.table("chunks").collect()} == expected


def test_compaction_leaves_a_large_base(spark, tmp_path):
    made = Catalog(spark, str(tmp_path), parts=2)
    base = chunks(spark, [(f"d{i}", 0, "base") for i in range(100)])
    made.replace("chunks", base, base.select("doc_id"))
    for i in range(3):
        rows = chunks(spark, [(f"d{i}", 0, f"new {i}")])
        made.replace("chunks", rows, rows.select("doc_id"))
    kept = {f: t for f, t in files(tmp_path).items() if "batch=1/" in f}
    before = sorted(map(tuple, made.table("chunks").collect()))
    assert made.compact() == [2, 3, 4] and [c.batch for c in made.live()] == [1, 5]
    assert sorted(map(tuple, made.table("chunks").collect())) == before
    assert kept.items() <= files(tmp_path).items()
    # The feed still knows when a row came.
    assert {r.text for r in made.changes("chunks", 3).collect()} == {"new 2"}
    assert made.compact(everything=True) == [1, 5] and made.compact() == []
    assert sorted(map(tuple, made.table("chunks").collect())) == before


def test_statistics_follow_replaced_documents(spark, tmp_path):
    made = Catalog(spark, str(tmp_path), parts=2)
    def store(rows):
        found = chunks(spark, [(d, 0, t) for d, t in rows])
        with made.change() as change:
            touched = found.select("doc_id")
            change.replace("chunks", found, touched)
            change.replace("postings", found.select(
                F.explode(F.split("text", " ")).alias("term"), "chunk_id", "doc_id",
                F.lit(1).alias("tf"), F.size(F.split("text", " ")).alias("len")), touched)
            made.refresh_statistics(change)

    store([("a", "x y"), ("b", "x z")])
    store([("b", "y w w2"), ("c", "x")])
    made.compact(everything=True)
    store([("a", "q")])
    terms = {r.term: r.df for r in made.table("term_stats").collect()}
    assert terms == {"y": 1, "w": 1, "w2": 1, "x": 1, "q": 1}
    assert tuple(made.table("corpus_stats").first()) == (3, 5)


def test_a_second_backfill_opens_no_old_chunks(spark, tmp_path):
    made = Catalog(spark, str(tmp_path), parts=2)
    rows = chunks(spark, [("a", 0, "first"), ("b", 0, "second")])
    made.replace("chunks", rows, rows.select("doc_id"))
    assert backfill(made) == 2
    assert not [f for f in vector_store(made).missing_chunks().inputFiles() if "/chunks/" in f]
    more = chunks(spark, [("c", 0, "third")])
    made.replace("chunks", more, more.select("doc_id"))
    opened = [f for f in vector_store(made).missing_chunks().inputFiles() if "/chunks/" in f]
    assert opened and all("batch=3" in f for f in opened)
    assert backfill(made) == 1 and backfill(made) == 0
    assert made.table("chunk_embeddings").count() == 3


@pytest.mark.parametrize("way", ["broadcast", "digests", "joined"])
def test_replaced_rows_are_found_in_every_way(spark, tmp_path, monkeypatch, way):
    if way != "broadcast":
        monkeypatch.setattr(joins, "is_small", lambda *_: False)
    if way == "joined":
        monkeypatch.setattr(joins, "HELD_KEYS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made, expected, rng = Catalog(spark, str(tmp_path), parts=2), {}, random.Random(7)
        for step in range(3):
            touched = rng.sample(["a", "b", "c", "ä", ""], 3)
            rows = [(d, 0, f"step {step}") for d in [*touched[1:], None]]
            with made.change() as change:
                found = chunks(spark, rows)
                change.replace("chunks", found, documents_of(touched, spark))
                change.replace("postings", found.selectExpr(
                    "text term", "chunk_id", "doc_id", "1 tf", "1 len"),
                    documents_of(touched, spark), placed=True)
                made.refresh_statistics(change)
            expected = {k: v for k, v in expected.items() if k[0] not in touched}
            expected |= {(d, step if d is None else 0): text for d, _, text in rows}
        table = made.table("chunks")
        found = [(r.doc_id, int(r.text[-1]) if r.doc_id is None else 0, r.text)
                 for r in table.collect()]
        assert sorted(found, key=str) == sorted(((*k, v) for k, v in expected.items()), key=str)
        terms = {r.term: r.df for r in made.table("term_stats").collect()}
        assert terms == Counter(expected.values())
        plan = table._jdf.queryExecution().executedPlan().toString()
        # The stored rows themselves are shuffled only if there are too many documents.
        assert ("SortMergeJoin" in plan) == (way == "joined")
        kept = joins.with_key(table, documents_of(["a", "ä", None], spark), "doc_id")
        assert {r.doc_id for r in kept.collect()} == {d for d, _ in expected} & {"a", "ä"}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_postings_are_written_where_their_chunks_are_read(spark, tmp_path, monkeypatch):
    (tmp_path / "files").mkdir()
    for i in range(3):
        (tmp_path / "files" / f"{i}.txt").write_text(f"heron number {i} wades\n")
    kind, moved = type(spark.range(1)), []
    before = kind.hint
    monkeypatch.setattr(kind, "hint", lambda self, *a: moved.append(self.columns) or before(self, *a))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    made = Catalog(spark, str(tmp_path / "catalog"), parts=2)
    ingest_folder(made, str(tmp_path / "files"), effort="low")
    assert any("locator" in c for c in moved)
    assert not any("tf" in c or "df" in c for c in moved)
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == size
    assert {r.term: r.df for r in made.table("term_stats").collect()}["heron"] == 3
    assert made.table("postings").filter("term = 'heron'").count() == 3


def test_a_commit_compares_vectors_of_its_parts_only(spark, tmp_path):
    made = Catalog(spark, str(tmp_path), parts=2)
    rows = chunks(spark, [(f"d{i}", 0, f"text {i}") for i in range(20)])
    made.replace("chunks", rows, rows.select("doc_id"))
    store = vector_store(made)
    store.ensure_model("hashing-64")
    first = store.missing_in_parts(0, 0, 2)
    some = first.count()
    assert 0 < some < 20
    store.upsert(first.select("chunk_id", F.array(*[F.lit(1.0)] * 64).alias("embedding")))
    assert store.missing_in_parts(0, 0, 2).count() == 0
    rest = store.missing_in_parts(1, 1, 2)
    assert "Join" not in rest._jdf.queryExecution().optimizedPlan().toString()
    assert rest.count() == 20 - some == store.missing_chunks().count()
    assert backfill(made, parts_per_commit=1) == 20 - some
