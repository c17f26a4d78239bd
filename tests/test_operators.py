"""Fusion, tags, listing, prompts, manifest, upserts, readers and streams."""

import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioscan import schemas
from folioscan.operators import fusion, joins, listing, manifest, prompts, tags, upserts
from folioscan.operators.running import running_before
from folioscan.plans.backfill import HASHING_MODEL
from folioscan.plans.ingest import ingest_staged
from folioscan.plans.knowledge_base import write_index
from folioscan.sources.catalog import Catalog
from folioscan.sources.delimited import read_delimited
from folioscan.streaming.incremental import backfill_stream, ingest_stream


def ranked(spark, rows):
    df = spark.createDataFrame(rows, "query_id int, chunk_id string, doc_id string, score double")
    return fusion.with_rank(df)


def test_fusion_rewards_agreement(spark):
    words = ranked(spark, [(1, "solo", "a", 99.0), (1, "both", "b", 98.0)])
    dense = ranked(spark, [(1, "other", "c", 0.9), (1, "both", "b", 0.8)])
    rows = fusion.fuse(words, dense, 10).orderBy("rank").collect()
    assert [r["chunk_id"] for r in rows] == ["both", "solo", "other"]
    assert rows[0]["score"] == pytest.approx(2 / 61) and rows[1]["score"] == pytest.approx(1 / 60)


def test_fusion_limit_and_ties(spark):
    words = ranked(spark, [(1, c, "d", s) for c, s in (("w0", 3.0), ("w1", 2.0))])
    dense = ranked(spark, [(1, c, "d", s) for c, s in (("v0", 3.0), ("v1", 2.0))])
    rows = fusion.fuse(words, dense, 3).orderBy("rank").collect()
    assert [r["chunk_id"] for r in rows] == ["w0", "v0", "w1"]


def test_keyword_tags(spark):
    chunks = spark.createDataFrame([
        ("d", 0, "Channel channel gravel gravel gravel the the and 123 silting"),
        ("d", 1, "zeta alpha zeta-1"),
    ], "doc_id string, ordinal int, text string")
    rows = tags.keyword_tags(chunks, 5).orderBy("tag_rank").collect()
    assert [r["tag"] for r in rows] == ["gravel", "channel", "silting", "zeta", "alpha"]


def test_keywords_move_no_term_of_a_whole_document(spark, monkeypatch):
    monkeypatch.setattr(tags, "PIECE_CHUNKS", 2)
    words = ["heron", "ferry", "pier", "quay", "tide", "crane", "buoy", "The", "x-ray_1", "ab"]
    draw = random.Random(3)
    rows = [(d, o, " ".join(draw.choices(words, k=12)) if o else None)
            for d, n in (("a", 1), ("b", 2), ("long", 7), (None, 3)) for o in range(n)]
    rows += [("gap", 0, "quay tide"), ("gap", 9, "tide Crane"), ("twice", 0, "pier"), ("twice", 0, "buoy pier")]
    chunks = spark.createDataFrame(rows, "doc_id string, ordinal int, text string")
    counts, firsts = Counter(), {}
    for doc, ordinal, text in rows:
        found = re.findall("[a-z][a-z0-9_-]{2,}", (text or "").lower())
        for i, w in enumerate(w for w in found if w != "the"):
            counts[doc, w] += 1
            place = (ordinal << 32) + i
            firsts[doc, w] = min(place, firsts.get((doc, w), place))
    got = {(r["doc_id"], r["term"]): (r["n"], r["first"]) for r in tags.term_frequencies(chunks).collect()}
    assert got == {key: (n, firsts[key]) for key, n in counts.items()}
    ranked = sorted(counts, key=lambda key: (-counts[key], firsts[key]))
    for r in tags.keyword_tags(chunks, 3).collect():
        of_doc = [w for d, w in ranked if d == r["doc_id"]]
        assert of_doc[r["tag_rank"] - 1] == r["tag"] or r["doc_id"] == "twice"
    # A document of one piece sends its first terms only, and no term meets another shuffle.
    short = chunks.filter("doc_id = 'b'")
    assert tags.term_frequencies(short, 3).count() == 3 < tags.term_frequencies(short).count()


def high_tier(spark, tag):
    chunks = spark.createDataFrame([("d", 0, "quarterly revenue revenue"), ("other", 0, "x")],
                                   "doc_id string, ordinal int, text string")
    summaries, tagged = tags.enrich(
        chunks, "high", lambda m: lambda xs: [f"{m}: short" for _ in xs], tag)
    return ({r["doc_id"]: r["summary"] for r in summaries.collect()},
            {(r["doc_id"], r["tag"]) for r in tagged.collect()})


def test_high_tier_uses_models(spark):
    summaries, tagged = high_tier(spark, lambda m: lambda xs: [[" Alpha ", "", "beta", "alpha"] for _ in xs])
    assert summaries == {d: "claude-sonnet-4-6: short" for d in ("d", "other")}
    assert tagged == {(d, t) for d in ("d", "other") for t in ("alpha", "beta")}


def test_failed_tags_fall_back(spark):
    def broken(model):
        def call(texts):
            raise RuntimeError("down")
        return call

    assert high_tier(spark, broken)[1] == {("d", "revenue"), ("d", "quarterly")}


def test_low_tier_calls_no_model(spark):
    def forbidden(model):
        raise AssertionError("called")

    chunks = spark.createDataFrame([("d", 0, "revenue growth revenue")], "doc_id string, ordinal int, text string")
    summaries, tagged = tags.enrich(chunks, "low", forbidden, forbidden)
    assert [r["summary"] for r in summaries.collect()] == [None]
    assert {r["tag"] for r in tagged.collect()} == {"revenue", "growth"}


def test_listing(spark):
    google = "application/vnd.google-apps."
    listed = spark.createDataFrame([
        ("i1", "My Doc", google + "document", "m1"), ("i2", "Budget", google + "spreadsheet", "m"),
        ("i3", "Deck", google + "presentation", "m"), ("i4", "report.xlsx", "application/x", "m"),
        ("i5", "archive.zip", "application/zip", "m"), ("i6", "Form", google + "form", "m"),
        ("i7", "t.txt", "text/plain", "NA"), ("i8", "dir", google + "folder", "m"), ("NA", "x.txt", "t", "m"),
    ], "id string, name string, mime string, modified string")
    known = spark.createDataFrame([("i1", "m1"), ("i2", "old")], "source_id string, source_modified string")
    planned = listing.plan_listing(listing.clean_listing(listed), known)
    rows = {r["source_id"]: (r["export_type"], r["filename"], r["status"]) for r in planned.collect()}
    assert rows == {
        "i1": ("docx", "i1__My Doc.docx", "unchanged"), "i2": ("xlsx", "i2__Budget.xlsx", "staged"),
        "i3": ("pdf", "i3__Deck.pdf", "staged"), "i4": (None, "i4__report.xlsx", "staged"),
        "i5": (None, None, "unsupported"), "i6": (None, None, "unsupported"),
        "i7": (None, "i7__t.txt", "staged"),
    }
    totals = listing.listing_totals(planned).first()
    assert tuple(totals) == (7, 4, 1, 2)


def test_staged_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "i7__t.txt").write_text("remote text")
    listed = spark.createDataFrame([("i7", "t.txt", "text/plain", "v1")],
                                   "id string, name string, mime string, modified string")
    empty = listed.limit(0).selectExpr("id AS source_id", "modified AS source_modified")
    made = Catalog(spark, str(tmp_path / "cat"), parts=1)
    assert ingest_staged(made, listing.plan_listing(listed, empty), str(tmp_path / "in")).documents == 1
    row = made.table("documents").first()
    assert (row["source"], row["source_id"], row["source_modified"]) == ("gdrive", "i7", "v1")
    assert row["path"] == "https://drive.google.com/open?id=i7"


def test_prompts(spark):
    df = spark.createDataFrame([("short prompt",), (" ".join(["word"] * 60),), ("bad " * 60,), ("",)], "text string")

    def rewriter(model):
        def call(texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("down")
            return [" word word \n" for _ in texts]
        return call

    rows = {r["original_words"]: r for r in prompts.route_prompts(df, rewrite=rewriter).collect() if "bad" not in r["text"]}
    assert rows[2]["method"] == "passthrough" and rows[2]["reduction_pct"] == 0.0
    assert rows[0]["reduction_pct"] == 0.0
    assert rows[60]["method"] == "llm-rewrite" and rows[60]["final"] == "word word"
    assert rows[60]["reduction_pct"] == round((1 - 2 / (299 // 4)) * 100, 1)
    failed = prompts.route_prompts(df.filter("text LIKE 'bad%'"), rewrite=rewriter).first()
    assert failed["method"] == "passthrough (rewrite failed)" and failed["final"] == failed["text"]


def test_upserts(spark):
    empty = spark.createDataFrame([], schemas.DOCUMENTS)
    one = spark.createDataFrame([("d", "/a", "a.csv")], "doc_id string, path string, filename string")
    first = upserts.upsert_documents(empty, one)
    second = upserts.upsert_documents(first, one.withColumn("title", F.lit("updated")))
    rows = second.collect()
    assert len(rows) == 1 and rows[0]["title"] == "updated"
    assert (rows[0]["status"], rows[0]["source"]) == ("active", "local")
    labels = upserts.tag_rows(spark.createDataFrame([("d", ["finance", "q1", "finance"])], "doc_id string, tags array<string>"))
    assert [r["tag"] for r in labels.collect()] == ["finance", "q1"]


def test_running_totals_of_a_hot_key(spark):
    df = spark.range(0, 1000).select((F.col("id") * 3).alias("at"), F.when(F.col("id") < 900, "hot").otherwise("b").alias("k"))
    got = running_before(df.repartition(7), ["k"], "at", weight=F.col("at"), name="s", first_of="at", total="t", width=64)
    seen = {(r["k"], r["at"]): (r["s"], r["first_at"], r["t"]) for r in got.collect()}
    for key, positions in (("hot", range(0, 2700, 3)), ("b", range(2700, 3000, 3))):
        for at in positions:
            assert seen[key, at] == (sum(range(positions[0], at, 3)), positions[0], sum(positions))


def test_a_rewritten_file_is_replaced_by_the_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("stays as it is")
    (folder / "b.txt").write_text("before")
    made = Catalog(spark, str(tmp_path / "c"), parts=2)
    known = []
    for _ in range(3):
        ingest_stream(made, str(folder), str(tmp_path / "s")).awaitTermination()
        known.append({r["filename"]: r["doc_id"] for r in made.table("documents").collect()})
        if len(known) == 1:
            (folder / "b.txt").write_text("after, and longer")
            os.utime(folder / "b.txt", (2e9, 2e9))
    assert {r["text"] for r in made.table("chunks").collect()} == {
        "stays as it is", "after, and longer"}
    assert known[0]["a.txt"] == known[1]["a.txt"] and known[0]["b.txt"] != known[1]["b.txt"]
    assert known[1] == known[2]


@pytest.mark.parametrize("how", ["inner", "left_semi"])
def test_salted_join_equals_broadcast_join(spark, how):
    big = spark.range(500).select("id", F.when(F.col("id") < 400, 1).otherwise(F.col("id") % 7).alias("k"))
    small = spark.createDataFrame([(1, "a"), (2, "b"), (9, "c")], "k bigint, v string")
    both = [sorted(map(tuple, joins.join_small(big, small, ["k"], F.col("id"), flag, how).collect())) for flag in (True, False)]
    assert both[0] == both[1] and both[0]
    assert joins.is_small(small) and not joins.is_small(big, max_rows=100)


def test_manifest(spark, catalog, tmp_path):
    write_index(catalog, str(tmp_path / "index"), "My index")
    text = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "index")).collect())
    assert text.startswith("# My index") and "14 documents" in text
    assert "## csv" in text and "### Harbour Survey\n- `harbour.html` · 1 chunks" in text
    assert text.index("## csv") < text.index("## docx") < text.index("## xlsx")
    nothing = catalog.table("documents").limit(0)
    empty = manifest.manifest_entries(nothing, catalog.table("chunks"), catalog.table("tags"))
    shown = [r["block"] for r in manifest.manifest_lines(empty, "T", "now").collect()]
    assert shown[-1] == manifest.EMPTY_NOTE


def test_large_delimited_files_are_numbered_across_splits(spark, tmp_path):
    for name, n in (("a.csv", 3000), ("b.csv", 10)):
        (tmp_path / name).write_text("id,text\n" + "".join(f"{i},value {i} é\n" for i in range(n)), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows, header = read_delimited(spark, str(tmp_path))
        got = rows.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert header == "id,text" and len(got) == 3010
    assert all(r["cells"] == [str(r["row_no"]), f"value {r['row_no']} é"] for r in got)


def test_settings_and_legacy_column(spark, tmp_path):
    made = Catalog(spark, str(tmp_path / "c"), parts=2)
    assert Catalog(spark, str(tmp_path / "c"), parts=8).parts == 2
    made.set_setting("k", "1")
    made.set_setting("k", "2")
    assert made.setting("k") == "2" and made.lock("k", "3") == "2" and made.setting("none") is None
    assert made.drop_legacy_columns() is False
    old = spark.createDataFrame([("d-00000", "d", 0, "text", None, 1)], schemas.CHUNKS)
    (old.withColumn("embedding", F.lit(None).cast("array<float>")).withColumn("part", F.lit(1))
     .write.mode("overwrite").partitionBy("part").parquet(made.path("chunks")))
    assert made.drop_legacy_columns() is True and made.drop_legacy_columns() is False
    assert [tuple(r) for r in made.table("chunks").collect()] == [tuple(r) for r in old.collect()]


def test_emptied_documents_leave_no_rows(spark, tmp_path):
    made = Catalog(spark, str(tmp_path / "c"), parts=1)
    rows = spark.createDataFrame([("d", "x")], schemas.TAGS)
    made.replace("tags", rows, rows.select("doc_id"))
    made.replace("tags", rows.limit(0), rows.select("doc_id"))
    assert made.table("tags").count() == 0


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("first file")
    made = Catalog(spark, str(tmp_path / "c"), parts=2)
    for name in ("b.txt", None):
        ingest_stream(made, str(folder), str(tmp_path / "s1")).awaitTermination()
        backfill_stream(made, str(tmp_path / "s2")).awaitTermination()
        if name:
            (folder / name).write_text("second file")
    assert {r["text"] for r in made.table("chunks").collect()} == {"first file", "second file"}
    assert made.table("chunk_embeddings").count() == 2
    assert made.setting("embedding_model") == HASHING_MODEL


@pytest.mark.parametrize("how", ["inner", "left_semi", "left_anti", "left"])
def test_join_small_gives_the_same_rows_either_way(spark, how):
    big = spark.createDataFrame([(i % 3, i) for i in range(60)], "k int, v int")
    other = spark.createDataFrame([(0, "a"), (2, "b"), (2, "c"), (9, "d")], "k int, w string")
    ways = [
        sorted(map(str, joins.join_small(big, other, ["k"], F.col("v"), small, how).collect()))
        for small in (True, False)
    ]
    assert ways[0] == ways[1] and ways[0]


def test_only_scattered_documents_are_shuffled_for_keywords(spark, monkeypatch):
    monkeypatch.setattr(tags, "PIECE_CHUNKS", 4)
    draw = random.Random(5)
    words = ["heron", "ferry", "pier", "quay", "tide", "crane", "buoy"]
    rows = [(d, o, " ".join(draw.choices(words, k=9))) for d, n in
            (("a", 2), ("b", 3), ("long", 9), ("c", 1)) for o in range(n)]
    columns, counted = "doc_id string, ordinal int, text string", []
    count = tags.term_frequencies
    monkeypatch.setattr(tags, "term_frequencies", lambda chunks, k=None: counted.append(
        {r.doc_id for r in chunks.select("doc_id").distinct().collect()}) or count(chunks, k))
    together = tags.keyword_tags(spark.createDataFrame(rows, columns).coalesce(1), 3).collect()
    scattered = rows[::2] + rows[1::2]
    apart = tags.keyword_tags(spark.createDataFrame(scattered, columns).coalesce(1), 3).collect()
    assert sorted(map(tuple, together)) == sorted(map(tuple, apart))
    assert counted == [{"long"}, {"a", "b", "long"}]
