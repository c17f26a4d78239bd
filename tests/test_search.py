"""Search over a stored catalog, one mode at a time."""

import random

import pytest
from pyspark.sql import functions as F

from folioscan import schemas
from folioscan.operators import lexical, results
from folioscan.operators.ranking import top_k
from folioscan.plans.search import named_terms, search
from tests.helpers import toy_factory


def rows(found):
    return found[0].collect()


def test_ranked_hits(catalog):
    found, mode = search(catalog, "heron")
    assert mode == "bm25"
    assert found.columns == ["query_id", "rank", *schemas.RESULT_COLUMNS]
    hits = found.collect()
    assert {h["filename"] for h in hits} == {"birds.pdf", "note.docx"}
    assert hits[0]["score"] >= hits[-1]["score"]


def test_stemming_finds_other_forms(catalog):
    assert {h["filename"] for h in rows(search(catalog, "dredges silts"))} >= {
        "harbour.html", "log.txt"}


def test_type_filter(catalog):
    assert {h["source_type"] for h in rows(search(catalog, "heron", types=["docx"]))} == {"docx"}


def test_source_filter(catalog):
    assert rows(search(catalog, "heron", source="gdrive")) == []
    assert rows(search(catalog, "heron", source="local"))


def test_tag_filter(catalog):
    tag = catalog.table("tags").filter("tag = 'water'").first()
    hits = rows(search(catalog, "heron ferry", tags=["water", "ferry"]))
    assert {h["doc_id"] for h in hits} == {tag["doc_id"]}


def test_no_match(catalog):
    found, mode = search(catalog, "zebra")
    assert results.format_results(found, 10, mode) == "No matches."


def test_format(catalog):
    found, mode = search(catalog, "shackle")
    shown = results.format_results(found, 10, mode)
    assert shown.startswith("(mode: bm25)\n1. [") and "stores.docx (docx, block 1)" in shown
    assert "\n   uri: file:" in shown


def test_vector_mode(embedded):
    hits, mode = search(embedded, "heron watches shallow water", mode="vector", embed_query=toy_factory)
    hits = hits.collect()
    assert mode == "vector" and len(hits) == 10
    assert all(-1 <= h["score"] <= 1 for h in hits)
    assert hits[0]["filename"] == "birds.pdf"


def test_hybrid_mode(embedded):
    hits, mode = search(embedded, "heron", mode="hybrid", limit=5, embed_query=toy_factory)
    hits = hits.collect()
    assert mode == "hybrid" and 0 < len(hits) <= 5
    assert all(0 < h["score"] <= 2 / 60 for h in hits)
    assert hits[0]["score"] >= hits[-1]["score"]


def test_hybrid_respects_filters(embedded):
    hits = rows(search(embedded, "heron", types=["json"], embed_query=toy_factory))
    assert hits and {h["source_type"] for h in hits} == {"json"}


def test_auto(catalog, embedded):
    assert search(catalog, "heron")[1] == "bm25"
    assert search(embedded, "heron", embed_query=toy_factory)[1] == "hybrid"


def test_errors(catalog):
    with pytest.raises(ValueError):
        search(catalog, "heron", mode="fuzzy")
    for mode in ("vector", "hybrid"):
        with pytest.raises(RuntimeError):
            search(catalog, "heron", mode=mode)


def test_query_table(spark, catalog):
    queries = spark.createDataFrame([(7, "heron"), (8, "silt"), (9, "zebra")],
                                    "query_id bigint, text string")
    hits = rows(search(catalog, queries, limit=2))
    assert {h["query_id"] for h in hits} == {7, 8}
    assert all(h["rank"] < 2 for h in hits)


@pytest.mark.parametrize("limit", [1, 5, 60])
def test_block_maxima_give_the_same_list_from_fewer_postings(spark, limit):
    rng = random.Random(limit)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(60)],
                                  k=rng.randint(1, 40))) for _ in range(500)]
    texts += ["w50 w51 w52 " * 9] * 6 + [""]
    chunks = spark.createDataFrame(
        [(f"c{i}", f"d{i // 2}", t) for i, t in enumerate(texts)], "chunk_id string, doc_id string, text string")
    queries = spark.createDataFrame(
        [(1, "w50 w51 w52"), (2, "w0 w1"), (3, "nothing"), (4, "w59 w0 w20")], "query_id bigint, text string")
    postings = lexical.in_blocks(lexical.build_postings(chunks, None), 60).cache()
    wanted = lexical.query_terms(queries, stemmer=None)
    facts = lexical.document_frequencies(postings), lexical.corpus_totals(chunks, None), wanted, True
    read = []
    best = lexical.block_max_top_k(
        postings, lexical.block_maxima(postings), *facts, limit, read=read)
    matching = lexical.matching_postings(postings, wanted, True)
    expected = top_k(lexical.score(matching, *facts), limit)
    assert sorted(map(tuple, best.select(expected.columns).collect())) == sorted(
        map(tuple, expected.collect()))
    assert len(read) == 3
    if limit < 60:
        assert sum(read) < matching.count() * 3 and read[2] < matching.count()
    if limit == 1:
        assert sum(read) < matching.count()


def test_many_terms_reach_the_scan(spark, catalog):
    terms = [f"t{i:02d}" for i in range(50)] + ["heron"]
    found = catalog.table("postings").filter(named_terms(terms))
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    plan = found._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters"):].partition("ReadSchema")[0]
    assert all(t in pushed for t in terms) and pushed.count("In(term") == 5
    assert {r.term for r in found.collect()} == {"heron"}
    assert catalog.table("postings").filter(named_terms([])).count() == 0


def _brute_scores(texts, queries):
    """(query, chunk) to BM25, and the (term, tf) of every chunk, by the formula."""
    import math
    from collections import Counter

    counts = {c: Counter(t.split()) for c, t in texts.items()}
    mean = sum(sum(n.values()) for n in counts.values()) / len(counts)
    df = Counter(t for n in counts.values() for t in n)
    found = {}
    for q, text in queries.items():
        for c, n in counts.items():
            shared = set(text.split()) & n.keys()
            if shared:
                size = sum(n.values())
                found[q, c] = round(sum(
                    math.log(1 + (len(counts) - df[t] + 0.5) / (df[t] + 0.5)) * n[t] * 2.2
                    / (n[t] + 1.2 * (0.25 + 0.75 * size / mean)) for t in shared), 9)
    return found


@pytest.mark.parametrize("at_once", [1 << 19, 5])
def test_scores_are_summed_block_by_block(spark, monkeypatch, at_once):
    from folioscan.plans.search import lexical_scores

    monkeypatch.setattr(lexical, "SUMS_AT_ONCE", at_once)
    draw = random.Random(5)
    words = ["heron", "ferry", "pier", "quay", "tide", "crane", "buoy", "anchor"]
    texts = {f"c{i:03d}": " ".join(draw.choices(words, k=draw.randint(1, 9))) for i in range(150)}
    queries = {i: " ".join(draw.sample(words, 3)) for i in range(7)}
    chunks = spark.createDataFrame(
        [(c, c[:3], t) for c, t in texts.items()], "chunk_id string, doc_id string, text string")
    table = spark.createDataFrame(list(queries.items()), "query_id bigint, text string")
    expected = _brute_scores(texts, queries)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        scores = lexical_scores(chunks, table, None)
        # Pairs of query and chunk are neither grouped nor shuffled.
        assert "Aggregate" not in scores._jdf.queryExecution().optimizedPlan().toString()
        got = {(r["query_id"], r["chunk_id"]): r["score"] for r in scores.collect()}
        best = top_k(lexical_scores(chunks, table, None, best=4), 4).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == expected.keys()
    assert all(abs(got[k] - s) < 2e-9 for k, s in expected.items())
    assert all(sum(1 for r in best if r["query_id"] == q) == 4 for q in queries)
    for q in queries:
        ranked = sorted((-s, c) for (of, c), s in got.items() if of == q)[:4]
        assert [c for _, c in ranked] == [r["chunk_id"] for r in sorted(
            (r for r in best if r["query_id"] == q), key=lambda r: r["rank"])]


@pytest.mark.parametrize("stemmer", [None, "porter"])
def test_postings_and_lengths_come_from_one_pass(spark, monkeypatch, stemmer):
    monkeypatch.setattr(lexical, "CHUNKS_AT_ONCE", 3)
    texts = ["Herons, a heron; the FERRY", None, "", "123 the", "Žlutý kůň rides, riding Éric", "ferries ferry x"] * 3
    chunks = spark.createDataFrame(
        [(f"c{i}", f"d{i // 2}", t) for i, t in enumerate(texts)],
        "chunk_id string, doc_id string, text string")
    words = chunks.select("chunk_id", "doc_id", lexical.tokens(F.col("text"), stemmer).alias("w"))
    expected = {(r["term"], r["chunk_id"], r["doc_id"], r["tf"], r["len"]) for r in words.select(
        "chunk_id", "doc_id", F.size("w").alias("len"), F.explode("w").alias("term")).groupBy(
        "term", "chunk_id", "doc_id", "len").agg(F.count("*").alias("tf")).collect()}
    rows = [tuple(r) for r in lexical.build_postings(chunks, stemmer, lengths=True).collect()]
    assert {r for r in rows if r[0]} == expected and len({r[:2] for r in rows}) == len(rows)
    assert not any(c.isspace() or not c.isascii() for t, *_ in expected for c in t)
    held = [r[4] for r in rows if r[0] == lexical.NO_TERM]
    assert [(len(held), sum(held))] == [tuple(r) for r in lexical.corpus_totals(chunks, stemmer).collect()]
    assert sorted(r for r in rows if r[0]) == sorted(
        map(tuple, lexical.build_postings(chunks, stemmer).collect()))


@pytest.mark.parametrize("at_once", [1, 7, 1 << 20])
def test_postings_of_a_chunk_are_one_row_before_the_shuffle(spark, monkeypatch, at_once):
    monkeypatch.setattr(lexical, "POSTINGS_AT_ONCE", at_once)
    draw = random.Random(at_once)
    rows = [(draw.choice("abcdef"), f"c{i}" if i else None, f"d{i % 3}" if i % 5 else None,
             draw.randint(1, 4), 9 + i % 2) for i in range(12) for _ in range(5)]
    postings = spark.createDataFrame(rows, schemas.POSTINGS).orderBy("term").coalesce(1)
    wanted = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "z")], "query_id int, term string")
    frequencies = spark.createDataFrame([("a", 5), ("b", 2), ("b", 2), ("c", 1)], "term string, df bigint")
    totals = spark.createDataFrame([(12, 120)], "n_chunks bigint, total_len bigint")
    facts = frequencies, totals, wanted
    found = lexical.score(postings, *facts, small=True)
    plain = lexical.score(postings, *facts, small=False)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    if at_once > len(rows):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "terms#" in plan.split("RepartitionByExpression")[1]


def test_texts_stay_where_they_lie(spark):
    ranked = spark.createDataFrame([(1, "d-0", "d", 1.0), (2, "d-0", "d", 2.0), (2, "d-1", "d", 1.0)],
                                   "query_id int, chunk_id string, doc_id string, score double")
    chunks = spark.createDataFrame([(f"d-{i}", "d", "part", f"text {i}") for i in range(5)],
                                   "chunk_id string, doc_id string, locator string, text string")
    documents = spark.createDataFrame([("d", "f", "text", "u", None)], "doc_id string, filename string, "
                                      "source_type string, source_uri string, summary string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = results.result_rows(ranked, chunks, documents)
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin [chunk_id" in plan and "LeftSemi" in plan
        assert sorted(r.text for r in found.collect()) == ["text 0", "text 0", "text 1"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
