"""Text functions against plain Python."""

import random

import pytest
from hypothesis import HealthCheck, given, settings as hypothesis_settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscan import settings
from folioscan.functions import delimited as dx
from folioscan.functions import html as hx
from folioscan.functions import json_lines as jx
from folioscan.functions import keys
from folioscan.functions import terms as tm
from folioscan.functions import text as tx
from folioscan.operators.packing import pack_array, pack_rows


def run(spark, rows, *columns, schema="text string"):
    df = spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema)
    return df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).collect()


def greedy(items, limit=1200, gap=2):
    """Items packed in order, the plain way."""
    packed, size = [], 0
    for item in items:
        if packed and size + len(item) + gap <= limit:
            packed[-1].append(item)
            size += len(item) + gap
        else:
            packed.append([item])
            size = len(item)
    return packed


def paragraphs(text):
    return [p.strip() for p in text.split("\n\n") if p.strip()]


SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0  　"


def test_strip_and_words_follow_unicode(spark):
    rows = [f"{c}a b{c}{c}" for c in SPACES] + ["", " ", "plain", "​x​", "a b　c"]
    got = run(spark, rows, tx.strip(F.col("text")), tx.word_count(F.col("text")),
              tx.snippet(F.col("text")))
    for text, row in zip(rows, got):
        assert row["c0"] == text.strip()
        assert row["c1"] == len(text.split())
        assert row["c2"] == " ".join(text.split())[:240]


def test_approx_tokens(spark):
    rows = ["", "one two", "x" * 41]
    got = [r["c0"] for r in run(spark, rows, tx.approx_tokens(F.col("text")))]
    assert got == [max(len(t.split()), len(t) // 4) for t in rows]


def test_packing_equals_the_plain_loop(spark):
    rng = random.Random(3)
    rows = ["", "\n\n \n\n", "x" * 3000]
    for _ in range(60):
        lengths = [rng.choice([1, 30, 400, 598, 599, 600, 1198, 1200, 1201, 2500]) for _ in range(rng.randint(1, 12))]
        rows.append("\n\n".join(rng.choice(["é", "a", "\U0001f600"]) * n for n in lengths))
    got = run(spark, rows, tx.pack_paragraphs(F.col("text")))
    for text, row in zip(rows, got):
        assert row["c0"] == ["\n\n".join(g) for g in greedy(paragraphs(text))]


@hypothesis_settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet=" \n\tabé", max_size=60), min_size=1, max_size=30))
def test_packing_keeps_every_paragraph(spark, texts):
    got = run(spark, texts, tx.pack_paragraphs(F.col("text"), 20))
    for text, row in zip(texts, got):
        assert [p for chunk in row["c0"] for p in chunk.split("\n\n")] == paragraphs(text)


def record_chunks(records):
    """(first, last, text) of packed records, oversize ones by themselves."""
    out, at = [], 0
    for run_of in _runs(records):
        text = "\n\n".join(run_of)
        pieces = [text]
        if len(run_of) == 1 and len(text) > 1200:
            pieces = ["\n\n".join(g) for g in greedy(paragraphs(text))]
        out += [(at, at + len(run_of) - 1, p) for p in pieces]
        at += len(run_of)
    return out


def _runs(records):
    runs, size = [], 0
    for record in records:
        if len(record) > 1200:
            runs.append([record])
            size = 0
        elif size and size + len(record) <= 1200:
            runs[-1].append(record)
            size += len(record) + 2
        else:
            runs.append([record])
            size = len(record) + 2
    return runs


def sample_records(rng, n):
    sizes = [0, 1, 5, 100, 100, 100, 399, 600, 1198, 1199, 1200, 1201]
    out = ["x" * rng.choice(sizes) for _ in range(n)]
    return [r if rng.random() > 0.05 else "y" * 700 + "\n\n" + "z" * 700 for r in out]


def test_packed_arrays(spark):
    rng = random.Random(5)
    rows = [(sample_records(rng, n),) for n in (1, 2, 10, 40)]
    got = run(spark, rows, pack_array(F.col("items")), schema="items array<string>")
    for (items,), row in zip(rows, got):
        flat = [(g["first"], g["last"], p) for g in row["c0"] for p in g["pieces"]]
        assert flat == record_chunks(items)


@pytest.mark.parametrize("block", [3, 16, 1024])
def test_packed_rows_do_not_depend_on_blocks(spark, block):
    """One document with most of the rows, cut into blocks, packs as a whole."""
    rng = random.Random(7)
    documents = {"hot": sample_records(rng, 300), "same": ["a" * 100] * 90, "one": ["b"],
                 "tiny": [""] * 70 + ["c" * 1200]}
    rows = [(d, i, [t]) for d, items in documents.items() for i, t in enumerate(items)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc string, at bigint, items array<string>").repartition(5)
    got = pack_rows(df, ["doc"], "at", "items", block_rows=block).collect()
    for name, items in documents.items():
        mine = sorted((r["ordinal"], r["first_at"], r["last_at"], r["text"]) for r in got if r["doc"] == name)
        assert [r[1:] for r in mine] == record_chunks(items)
        assert [r[0] for r in mine] == list(range(len(mine)))


def test_markdown_sections(spark):
    text = "intro\n\n# One  \nbody\n####### seven\n## Two\n#no\n### Three\r\n\r\nlast"
    got = run(spark, [text, "", "# preamble\nx"], tx.markdown_sections(F.col("text")))
    assert [tuple(s) for s in got[0]["c0"]] == [
        ("preamble", "intro"), ("One", "body\n####### seven"), ("Two", "#no"), ("Three", "last")]
    assert got[1]["c0"] == []
    assert [tuple(s) for s in got[2]["c0"]] == [("preamble", "x")]


def test_file_names_and_extensions(spark):
    names = ["a/b:c*?.txt", "", " ", None, "ok.PDF", "archive.tar.gz", ".hidden", "none"]
    got = run(spark, names, tx.safe_file_name(F.col("text")), tx.extension(F.col("text")))
    assert [r["c0"] for r in got] == [
        "a_b_c__.txt", "untitled", "untitled", "untitled", "ok.PDF", "archive.tar.gz", ".hidden", "none"]
    assert [r["c1"] for r in got][4:] == [".pdf", ".gz", "", ""]


def test_keys(spark):
    import hashlib

    got = run(spark, ["é"], keys.document_id(F.col("text"), F.lit("1")), keys.chunk_id(F.lit("d"), F.lit(3)))
    assert got[0]["c0"] == hashlib.sha1("é|1".encode()).hexdigest()[:16]
    assert got[0]["c1"] == "d-00003"


HTML = [
    ("<p>a<!-- x --><b>b</b></p><script>if (1 < 2) '</p>'</script>c", "a\nb\nc"),
    ("<style>p>{}</style><a title='x > y'>link</a>\n\n\n\n<p>z", "link\n\nz"),
    ("a &lt; b &amp;lt; &#233;&#x1F600; &eacute;&nope; &copy2 1 < 2 && 3", "a < b &lt; é😀 é&nope; ©2 1 < 2 && 3"),
    ("<NOSCRIPT><p>no</p></NOSCRIPT><!DOCTYPE html>yes<script>open", "yes"),
]


@pytest.mark.parametrize("page,text", HTML)
def test_html_text(spark, page, text):
    assert run(spark, [page], hx.body_text(F.col("text")))[0]["c0"] == text


def test_html_long_attributes_do_not_overflow(spark):
    page = "<img alt=" + "x" * 200_000 + " data='" + "y" * 200_000 + "'>text<p " + "a=b " * 20_000 + ">end"
    assert run(spark, [page], hx.body_text(F.col("text")))[0]["c0"] == "text\nend"


def test_html_title(spark):
    rows = ["<title> A &amp; B </title>", "<title></title>", "<p>x"]
    assert [r["c0"] for r in run(spark, rows, hx.title(F.col("text")))] == ["A & B", None, None]


def test_json(spark):
    value = '{"b": {"x": [1, {"y": true}], "e": {}}, "a": null, "f": 1.50, "t": "é"}'
    expected = "b.x[0]: 1\nb.x[1].y: True\na: \nf: 1.5\nt: é"
    assert run(spark, [value, "{bad"], jx.flatten_json("text"))[0]["c0"] == expected
    cases = [('[1, "a"]', ".json"), ('{"a": 1}\n\n{"a": 2}', ".json"), ('{"a": 1}', ".jsonl"),
             ("  ", ".json"), ("{", ".json")]
    got = run(spark, cases, jx.json_records(F.col("text"), F.col("ext")), schema="text string, ext string")
    assert [r["c0"]["records"] for r in got] == [["1", "a"], ["a: 1", "a: 2"], ["a: 1"], [], None]
    assert got[4]["c0"]["error"]


PORTER = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "cats": "cat", "feed": "feed",
    "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing",
    "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan",
    "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file",
    "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit",
    "vietnamization": "vietnam", "predication": "predic", "operator": "oper", "feudalism": "feudal",
    "decisiveness": "decis", "hopefulness": "hope", "callousness": "callous", "formaliti": "formal",
    "sensitiviti": "sensit", "triplicate": "triplic", "formative": "form", "formalize": "formal",
    "electrical": "electr", "goodness": "good", "revival": "reviv", "allowance": "allow",
    "inference": "infer", "airliner": "airlin", "adjustable": "adjust", "defensible": "defens",
    "irritant": "irrit", "replacement": "replac", "adjustment": "adjust", "dependent": "depend",
    "adoption": "adopt", "communism": "commun", "activate": "activ", "effective": "effect",
    "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll",
}


def test_porter_stems():
    assert {w: tm.porter_stem(w) for w in PORTER} == PORTER


def test_tokens(spark):
    got = run(spark, ["The Éclair, été 42 naïve-Åb"], tm.lexical_tokens(F.col("text")))
    assert got[0]["c0"] == ["eclair", "ete", "naive", "ab"]
    counts = run(spark, ["b a b c b a"], tm.term_counts(F.split("text", " ")))[0]["c0"]
    assert [tuple(c) for c in counts] == [("a", 2), ("b", 3), ("c", 1)]


def test_delimiters_and_encoding(spark):
    texts = ["a,b\n1,2", "a;b;c\n1;2;3,5", "a\tb\n1\t2", "a|b\n1|2", "plain\ntext", 'a;"x,y,z"\n1;"p,q"', ""]
    got = [r["c0"] for r in run(spark, texts, dx.sniff_delimiter(F.col("text")))]
    assert got == [",", ";", "\t", "|", ",", ";", ","]
    data = [("naïve € “x”".encode("cp1252"),), ("naïve €".encode(),), ("﻿é".encode(),)]
    got = run(spark, data, dx.decoded(F.col("content")), schema="content binary")
    assert [r["c0"] for r in got] == ["naïve € “x”", "naïve €", "é"]


def test_profiles():
    assert settings.effort_profile("low").enrich_summary is False
    assert settings.effort_profile("HIGH").ocr_fallback is True
    with pytest.raises(ValueError):
        settings.effort_profile("medium")


def test_html_of_broken_markup(spark):
    many = "<a " + " ".join(f'x{i}="v>{i}"' for i in range(50_000)) + ">hello"
    pages = [many, "before <a href='x' " * 3, "<p>x\x01y</p>z", "<a " * 100_000,
             '<b title="a>b">t</b><i x="q>r', "<!-- never closed <p>text"]
    shown = [r.c0 for r in run(spark, pages, hx.body_text(F.col("text")))]
    assert shown == ["hello", "before", "x\x01y\nz", "", "t\nr", ""]


def test_html_references_equal_the_standard(spark):
    import html as standard

    parts = ["&#0000000065;", "&#x000000041;", "&apos;", "&#150;", "&#129;", "&#x110000;", "&#0;",
             "&not;", "&amp;lt;", "&nbsp;x", "&unknown;", "&amp x", "&copy",
             "&CounterClockwiseContourIntegral;", "&#xD800;", "& ;", "&;", "&#;", "&fjlig;"]
    shown = [r.c0 for r in run(spark, parts, hx.decode_entities(F.col("text")))]
    want = [standard.unescape(p) for p in parts]
    assert dict(zip(parts, shown)) == dict(zip(parts, want))
    # Without its semicolon a name counts only where it is one of the old ones.
    others = ["&hellip x", "&notit;", "&ampx"]
    shown = [r.c0 for r in run(spark, others, hx.decode_entities(F.col("text")))]
    assert shown == [standard.unescape(p) for p in others] == ["&hellip x", "\u00acit;", "&x"]


def test_title_outside_comments_and_scripts(spark):
    page = ("<!-- <title>old</title> --><script>'<title>s</title>'</script>"
            "<title>new &amp; x</title>")
    assert run(spark, [page], hx.title(F.col("text")))[0].c0 == "new & x"


def test_bad_records_are_rejects_and_cost_nothing_else(spark):
    from folioscan.operators import chunking

    good = ['{"t": "%s"}' % (c * 500) for c in "abcdefg"]
    rows = [("d", i, j) for i, j in enumerate([*good[:3], "{broken", *good[3:], None, "[" * 9999])]
    records = spark.createDataFrame(rows, "doc_id string, record_no bigint, json string")
    chunks = chunking.record_chunks(records).orderBy("ordinal").collect()
    assert [c.locator for c in chunks] == [
        "records 1-2", "records 3-5", "records 6-7", "record 8"]
    assert all(len(c.text) <= 1200 for c in chunks)
    rejects = {(r.record_no, r.error) for r in chunking.record_rejects(records).collect()}
    assert rejects == {(3, "not JSON"), (8, "no record"), (9, "not JSON")}


def test_null_blocks_are_no_blocks(spark):
    from folioscan.operators import chunking

    rows = [("d", i, "para", t, None) for i, t in enumerate(["one", None, "two", " ", "three"])]
    blocks = spark.createDataFrame(
        rows, "doc_id string, block_no bigint, kind string, text string, "
              "cells array<array<string>>")
    assert [c.text for c in chunking.block_chunks(blocks).collect()] == ["one\n\ntwo\n\nthree"]


def test_flat_json_nested(spark):
    value = '{"a": {"b": [1, null, {"c": true}]}, "d": 1.50, "e": [], "f": ""}'
    flat = run(spark, [value, "7", "[]"], jx.flatten_json(F.col("text")))
    assert [r.c0 for r in flat] == [
        "a.b[0]: 1\na.b[1]: \na.b[2].c: True\nd: 1.5\nf: ", "7", ""]


def test_references_equal_the_standard_library(spark):
    import html
    import random
    from html.entities import html5

    rng = random.Random(5)
    names = sorted(html5)
    texts = ["x?a=1&beta=2", "&copyright;", "&notit;", "&notin;", "&#0;&#x80;&#129;&#xD800;&#x110000;",
             "&#7;a&#11;b&#127;c&#xFFFE;d&#xFDD0;e&#13;", "&", "&&amp;&", "&amp;lt;", "&#;&#x;", "&lt",
             "&" + "a" * 40 + ";", "&#99999999999999999999;", "&#065;&#x0041;", "&NotEqualTilde;"]
    for _ in range(600):
        name = rng.choice(names).rstrip(";")
        texts.append("".join(rng.choice([
            f"&{name};", f"&{name}", f"&{name}{rng.choice('a=;1 &')}", f"&{name[:rng.randint(1, 6)]}",
            f"&#{rng.randint(0, 70000)};", f"&#x{rng.randint(0, 0x110000):x}", "text ", ";"])
            for _ in range(rng.randint(1, 5))))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    shown = [tuple(r) for r in df.select("t", hx.decode_entities(F.col("t"))).collect()]
    assert [(t, s) for t, s in shown if s != html.unescape(t)] == []
