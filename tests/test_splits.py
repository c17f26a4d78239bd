"""Records of files over many splits against a parse of the whole file."""

import csv
import io
import json
import random

import pytest

from folioscan.sources import splits


@pytest.fixture(params=[64, 333, 1 << 20])
def small_splits(spark, request):
    """Splits of a few bytes, so that records reach over several."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(request.param))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield spark
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def by_file(rows, value):
    found = {}
    for r in sorted(rows, key=lambda r: (r.local_path, r[1])):
        name = r.local_path.rpartition("/")[2]
        assert r[1] == len(found.setdefault(name, []))
        found[name].append(r[value])
    return found


def random_table(rng, rows):
    out = io.StringIO(newline="")
    writer = csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"]))
    for _ in range(rows):
        writer.writerow([rng.choice([
            "", "plain", 'a "quoted" word', "two\nlines", "comma, inside", '"', '""\n""', "é中",
            "x" * rng.randint(0, 200), "line\n" * rng.randint(0, 30)]) for _ in range(4)])
    return out.getvalue()


def test_delimited_files(small_splits, tmp_path):
    rng = random.Random(7)
    texts = {f"t{i}.csv": random_table(rng, 25) for i in range(3)}
    texts |= {
        "odd.csv": 'a,b"c,d\n1,x"y\n"closed"tail,2\n\n"",""\nlast,row',
        "open.csv": 'a,b\n1,"never closed\nand on\n', "blank.csv": "\n\n", "empty.csv": "",
        "bom.csv": "﻿a,b\n1,2\n", "bare.csv": 'a,b\r1,"x\ry"\r2,z\n'}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    latin = 'naïve;"a\nb"\nété;2\n'.encode("cp1252")
    (tmp_path / "latin").mkdir()
    (tmp_path / "latin" / "l.csv").write_bytes(latin)
    found = by_file(splits.delimited_records(
        small_splits, [str(tmp_path / n) for n in texts]).collect(), "cells")
    expected = {}
    for name, text in texts.items():
        rows = [r for r in csv.reader(io.StringIO(text.removeprefix("﻿"), newline="")) if r]
        if rows:
            expected[name] = rows
    assert found == expected
    other = splits.delimited_records(small_splits, str(tmp_path / "latin"), ";").collect()
    assert by_file(other, "cells") == {"l.csv": [["naïve", "a\nb"], ["été", "2"]]}


def random_value(rng, depth=0):
    kind = rng.randint(0, 6 if depth < 3 else 3)
    if kind < 4:
        return [rng.randint(-9, 9), 'text, with "quotes" \\ and [brackets}', None, "中" * 9][kind]
    if kind == 4:
        return [random_value(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return {f"k,{i}": random_value(rng, depth + 1) for i in range(rng.randint(0, 4))}


def test_json_arrays(small_splits, tmp_path):
    rng = random.Random(11)
    values = {f"a{i}.json": [random_value(rng) for _ in range(40)] for i in range(3)}
    for i, (name, value) in enumerate(values.items()):
        (tmp_path / name).write_text(json.dumps(value, indent=i or None, ensure_ascii=i == 1))
    (tmp_path / "none.json").write_text(" [ \n ] ")
    (tmp_path / "one.json").write_text('{"a": [1, 2], "b": "x,y"}')
    (tmp_path / "nested.json").write_text("[[1, 2], [3]]")
    found = by_file(splits.json_array_records(small_splits, str(tmp_path)).collect(), "json")
    assert found.pop("one.json") == ['{"a": [1, 2], "b": "x,y"}']
    parsed = {name: [json.loads(j) for j in rows] for name, rows in found.items()}
    assert parsed == values | {"nested.json": [[1, 2], [3]]}


@pytest.mark.parametrize("text", ["[1, 2", "[1, [2]", "[1, 2],", "[1, 2]]", "[1,, 2]", "[1, 2,]"])
def test_broken_arrays_have_a_broken_record(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    rows = splits.json_array_records(spark, str(tmp_path)).collect()

    def is_json(value):
        try:
            json.loads(value)
        except ValueError:
            return False
        return True

    assert any(r.json is None or not is_json(r.json) for r in rows)


def test_json_lines(small_splits, tmp_path):
    lines = [json.dumps({"n": i, "t": "é" * (i % 50)}, ensure_ascii=False) for i in range(90)]
    (tmp_path / "x.jsonl").write_text("\n\n".join(lines[:50]) + "\r\n  \n" + "\n".join(lines[50:]))
    (tmp_path / "y.jsonl").write_text("")
    found = by_file(splits.json_line_records(small_splits, str(tmp_path)).collect(), "json")
    assert [json.loads(j)["n"] for j in found["x.jsonl"]] == list(range(90))


def test_headers(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text(f"id,{name}\n1,x\n2,y\n")
    rows = splits.with_headers(splits.delimited_records(spark, str(tmp_path))).collect()
    assert sorted((r.header[1], r.row_no, r.cells) for r in rows) == [
        ("a", 0, ["1", "x"]), ("a", 1, ["2", "y"]), ("b", 0, ["1", "x"]), ("b", 1, ["2", "y"])]


def test_ingest_reads_large_files_in_splits(spark, tmp_path):
    from folioscan.sources.files import extract, folder_content, list_folder

    names = [f"row {i}" for i in range(130)]
    (tmp_path / "a [1]+b%20é.csv").write_text("id;note\n" + "".join(
        f'{i};"{n}\nsecond line"\n' for i, n in enumerate(names)))
    (tmp_path / "c.json").write_text(json.dumps([{"n": i, "t": t} for i, t in enumerate(names)]))
    (tmp_path / "d.jsonl").write_text("\n".join(json.dumps({"t": t}) for t in names))
    (tmp_path / "e.json").write_text("[1, 2, " + "3" * 900)
    (tmp_path / "small.csv").write_text("k,v\n1,2\n")
    (tmp_path / "big.txt").write_text("x" * 900)
    (tmp_path / "small.txt").write_text("y")
    listing, content = list_folder(spark, str(tmp_path)), folder_content(spark, str(tmp_path))
    found = extract(listing, content, split_bytes=500, row_bytes=500)
    plain = extract(listing, content)

    def chunks(extracted, *skip):
        rows = extracted.chunks.join(listing.select("doc_id", "filename"), "doc_id").collect()
        return sorted((r.filename, r.ordinal, r.locator, r.text) for r in rows
                      if r.filename not in skip)

    assert chunks(found) == chunks(plain, "big.txt")
    rejects = {r.local_path.rpartition("/")[2] for r in found.rejects.collect()}
    assert rejects == {"e.json", "big.txt"}
    info = {r.doc_id: r.page_count for r in found.info.collect()}
    whole = {r.doc_id: r.page_count for r in plain.info.collect()}
    assert len(info) == 5 and info.items() <= whole.items()


def test_small_delimited_files_are_parsed_row_by_row():
    import pandas as pd

    from folioscan.functions import delimited as dx

    lines = "".join(f'{i},"a\r\n{i}"\r\n\n' for i in range(5001))
    files = pd.DataFrame({
        "doc_id": ["x", "bad", "empty", "header"],
        "local_path": ["p"] * 4, "delimiter": [","] * 4,
        "text": ["n,note\n" + lines, 'a,b\n1,2\n3,\0\r4,"' + "x" * 5, None, "n,note"]})
    counts = next(iter(dx.count_rows([files]))).set_index("doc_id")
    assert counts.loc["x", "rows"] == 5002 and counts.loc["header", "rows"] == 1
    assert counts.loc["empty", "rows"] == 0 and counts.loc["empty", "error"] is None
    parts = list(dx.parse_rows([files.iloc[[0, 2, 3]]]))
    # No part holds more than a bounded number of rows, and no value holds a file.
    assert max(map(len, parts)) <= dx.ROWS_AT_ONCE
    rows = pd.concat(parts)
    assert rows["row_no"].tolist() == list(range(5001)) and set(rows["doc_id"]) == {"x"}
    assert rows["cells"].tolist() == [[str(i), f"a\r\n{i}"] for i in range(5001)]
    assert all(h == ["n", "note"] for h in rows["header"])


def test_delimited_lines_end_as_in_a_text_file():
    import csv
    import io

    from folioscan.functions import delimited as dx

    for text in ("", "\n", "a\r\rb,\"c\rd\"\r\n\r\ne", "a,b\r", '"a\n\nb"\n,', " a\x0bb\n\x85c"):
        plain = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
        assert list(dx._records(text, ",")) == plain


def test_delimited_error_leaves_no_rows(monkeypatch):
    import csv

    import pandas as pd

    from folioscan.functions import delimited as dx

    def broken(lines, delimiter):
        yield from ([line] for line in lines if line != "stop\n")
        raise csv.Error("broken")

    monkeypatch.setattr(dx.csv, "reader", broken)
    files = pd.DataFrame({"doc_id": ["d"], "local_path": ["p"], "text": ["a\nb\n"], "delimiter": [","]})
    assert list(dx.parse_rows([files])) == []
    assert next(iter(dx.count_rows([files])))[["rows", "error"]].values.tolist() == [[0, "broken"]]


@pytest.mark.parametrize("name", ["split_delimited", "split_json"])
def test_lines_of_a_flag_are_dealt_over_files_of_bounded_size(spark, tmp_path, monkeypatch, name):
    from checks import text_queries

    draw, made = random.Random(4), []
    items = [(draw.choice("ANR"), draw.randint(1, 40), n % 7, draw.randint(1, 99), n, draw.choice("OF"))
             for n in range(300)]
    spark.createDataFrame(items, "l_returnflag string, l_orderkey bigint, l_linenumber int, "
                          "l_partkey bigint, l_suppkey bigint, l_linestatus string").repartition(
        3).write.parquet(str(tmp_path / "lineitem.parquet"))
    write = text_queries._item_files
    monkeypatch.setattr(text_queries, "FILE_ROWS", 32, raising=False)
    monkeypatch.setattr(text_queries, "_item_files", lambda *a: made.append(write(*a)) or made[-1])
    rows = getattr(text_queries, name)(spark, str(tmp_path)).collect()
    expected, held = [], {}
    for flag, order, line, part, supplier, status in sorted(items, key=lambda x: (x[0], *x[1:5])):
        held[flag] = held.get(flag, -1) + 1
        expected.append((flag, held[flag], order, f'{status}\n"{part}", {supplier}'))
    assert sorted(map(tuple, rows)) == expected
    # No task writes all lines of a flag.
    files = spark.read.text(made[0]).groupBy("l_returnflag", "first_row").count().collect()
    assert len(files) > 6 and len({(f[0], f[1]) for f in files}) == sum(-(-(n + 1) // 32) for n in held.values())
