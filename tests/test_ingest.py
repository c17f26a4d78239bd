"""The survey folder from files to catalog."""

from pyspark.sql import functions as F

from folioscan.operators import upserts
from folioscan.plans.ingest import ingest_folder
from folioscan.sources.catalog import Catalog
from folioscan.sources.files import extract, folder_content, list_folder
from tests.helpers import sign_factory


def joined(catalog, name):
    rows = (
        catalog.table("documents").filter(F.col("filename") == name)
        .join(catalog.table("chunks"), "doc_id").orderBy("ordinal").collect()
    )
    return rows, "\n".join(r["text"] for r in rows)


def test_counts_and_types(catalog):
    documents = catalog.table("documents")
    assert catalog.totals.documents == documents.count() == 14
    assert catalog.totals.failed == 0
    types = {r[0] for r in documents.select("source_type").distinct().collect()}
    assert types == {"csv", "xlsx", "pdf", "docx", "text", "image", "json", "html"}
    assert catalog.totals.chunks == catalog.table("chunks").count() > 14
    assert documents.filter("source IS NULL OR status <> 'active' OR modified_at IS NULL").count() == 0


def test_delimited(catalog):
    rows, text = joined(catalog, "berths.csv")
    assert text == "port,berths\nOslo,12\nCork,7"
    assert rows[0]["locator"] == "rows 1-2" and rows[0]["page_count"] == 2
    assert joined(catalog, "flow.csv")[1] == "rivière,débit\nRhône,1700\nLoire,850"
    assert joined(catalog, "gauges.tsv")[1].startswith("gauge,level\nG-1,0.42")


def test_markdown_headings(catalog):
    rows, _ = joined(catalog, "river.md")
    assert [r["locator"] for r in rows] == ["Survey", "Instruments", "Errors"]
    assert rows[0]["title"] == "Survey"
    assert rows[1]["text"] == "Instruments\n\nA weighted line and a notebook."


def test_json(catalog):
    rows, text = joined(catalog, "soundings.json")
    assert "depth: 2.25" in text and "bed.kind: coarse gravel" in text
    assert rows[0]["locator"] == "records 1-2" and rows[0]["page_count"] == 2
    assert "hour: 10" in joined(catalog, "tides.jsonl")[1]


def test_html(catalog):
    rows, text = joined(catalog, "harbour.html")
    assert text == "Harbour Survey\nFindings\nThe dredged channels silted quickly."
    assert rows[0]["title"] == "Harbour Survey" and rows[0]["locator"] == "part 1"


def test_pages(catalog):
    rows, _ = joined(catalog, "birds.pdf")
    assert [(r["ordinal"], r["locator"]) for r in rows] == [(0, "page 1"), (1, "page 2")]
    assert rows[0]["page_count"] == 2
    assert joined(catalog, "sign.pdf")[0] == []


def test_sheets(catalog):
    rows, _ = joined(catalog, "buoys.xlsx")
    assert [(r["locator"], r["text"]) for r in rows] == [
        ("sheet 'North'", "buoy,chain\nred,18\ngreen,"), ("sheet 'South'", "none laid,yet"),
    ]


def test_blocks(catalog):
    rows, text = joined(catalog, "stores.docx")
    assert text == "Stores on hand\n\npart,stock\nshackle,57"
    assert rows[0]["title"] == "Stores on hand" and rows[0]["locator"] == "block 1"


def test_image_uses_the_tiers_model(catalog):
    rows, text = joined(catalog, "pier.png")
    assert text == "No mooring, read by gpt-4o-mini" and rows[0]["locator"] == "image"
    stored = catalog.table("doc_metadata").collect()
    assert [(r["key"], r["value"]) for r in stored] == [("vision_model", "gpt-4o-mini")]


def test_high_tier_reads_blank_pages(spark, folder, extracted):
    found = extract(list_folder(spark, str(folder)), folder_content(spark, str(folder)), "high", transcribe=sign_factory, **extracted)
    seen = found.chunks.filter(F.col("locator") == "page 1 (ocr)").collect()
    assert [r["text"] for r in seen] == ["No mooring, read by gpt-4o"]
    counted = {r["value"] for r in found.metadata.collect() if r["key"] == "ocr_pages"}
    assert counted == {"1"}


def test_rejects_do_not_stop_a_run(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"a": \n{"b": 1}')
    (tmp_path / "good.txt").write_text("fine")
    (tmp_path / "x.pdf").write_bytes(b"%PDF")
    (tmp_path / "x.png").write_bytes(b"png")
    made = Catalog(spark, str(tmp_path / "cat"), parts=2)
    totals = ingest_folder(made, f"{tmp_path}/*.*")
    assert (totals.documents, totals.chunks, totals.failed) == (1, 1, 3)


def test_second_run_skips_and_full_run_changes_nothing(spark, folder, extracted, catalog):
    before = sorted(map(tuple, catalog.table("chunks").collect()))
    again = ingest_folder(catalog, str(folder), transcribe=sign_factory, **extracted)
    assert again.documents == 0
    full = ingest_folder(catalog, str(folder), full=True, transcribe=sign_factory, **extracted)
    assert full.documents == 14
    assert catalog.table("documents").count() == 14
    assert sorted(map(tuple, catalog.table("chunks").collect())) == before


def test_versions_by_source(catalog):
    documents = catalog.table("documents")
    assert upserts.existing_versions(documents, "local").count() == 14
    assert upserts.existing_versions(documents, "gdrive").count() == 0


def test_changed_file_replaces_its_rows(spark, tmp_path):
    import os

    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("first version")
    (source / "b.txt").write_text("untouched")
    made = Catalog(spark, str(tmp_path / "cat"), parts=3)
    ingest_folder(made, str(source))
    (source / "a.txt").write_text("second version")
    os.utime(source / "a.txt", (2_000_000_000, 2_000_000_000))
    assert ingest_folder(made, str(source)).documents == 1
    texts = {r["text"] for r in made.table("chunks").collect()}
    assert texts == {"second version", "untouched"}
    terms = {r["term"] for r in made.table("term_stats").collect()}
    assert terms == {"second", "version", "untouch"}
    (source / "b.txt").write_text("changed")
    os.utime(source / "b.txt", (2_000_000_000, 2_000_000_000))
    ingest_folder(made, str(source), keep_history=True)
    assert made.table("documents").count() == 3


def test_broken_files_are_rejects(spark, tmp_path):
    (tmp_path / "bare.csv").write_bytes(b'a,b\n1,"x\ry"\n2,z\rw\n')
    (tmp_path / "long.csv").write_text("a,b\n1," + "x" * 200_000 + "\n")
    (tmp_path / "deep.json").write_text("[" * 50_000)
    (tmp_path / "null.csv").write_bytes(b"a\x00,b\n1,2\n")
    (tmp_path / "good.txt").write_text("fine")
    made = Catalog(spark, str(tmp_path / "cat"), parts=2)
    totals = ingest_folder(made, f"{tmp_path}/*.*")
    failed = {r["local_path"].rpartition("/")[2] for r in totals.rejects.collect()}
    assert "deep.json" in failed and not failed & {"long.csv", "good.txt"}
    known = {r["filename"] for r in made.table("documents").collect()}
    assert {"long.csv", "good.txt"} <= known and not known & failed
    longest = max(len(r["text"]) for r in made.table("chunks").collect())
    assert longest > 200_000


def test_a_run_that_dies_is_repeated(spark, tmp_path, monkeypatch):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("words of the first file")
    made = Catalog(spark, str(tmp_path / "cat"), parts=2)
    real = Catalog.refresh_statistics

    def dies(self, parts):
        raise RuntimeError("executor lost")

    monkeypatch.setattr(Catalog, "refresh_statistics", dies)
    try:
        ingest_folder(made, str(source))
    except RuntimeError:
        pass
    assert made.table("documents").count() == 0
    monkeypatch.setattr(Catalog, "refresh_statistics", real)
    assert ingest_folder(made, str(source)).documents == 1
    assert made.table("chunks").count() == 1 and made.table("term_stats").count() > 0
    assert ingest_folder(made, str(source)).documents == 0


def test_models_are_called_once_per_input(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    source = tmp_path / "in"
    source.mkdir()
    for name in ("a", "b", "c"):
        (source / f"{name}.txt").write_text(f"text of {name} " * 5)
    (source / "x.png").write_bytes(b"png")

    def factory(kind):
        def make(model):
            def answer(inputs):
                import uuid

                for _ in inputs:
                    (calls / f"{kind}-{uuid.uuid4().hex}").touch()
                return [["Tag"] if kind == "tag" else kind for _ in inputs]

            return answer

        return make

    made = Catalog(spark, str(tmp_path / "cat"), parts=2)
    ingest_folder(made, str(source), effort="high", transcribe=factory("see"),
                  summarise=factory("sum"), tag=factory("tag"))
    kinds = [p.name[:3] for p in calls.iterdir()]
    assert (kinds.count("see"), kinds.count("sum"), kinds.count("tag")) == (1, 4, 4)
    assert {r["summary"] for r in made.table("documents").collect()} == {"sum"}


def test_failed_pages_are_rejects(spark, folder, extracted):
    def factory(model):
        def fails(paths):
            raise OSError("no such image")

        return fails

    found = extract(list_folder(spark, str(folder)), folder_content(spark, str(folder)),
                    "high", transcribe=factory, **extracted)
    errors = [r["error"] for r in found.rejects.collect() if "sign.pdf" in r["local_path"]]
    assert errors == ["page 1: OSError: no such image"]
    counted = [r for r in found.metadata.collect() if r["key"] == "ocr_pages"]
    assert counted == []
