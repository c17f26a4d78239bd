import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from folioscan.session import local_session, ship_packages  # noqa: E402
from tests.helpers import sign_factory, toy_factory  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(cores=4, memory="4g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    ship_packages(session, "folioscan", "checks", "tests")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    return session


@pytest.fixture(scope="session")
def folder(tmp_path_factory):
    """A harbour survey in fourteen files of eight types; binary formats are stand-ins."""
    d = tmp_path_factory.mktemp("survey")
    texts = {
        "berths.csv": "port,berths\nOslo,12\nCork,7\n",
        "gauges.tsv": "gauge\tlevel\nG-1\t0.42\nG-2\t1.08\n",
        "river.md": "# Survey\n\nHow depths were taken.\n\n## Instruments\n\nA weighted line and "
                    "a notebook.\n\n## Errors\n\nCurrents bend the line.\n",
        "soundings.json": '[{"station": 4, "depth": 3.5, "bed": {"kind": "coarse gravel"}},'
                          ' {"station": 5, "depth": 2.25, "bed": {"kind": "silt"}}]',
        "tides.jsonl": '{"tide": "low", "hour": 4}\n{"tide": "high", "hour": 10}\n',
        "harbour.html": "<html><head><title>Harbour Survey</title><style>p{margin:0}</style></head>"
                        "<body><h2>Findings</h2><p>The dredged channels silted quickly.</p>"
                        "<script>let n = 1 < 2</script></body></html>",
        "log.txt": "Channel log: dredging and silting, week by week.\n",
    }
    for name, text in texts.items():
        (d / name).write_text(text, encoding="utf-8")
    (d / "flow.csv").write_bytes("rivière;débit\nRhône;1700\nLoire;850\n".encode("cp1252"))
    for name in ("buoys.xlsx", "birds.pdf", "sign.pdf", "note.docx", "stores.docx",
                 "pier.png", "unknown.zip"):
        (d / name).write_bytes(b"\x00binary")
    return d


@pytest.fixture(scope="session")
def extracted(spark, folder):
    """What other tools extracted from the binary files."""
    def path(name):
        return f"file:{folder / name}"

    return {
        "pages": spark.createDataFrame([
            (path("birds.pdf"), 1, "Heron watches shallow water", None),
            (path("birds.pdf"), 2, "and the ferry passes", None),
            (path("sign.pdf"), 1, " \n", "sign-1.png"),
        ], "local_path string, page_no bigint, text string, image string"),
        "sheets": spark.createDataFrame([
            (path("buoys.xlsx"), 0, "North", 0, ["buoy", "chain"]),
            (path("buoys.xlsx"), 0, "North", 1, [None, ""]),
            (path("buoys.xlsx"), 0, "North", 2, ["red", "18"]),
            (path("buoys.xlsx"), 0, "North", 3, ["green", None]),
            (path("buoys.xlsx"), 1, "South", 0, ["none laid", "yet"]),
        ], "local_path string, sheet_no int, sheet string, row_no bigint, cells array<string>"),
        "blocks": spark.createDataFrame([
            (path("note.docx"), 0, "para", "Note on herons", None),
            (path("note.docx"), 1, "para", "", None),
            (path("note.docx"), 2, "para", "One heron was counted at the weir.", None),
            (path("stores.docx"), 0, "para", "Stores on hand", None),
            (path("stores.docx"), 1, "table", None,
             [["part", "stock"], ["", " "], ["shackle", "57"]]),
        ], "local_path string, block_no bigint, kind string, text string, "
           "cells array<array<string>>"),
    }


@pytest.fixture(scope="session")
def catalog(spark, folder, extracted, tmp_path_factory):
    """A catalog of the survey folder, low tier, without vectors."""
    from folioscan.plans.ingest import ingest_folder
    from folioscan.sources.catalog import Catalog

    made = Catalog(spark, str(tmp_path_factory.mktemp("catalog")), parts=4)
    made.totals = ingest_folder(
        made, str(folder), effort="low", transcribe=sign_factory, **extracted
    )
    return made


@pytest.fixture(scope="session")
def embedded(spark, folder, extracted, tmp_path_factory):
    """The same with vectors of a caller's model."""
    from folioscan.plans.backfill import backfill
    from folioscan.plans.ingest import ingest_folder
    from folioscan.sources.catalog import Catalog

    made = Catalog(spark, str(tmp_path_factory.mktemp("embedded")), parts=4)
    ingest_folder(made, str(folder), effort="low", transcribe=sign_factory, **extracted)
    made.written = backfill(made, "toy-model", toy_factory, parts_per_commit=2)
    return made
