"""One folder, one catalog, one manifest: the steps of a small knowledge base."""

from __future__ import annotations

from datetime import datetime

from folioscan.operators.manifest import manifest_entries, write_manifest
from folioscan.plans.ingest import IngestTotals, ingest_folder
from folioscan.sources.catalog import Catalog


def write_index(catalog: Catalog, path: str, title: str = "Resources Index") -> None:
    """Write the manifest of a catalog."""
    entries = manifest_entries(
        catalog.table("documents"), catalog.table("chunks"), catalog.table("tags")
    )
    write_manifest(entries, path, title, f"{datetime.now():%Y-%m-%d %H:%M}")


def ingest_and_index(
    catalog: Catalog, folder: str, index_path: str, effort: str = "high", **options
) -> IngestTotals:
    """Ingest a folder and write its manifest anew."""
    totals = ingest_folder(catalog, folder, effort=effort, **options)
    write_index(catalog, index_path)
    return totals
