"""Session settings the jobs rely on."""

from __future__ import annotations

import os
import shutil
import tempfile
from importlib import import_module

from pyspark.sql import SparkSession

_shipped: set[tuple[str, str]] = set()


def local_session(cores: str | int = "*", memory: str = "8g") -> SparkSession:
    """A session for tests and small data; a cluster brings its own."""
    cores = os.environ.get("BENCH_CPUS", cores)
    partitions = os.cpu_count() if cores == "*" else int(cores)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("folioscan")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_packages(spark: SparkSession, *packages: str) -> None:
    """Send Python packages to the workers, once per application.

    Functions that run in tasks are pickled by name, so workers must be able to
    import them wherever the driver was started.
    """
    application = spark.sparkContext.applicationId
    for package in packages:
        if (application, package) in _shipped:
            continue
        folder = os.path.dirname(os.path.abspath(import_module(package).__file__))
        target = os.path.join(tempfile.mkdtemp(prefix="folioscan-"), package)
        spark.sparkContext.addPyFile(shutil.make_archive(
            target, "zip", root_dir=os.path.dirname(folder), base_dir=package
        ))
        _shipped.add((application, package))
