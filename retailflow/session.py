"""Session helpers: a default local session and shipping the package to executors."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def get_session(app: str = "retailflow", cpus: int | None = None) -> SparkSession:
    """A local session with the settings that the library assumes.

    Java charsets are allowed so that windows-1251 exports can be read by the CSV source.
    """
    cpus = cpus or os.cpu_count() or 4
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.legacy.javaCharsets", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Make the package importable in Python workers, once for each application.

    The sources go through Spark's own file server, so no path needs to be shared.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, str(p.relative_to(PACKAGE.parent)))
    folder = tempfile.mkdtemp(prefix="retailflow-")
    target = os.path.join(folder, "retailflow_src.zip")
    Path(target).write_bytes(data.getvalue())
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)
