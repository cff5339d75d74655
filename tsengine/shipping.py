"""Makes the package importable in Python workers, wherever they run."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors of the session's application, once."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent
    # executors fetch the archive from the driver as long as the application runs
    folder = tempfile.mkdtemp(prefix="tsengine")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "tsengine.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(top.rglob("*.py")):
            out.write(path, path.relative_to(top.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
