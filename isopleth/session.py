"""Session settings and the delivery of this package to executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let Spark send this package to every executor, once an application.

    Kernels are pickled by reference, so Python workers must be able to import
    the package wherever the driver was started.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).parent
    folder = tempfile.mkdtemp(prefix="isopleth-zip-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/isopleth_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)
