"""Send this package to the executors where they can't import it already."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package as a zip file of Python modules, once for an application, unless PYTHONPATH has it."""
    root = Path(__file__).resolve().parents[2]
    app = spark.sparkContext.applicationId
    paths = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if app in _sent or root in paths:
        return
    out = Path(tempfile.mkdtemp(prefix="veldra-code-")) / "veldra_code.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted((root / "veldra").rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(out))
    _sent.add(app)
