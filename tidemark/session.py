"""Session settings that the engine relies on."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configured(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session; on a cluster pass the cluster's own session to the operators instead."""
    builder = configured(SparkSession.builder.master(f"local[{cores}]"))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once a context, so that their Python can import it wherever the driver runs."""
    context = spark.sparkContext
    if getattr(context, "_tidemark_shipped", False) or "tidemark" in spark.conf.get("spark.submit.pyFiles", ""):
        return
    root = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark_package.zip"
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(at))
    context._tidemark_shipped = True
