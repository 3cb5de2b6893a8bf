"""Sessions, and the package on every worker."""

from __future__ import annotations

import io
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from sagebrook.storage import shared_folder

#: Settings for a large cluster; a session given by the caller is never altered.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}


def session(name: str = "sagebrook", **settings: str) -> SparkSession:
    """A session with the package's settings; ``settings`` win."""
    builder = SparkSession.builder.appName(name)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Make the package importable in Python workers; once a session."""
    if not getattr(spark, "_sagebrook_shipped", False):
        root = Path(__file__).resolve().parent
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
            for file in sorted(root.rglob("*.py")):
                archive.write(file, file.relative_to(root.parent))
        jvm, name = spark.sparkContext._jvm, f"{shared_folder(spark)}/sagebrook-{uuid.uuid4().hex}.zip"
        target = jvm.org.apache.hadoop.fs.Path(name)
        out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
        out.write(bytearray(held.getvalue()))
        out.close()
        spark.sparkContext.addPyFile(name)
        spark._sagebrook_shipped = True
    return spark
