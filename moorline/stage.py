"""Written stages in the cluster's shared folder, and this package's modules on the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package's modules to the executors, which needn't have it installed."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    top = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp()) / f"{top.name}_modules.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(archive))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder URI below the cluster's shared folder (spark.checkpoint.dir)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        # Only tests and local sessions come here: a cluster names its shared folder.
        base = spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    if "://" not in base and not base.startswith("file:"):
        base = "file://" + os.path.abspath(base)
    if base.startswith("file:/") and not base.startswith("file://"):
        base = "file://" + base[len("file:") :]
    return f"{base.rstrip('/')}/moorline/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and returns the reread table: lineage ends here."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stage_path = path
    return out


def discard(*stages: DataFrame) -> None:
    """Deletes tables that materialise has written, once nothing that is still to be computed reads them."""
    for s in stages:
        remove(s.sparkSession, s.stage_path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that materialise or an operator has written."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
