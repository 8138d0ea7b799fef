"""Tables that cut lineage, in the folder all executors share. They stay until the folder is cleaned, as results are read from them later."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, one of the session's own, if all executors are threads of the driver."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        found = _own.setdefault(app, "") or "file://" + tempfile.mkdtemp(prefix="strandline-")
        _own[app] = found
    return found.rstrip("/")


def ship(spark: SparkSession) -> str:
    """Send this package to the executors of a cluster where it isn't installed; returns the archive's path on the driver."""
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="strandline-code-")) / "strandline.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
    return str(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table that has been written: later reads don't compute it again, and a lost executor costs none of it."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
