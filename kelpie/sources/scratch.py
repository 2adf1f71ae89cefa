"""Tables that a run writes for itself."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder below the one that the cluster names in ``spark.checkpoint.dir``; with a local master and none named, on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.gettempdir()}/kelpie-scratch"
    return f"{root.rstrip('/')}/kelpie-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, at: str | None = None) -> DataFrame:
    """``df`` as a table: lineage ends here and survives lost executors."""
    at = at or folder(df.sparkSession)
    df.write.parquet(f"{at}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{at}/{name}")
