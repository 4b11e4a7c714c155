"""Cutting a plan's lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the folder that driver and executors share (``spark.checkpoint.dir``; a temporary one where that is unset, as
    in tests) and read it back."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="tidewater-")
    path = f"{root.rstrip('/')}/{spark.sparkContext.applicationId}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
