"""Where intermediate tables are written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder.

    Only a local session without that setting gets a temporary folder of its
    own; on a cluster without it there is no folder to share, an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="learnmart-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/learnmart/{name}-{uuid.uuid4().hex}"
