"""Where intermediate tables go."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the shared folder the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, a session in one process (``local[...]``) gets a temporary folder of this machine; on a cluster,
    whose executors could not see it, that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")) is None:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="seriesloom-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
