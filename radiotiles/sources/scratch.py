"""Where intermediate tables go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """A folder of this application under `spark.checkpoint.dir`, which the cluster shares; on a local master
    without that setting, a temporary one of this session.  A cluster without it is an error."""
    root, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="radiotiles-"))
    return f"{root}/radiotiles-{app}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, **options: int) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here, and a lost executor
    costs a re-read, not a recomputation.  `options` are those of the Parquet writer."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
