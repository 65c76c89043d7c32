"""Stage tables: intermediate results written to the cluster's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..session import checkpoint_dir


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table and read it back.

    Cuts the lineage: branches that share the result read it instead of recomputing it,
    plans stay small, and a lost executor only costs its own tasks.  The folder is the
    one the cluster names, so the files outlive any executor.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
