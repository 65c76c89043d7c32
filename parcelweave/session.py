"""Session settings used when the caller has not made a session."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cores: str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("parcelweave")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """This package for the executors, once for each application, so their tasks can import it."""
    root = Path(__file__).resolve().parents[1]
    if spark.sparkContext.applicationId not in _shipped and root.is_dir() and not spark.sparkContext.master.startswith("local["):
        _shipped.add(spark.sparkContext.applicationId)
        spark.sparkContext.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/parcelweave_core", "zip", root, "parcelweave"))


def code_table(spark: SparkSession, rows: list[tuple], schema: str):
    """Rows fixed in the code as a relation whose exact size the optimiser knows."""
    names = [c.strip().split(" ") for c in schema.split(",")]

    def literal(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return str(v).lower() if isinstance(v, bool) else f"{v!r}D" if isinstance(v, float) else str(v)

    listed = ", ".join("(" + ", ".join(f"CAST({literal(v)} AS {t})" for v, (_, t) in zip(r, names)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {listed} AS t({', '.join(n for n, _ in names)})")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only on a single machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not path:
        path = tempfile.mkdtemp(prefix="spark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path
