"""Session helpers shared by every layer: builder defaults, worker import path, durable intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)
#: Bytes of a batch for Python workers, where the session names no bound of its own.
BATCH_BYTES = 8 << 20


def build(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the defaults the library expects (UTC, AQE on)."""
    builder = (
        SparkSession.builder.master(master)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started from.

    Batches for Python are bounded in bytes, as rows may be long texts: with Spark's own bound a batch, its copies and what
    is made of it can fill a worker. A bound that the session names already is left alone; so is the number of rows.
    """
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if bound not in spark.conf.getAll:
        spark.conf.set(bound, str(BATCH_BYTES))
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, have)])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Unset, a temporary one serves a local master only (tests)."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tessera-")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage ends here.

    A lost executor loses nothing of it, and each later read prunes columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._durable_path = path  # so that ``release`` needs no listing of files
    return out


def release(*tables: DataFrame) -> None:
    """Delete the files of tables made by ``durable`` once nothing reads them any more; other tables are left alone."""
    for df in tables:
        name = getattr(df, "_durable_path", None)
        if name:
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
