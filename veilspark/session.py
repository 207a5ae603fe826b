"""Session helpers: a local session for tests, and shipping the package to Python workers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


#: Bytes of an Arrow batch, so that long texts don't fill a worker's memory; a session that asks for fewer keeps its own.
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor (once per application), and bound the batches that they get."""
    context = spark.sparkContext
    asked = int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB"))
    if not 0 < asked <= BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="veilspark-ship-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.  Where it is unset, a local session gets a folder of its own and a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="veilspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read back: made once however often it is used, and a lost executor costs a task."""
    path = f"{shared_dir(df.sparkSession)}/veilspark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of a table for each core, up to which it is dealt anew: its files may have fewer pieces than there are cores.
SMALL = 32 << 20


def spread(df: DataFrame, piece: int | None = None) -> DataFrame:
    """``df`` dealt over the cores where it is so small that its files would keep a few of them busy only; a large one stays as it is read, or with ``piece`` is dealt into pieces of so many bytes (narrow rows from which long texts are made)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if piece is not None:
        return df.repartition(max(2 * cores, min(size // piece, 10000)))
    return df.repartition(2 * cores) if size < cores * SMALL else df
