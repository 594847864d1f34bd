"""Sending this package to the executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Bounds of an Arrow batch where the session has Spark's defaults, as whole texts and shingle sets are large: setting, default, ours.
BATCHES = (
    ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"),
    ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "1048576b"),
)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` of the session. Where it is unset, a temporary folder is taken
    for a local master (driver and executors are one process there) and otherwise an error is raised.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    path = f"file://{tempfile.mkdtemp(prefix='corvane-')}"
    spark.sparkContext.setCheckpointDir(path)
    return path


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in the Python workers, once per application, and keep Arrow batches small unless the session says otherwise."""
    for setting, default, own in BATCHES:
        if spark.conf.get(setting) == default:  # with a value for unset ones, get() gives that and not Spark's default
            spark.conf.set(setting, own)
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="corvane-")) / "corvane_package.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        context.addPyFile(str(target))
        _shipped.add(context.applicationId)
    return spark


def frozen(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, so that what made it runs once, even if executors are lost. The caller or the operator of the folder deletes it."""
    path = f"{shared_dir(df.sparkSession)}/corvane/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where its scan has fewer partitions than these (a small file, say); large inputs are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
