"""Session construction and the shared working folder of a job."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIRS: dict[str, str] = {}


def local_session(cpus: int | str = 8, memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("docweave")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.files.maxPartitionBytes", "2m")
        .config("spark.sql.files.openCostInBytes", "256k")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only a local master may go without the setting: it then gets a temporary folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="docweave-")
    return _LOCAL_DIRS[app]


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if it has fewer partitions: a small single file is one task otherwise. Larger tables stay."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df with all rows of equal keys in one task, for steps that walk sorted partitions.

    By a hash of the keys, as repartition(*keys) is left out over a join by the same keys, whose rows adaptive execution
    may then leave where they were read or part by size: a walk asks for no distribution of its own.
    """
    return df.repartition(F.xxhash64(*keys))


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docweave/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the files of materialized frames that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        root = f"{shared_dir(spark)}/docweave/".split(":")[-1].lstrip("/")
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            if root in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)


@contextmanager
def bounded_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> Iterator[None]:
    """Arrow batches of at most so many rows and bytes inside the block, for steps that are run within it."""
    wanted = {"maxRecordsPerBatch": str(rows), "maxBytesPerBatch": size}
    names = {f"spark.sql.execution.arrow.{k}": v for k, v in wanted.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
