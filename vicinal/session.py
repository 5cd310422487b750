"""Session and table helpers shared by the queries, the bench and the tests."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "vicinal", cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that the library assumes (UTC, AQE)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        # The JVM does not compile larger methods; beyond it, Spark splits wide projections into small ones.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out over all cores if its scan has fewer splits: for costly work on a small file. Large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset, a
    folder of the machine's own is set once, but only if all of Spark runs on
    that machine.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="vicinal-shared-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark).rstrip('/')}/vicinal/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table of the shared folder: it cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, in whatever store it lies; one that is not there is no error."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard_scratch(spark: SparkSession) -> None:
    """Remove every table and bundle that this library has put below the shared folder.

    To be called when the results that were asked for are stored elsewhere:
    results that have not been written read these tables.
    """
    remove(spark, f"{shared_dir(spark).rstrip('/')}/vicinal")


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors, once a Spark context.

    A session may have been started from another folder, or on machines where
    the package is not installed.
    """
    context = spark.sparkContext
    if getattr(context, "_vicinal_shipped", False):
        return
    source = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="vicinal-package-")
    context.addPyFile(shutil.make_archive(f"{folder}/vicinal", "zip", source.parent, source.name))
    context._vicinal_shipped = True
