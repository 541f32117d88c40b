"""Session settings and the folder shared by all executors."""

from __future__ import annotations

import io
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "halyard", cpus: int | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller's session is used as it is."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.driver.memory", os.environ.get("HALYARD_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a local one where that is unset and all runs in one JVM (tests).

    Without the setting a cluster has no such folder: executors would write to disks of their own. That is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        where = spark.conf.get("halyard.local.dir", None)
        if not where:
            where = tempfile.mkdtemp(prefix="halyard-")
            spark.conf.set("halyard.local.dir", where)
    return re.sub(r"^file:/+", "file:///", where).rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


_KEPT: set[str] = set()


def run_dir(spark: SparkSession, part: str = "tables") -> str:
    """This application's folder in the shared one, which goes when the application ends; see also clean."""
    path = f"{shared_dir(spark)}/halyard-{spark.sparkContext.applicationId}"
    if path not in _KEPT:
        at, system = _hadoop(spark, path)
        system.mkdirs(at)
        system.deleteOnExit(at)
        _KEPT.add(path)
    return f"{path}/{part}"


def clean(spark: SparkSession) -> None:
    """Removes all that this application's queries wrote so far; results that were not yet consumed can't be read after it."""
    at, system = _hadoop(spark, run_dir(spark))
    system.delete(at, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage, survives lost executors, costs no cache."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the package to the executors, which may not have it on their path; once per application, by the shared folder."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path("halyard") / p.relative_to(root))
    path = f"{run_dir(spark, 'ship')}/halyard.zip"
    at, system = _hadoop(spark, path)
    out = system.create(at, True)
    out.write(bytearray(packed.getvalue()))
    out.close()
    sc.addPyFile(path.removeprefix("file://"))
    _SHIPPED.add(sc.applicationId)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores at least, for work that costs far more than its input's size: one small
    file would else be one task. Inputs that are in enough partitions already, as all large ones, are not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
