"""Session helpers: shipping this package to executors and reading tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors once per application.

    The archive is served by the driver's own file server, so executors need no
    shared folder and no installation. Rows may hold long texts, so where the session still has
    Spark's own bounds on an Arrow batch, it gets smaller ones in rows and in bytes.
    """
    for name, default, smaller in (("maxRecordsPerBatch", "10000", "2000"), ("maxBytesPerBatch", "67108864b", "8m")):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}", default) == default:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", smaller)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = os.path.realpath(tempfile.mkdtemp(prefix="ship"))
    target = os.path.join(folder, f"{root.name}_src.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, str(path.relative_to(root.parent)))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointing(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Only a local master may have an own temporary one where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if named or not held.isEmpty():
        return named or held.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(os.path.realpath(tempfile.mkdtemp(prefix="checkpoint")))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark removes an execution's shuffle files when the execution has ended; its result must be on disk by then."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """The same rows with the lineage cut by a reliable checkpoint."""
    checkpointing(df.sparkSession)
    with shuffles_dropped(df.sparkSession):
        return df.checkpoint(eager=True)


def deleted(spark: SparkSession, paths: list[str]) -> None:
    """Remove files or folders, on whatever file system they lie."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Folders of the tables that written() made and nothing has removed yet.
_TABLES: list[str] = []


def written(df: DataFrame) -> DataFrame:
    """The same rows as a table in the shared folder, which cuts the lineage; columns are compressed, unlike a checkpoint's rows."""
    spark = df.sparkSession
    path = f"{checkpointing(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    _TABLES.append(path)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """The same rows as a table that is dealt by the key, so that joins with it shuffle the other side alone."""
    spark = df.sparkSession
    parts, name = int(spark.conf.get("spark.sql.shuffle.partitions")), uuid.uuid4().hex
    path = f"{checkpointing(spark).rstrip('/')}/tables/{name}"
    _TABLES.append(path)
    with shuffles_dropped(spark):
        df.repartition(parts, key).write.bucketBy(parts, key).option("compression", "zstd").option("path", path).saveAsTable(f"evidentia_{name}", format="parquet")
    return spark.table(f"evidentia_{name}")


def tables() -> set[str]:
    """The folders of all tables that are still there."""
    return set(_TABLES)


def forget(spark: SparkSession, paths: set[str]) -> None:
    """Remove tables whose rows are in another one by now."""
    for path in sorted(paths):
        spark.sql(f"DROP TABLE IF EXISTS evidentia_{path.rsplit('/', 1)[1]}")
    deleted(spark, sorted(paths))
    _TABLES[:] = [t for t in _TABLES if t not in paths]


def forget_but(spark: SparkSession, before: set[str], *kept: DataFrame) -> None:
    """Remove the tables that were written since `before`, but for those that the kept frames read."""
    used = "\n".join(f for df in kept for f in df.inputFiles())
    forget(spark, {t for t in tables() - before if t.rsplit("/", 1)[1] not in used})
