"""Written tables and named views."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A local session that names none gets its own temporary folder; a cluster session must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerlens-"))
    return context.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; two calls never return the same one."""
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/ledgerlens/{app}/{uuid.uuid4().hex}/{name}"


def materialise(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table, replacing what was there, and read it back.

    The table cuts the lineage: a lost executor costs a re-read, not a rebuild of all that led to it. A new
    version is written whole beside the old one, and then takes its place by renaming, so a build that
    fails leaves the old table and no reader meets half of one: who has listed the files replaced gets an
    error and reads again. A swap cut off between its two renames is made good by the next build. Stores
    without renaming copy there. ``df`` may read the very table.
    """
    spark = df.sparkSession
    fs, target = _file_system(spark, path)
    folder, name = target.getParent(), target.getName()
    version = uuid.uuid4().hex
    before = _versions(spark, path)
    if before and not fs.exists(target):  # a swap was cut off between its two steps
        fs.rename(before.pop().getPath(), target)
    fresh, old = (spark._jvm.org.apache.hadoop.fs.Path(folder, f"_{name}.{kind}-{version}") for kind in ("new", "old"))
    try:
        df.write.partitionBy(*(partition_by or [])).mode("overwrite").parquet(fresh.toString())
    except BaseException:
        fs.delete(fresh, True)
        raise
    if fs.exists(target):
        _renamed(fs, target, old)
    _renamed(fs, fresh, target)
    for stale in (*[v.getPath() for v in before], old):
        fs.delete(stale, True)
    return spark.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _versions(spark: SparkSession, path: str) -> list:
    """Replaced versions beside a table, oldest first."""
    fs, target = _file_system(spark, path)
    if not fs.exists(target.getParent()):
        return []
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_{target.getName()}.old-*"))
    return sorted(found or [], key=lambda status: status.getModificationTime())


def _renamed(fs, source, target) -> None:
    if not fs.rename(source, target):
        raise OSError(f"could not rename {source} to {target}")


def register_view(df: DataFrame, name: str) -> DataFrame:
    """Name ``df`` for SQL; the view stays lazy."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table and what is left of replaced ones, wherever Spark can reach it."""
    fs, target = _file_system(spark, path)
    for version in _versions(spark, path):
        fs.delete(version.getPath(), True)
    fs.delete(target, True)
