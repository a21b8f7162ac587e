"""Written intermediate tables: what loops and multi-pass operators stand on.

A table written to the shared folder cuts the lineage and survives a lost executor, unlike a local
checkpoint; the plan of the next step starts from a scan, so it doesn't grow with the number of steps.

All tables of an application are in a folder of their own.  Loops delete theirs as they go; the others stay while a lazy
result may read them, and go with ``cleanup``, which also runs when Python ends with the session still open.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without it gets a temporary folder."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or None
    if named is None:
        current = sc._jsc.sc().getCheckpointDir()
        named = current.get() if current.isDefined() else None
    if named is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="vertexloom-")
        sc.setCheckpointDir(named)
    return named


def work_folder(spark: SparkSession) -> str:
    """This application's folder in the shared one."""
    path = f"{shared_folder(spark)}/vertexloom-{spark.sparkContext.applicationId}"
    if path not in _folders:
        _folders.append(path)
        atexit.register(_quietly, spark, path)
    return path


_folders: list[str] = []


def cleanup(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; results that weren't read yet can't be read afterwards."""
    _delete(spark, work_folder(spark))


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _quietly(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:  # a stopped session leaves its folder
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001, S110 - the JVM may be gone by now
            pass


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the work folder and read it again."""
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.staged_path = path
    return written


def bucketed(df: DataFrame, name: str, column: str) -> DataFrame:
    """Write ``df`` bucketed by ``column``, with a bucket for each shuffle partition, and read it again.

    A join or an aggregation on that column then moves the other side alone, however often it is done.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{work_folder(spark)}/{table}"
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(count, column)
    dealt.write.option("compression", "zstd").option("path", path).bucketBy(count, column).sortBy(column).saveAsTable(table)
    written = spark.table(table)
    written.staged_path, written.staged_table = path, table
    return written


def discard(staged: DataFrame) -> None:
    """Delete the files of a staged table that nothing will read again; other frames are left alone."""
    path = getattr(staged, "staged_path", None)
    if getattr(staged, "staged_table", None) is not None:
        staged.sparkSession.sql(f"DROP TABLE IF EXISTS {staged.staged_table}")
    if path is not None:
        _delete(staged.sparkSession, path)


class Levels:
    """A table that grows by one written part per step and is read as a whole."""

    def __init__(self, spark: SparkSession, name: str, schema: str) -> None:
        self.spark, self.schema, self.paths = spark, schema, []
        self.root = f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def append(self, df: DataFrame) -> DataFrame:
        """Write one part; returns that part."""
        path = f"{self.root}/{len(self.paths)}"
        df.write.option("compression", "zstd").parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(self.schema).parquet(path)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.paths)
