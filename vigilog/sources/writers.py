"""Sinks: events, reports, alerts, models."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write_events(df: DataFrame, path: str, kind: str = "parquet", time: str | None = None, cluster_by: str | None = None) -> None:
    """Events as Parquet, JSON lines or CSV, in folders by date if a time column is given, rows of a key together."""
    if time:
        df = df.withColumn("date", F.to_date(time))
        df = df.repartition("date", *([cluster_by] if cluster_by else [])).sortWithinPartitions("date", *([cluster_by] if cluster_by else []), time)
    writer = df.write.mode("overwrite")
    writer = writer.partitionBy("date") if time else writer
    if kind == "csv":
        writer = writer.option("header", True)
    writer.format(kind).save(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def alert_sink(path: str, kind: str = "json") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch of alerts is written to a folder of its own and then committed by a file that names the folder.

    read_alerts() sees committed folders only, so that nobody sees a batch which was half written when its writer was
    killed. A batch that runs again is written anew and takes its number's place at once; what it replaces goes.
    Only Hadoop's file systems are used, as by Spark's own writers.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        folder = f"batch={number}-{uuid.uuid4().hex}"
        batch.write.format(kind).save(f"{path}/data/{folder}")
        files = _Files(spark, path)
        before = files.text(f"commits/{number}")
        files.put(f"commits/{number}", folder)
        if before:
            files.delete(f"data/{before}")

    return write


def read_alerts(spark: SparkSession, path: str, schema: StructType | str, kind: str = "json") -> DataFrame:
    """The alerts of all committed batches under path; none if nothing has been committed."""
    files = _Files(spark, path)
    folders = [f"{path}/data/{files.text(f'commits/{n}')}" for n in files.names("commits")]
    read = spark.read.schema(schema).format(kind)
    return read.load(folders) if folders else spark.createDataFrame([], schema)


class _Files:
    """Small files under a folder, by Hadoop's file system from the driver."""

    def __init__(self, spark: SparkSession, base: str):
        self.base, self.hadoop = base, spark._jvm.org.apache.hadoop
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)

    def text(self, name: str) -> str | None:
        if not self.fs.exists(self._path(name)):
            return None
        stream = self.fs.open(self._path(name))
        try:
            return self.hadoop.io.IOUtils.readFullyToByteArray(stream).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """The file as a whole, or as it was: written aside, then moved onto its place."""
        aside = self._path(f"{name}.{uuid.uuid4().hex}.tmp")
        stream = self.fs.create(aside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.fs.delete(self._path(name), False)
        if not self.fs.rename(aside, self._path(name)):
            raise OSError(f"can't commit {name}")

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def names(self, folder: str) -> list[str]:
        if not self.fs.exists(self._path(folder)):
            return []
        found = (f.getPath().getName() for f in self.fs.listStatus(self._path(folder)))
        return sorted(x for x in found if x.isdigit())


def save_tables(tables: dict[str, DataFrame], path: str) -> None:
    """A model as Parquet tables: transition counts, forests, scalers, whitelists."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")
