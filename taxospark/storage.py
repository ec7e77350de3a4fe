"""Tables in the shared folder: how loops cut their lineage so that lost executors cost nothing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it; a temporary folder only where it is unset in a local session (tests)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
    return _local[0]


def kept(df: DataFrame, what: str = "table") -> DataFrame:
    """df, written to the shared folder and read again."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_shuffle(df: DataFrame) -> DataFrame:
    """df, for a join of two tables that both grow with the members: both sides are shuffled, however small the files
    are, so that no table of members is broadcast through the driver."""
    return df.hint("merge")


class Log:
    """A table in the shared folder that only grows: a loop writes each round's rows once and reads all rounds as one
    table. A part counts once its write has ended, so a round that is run again leaves no half of itself behind."""

    def __init__(self, first: DataFrame, what: str = "log"):
        self._spark, self._schema, self._paths = first.sparkSession, first.schema, []
        self._base = f"{shared_dir(self._spark)}/{what}-{uuid.uuid4().hex}"
        self.add(first)

    def _read(self, paths: list[str]) -> DataFrame:
        return self._spark.read.schema(self._schema).parquet(*paths)

    def add(self, rows: DataFrame) -> DataFrame:
        """The rows, written as the next part, columns in the order of the first part, and read again."""
        path = f"{self._base}/part-{len(self._paths)}"
        rows.select(*self._schema.names).write.parquet(path)
        self._paths.append(path)
        return self._read([path])

    def last(self) -> DataFrame:
        return self._read(self._paths[-1:])

    def table(self) -> DataFrame:
        return self._read(self._paths)
