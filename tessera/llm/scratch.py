"""Tables written to the shared folder of the cluster, to cut lineage between the steps of an operator."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; in local mode, where it is unset, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="tessera-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


class Scratch:
    """Intermediate tables of one operator call.

    A table written here is computed once, whatever reads it later, and survives the loss of any executor.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
        self._count, self.tables = 0, []

    def path(self, name: str) -> str:
        self._count += 1
        return f"{self.root}/{self._count:03d}-{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as Parquet and return it as read back."""
        path = self.path(name)
        df.write.parquet(path)
        self.tables.append(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        table.scratch_path = path
        return table

    def numbered(self, df: DataFrame, column: str) -> DataFrame:
        """df with the number of each row, written, so that a row has one number however often the table is read."""
        path = self.path("numbered")
        df = df.withColumn(column, F.monotonically_increasing_id())
        df.write.option("compression", "zstd").parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        table.scratch_path = path
        return table

    def ordered(self, df: DataFrame, id_col: str, column: str) -> DataFrame:
        """df with a number for each row, which grows with the id; rows of one id are in the order of a hash of the row,
        those without an id come last.

        Whole ids that are unique and not null are such numbers themselves. Otherwise df is written in that order.
        """
        ids = df.select(F.col(id_col).alias("id"))
        if ids.schema["id"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint"):
            if not ids.groupBy("id").count().where("id is null or count > 1").limit(1).count():
                return df.withColumn(column, F.col(id_col).cast("long"))
        order = [F.col(id_col).asc_nulls_last(), F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))]
        return self.numbered(df.repartitionByRange(*order).sortWithinPartitions(*order), column)

    def last(self, df: DataFrame, name: str) -> DataFrame:
        """write(), after which the other tables are removed: df is the last that reads them."""
        table = self.write(df, name)
        self.only(table)
        return table

    def only(self, *kept: DataFrame) -> None:
        """Remove the tables of write() but those that are still to be read."""
        paths = [t.scratch_path for t in kept]
        for path in self.tables:
            if path not in paths:
                self._remove(path)
        self.tables = paths

    def delete(self, table: DataFrame) -> None:
        """Remove a table of write() that nothing reads any more."""
        self.tables.remove(table.scratch_path)
        self._remove(table.scratch_path)

    def _remove(self, path: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
