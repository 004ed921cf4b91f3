"""Shared intermediate results: steps that several branches of a plan read, written once to the shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); one is made only where all runs on one machine."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


class Steps:
    """Named intermediate tables. Each is computed once, survives lost executors, and goes when the context ends.

    ``with Steps(spark) as steps:`` deletes at the end; without a context, when the program ends. A step ``by`` a column
    is stored in buckets of it, so that later groupings and joins by that column need no shuffle.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.made, self.tables = spark, {}, []
        self.root = f"{shared_folder(spark)}/steps-{uuid.uuid4().hex}"
        _open.add(self)

    def __enter__(self) -> Steps:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def keep(self, name: str, build: Callable[[], DataFrame], by: str | None = None) -> DataFrame:
        """The step ``name``, built at its first use."""
        if name not in self.made:
            _open.add(self)
            df, path = build(), f"{self.root}/{name}"
            if by is None:
                df.write.parquet(path)
                self.made[name] = self.spark.read.schema(df.schema).parquet(path)
            else:
                parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
                table = f"step_{uuid.uuid4().hex}"
                df.repartition(parts, by).write.bucketBy(parts, by).sortBy(by).option("path", path).format("parquet").saveAsTable(table)
                self.tables.append(table)
                self.made[name] = self.spark.table(table)
        return self.made[name]

    def files(self, name: str, write: Callable[[str], None]) -> str:
        """The folder ``name`` that ``write`` fills at its first use, for files that aren't tables."""
        path = f"{self.root}/{name}"
        if name not in self.made:
            _open.add(self)
            write(path)
            self.made[name] = path
        return path

    def close(self) -> None:
        """Delete all steps; frames that read them can't be used any more."""
        for table in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        if self.made:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.made, self.tables = {}, []
        _open.discard(self)


_open: set[Steps] = set()  #: results outlive the objects that made them, so these are kept until they are closed


@atexit.register
def _close_all() -> None:
    for steps in list(_open):
        try:
            steps.close()
        except Exception:  # noqa: BLE001  the session is gone, and with it the way to reach its files
            return
