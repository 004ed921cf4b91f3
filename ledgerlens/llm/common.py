"""Helpers shared by the corpus operators: tables cut from lineage, fixed folds, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and \t \n \v \f \r.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts can be long: hand Python workers at most ``rows`` of them at once, in the JVM and in the worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. One is made only where none is configured and all runs on one machine."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


_scratch: list[list[DataFrame]] = []  #: cuts made within each open ``scratch``


@contextmanager
def scratch() -> Iterator[None]:
    """Cuts made inside are deleted at the end: leave it when the result that reads them has been written."""
    _scratch.append([])
    try:
        yield
    finally:
        for old in _scratch.pop():
            drop_cut(old)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: later plans start from files that survive lost executors.

    The files stay until ``drop_cut`` or the end of the ``scratch`` around.
    """
    back = write_apart(df)
    if _scratch:
        _scratch[-1].append(back)
    return back


def write_apart(df: DataFrame) -> DataFrame:
    """A ``cut`` that outlives the ``scratch`` around."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._cut_path = path
    return back


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a ``cut`` that no later plan reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._cut_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def id_type(df: DataFrame, name: str = "doc_id") -> str:
    """The type of an id column, which Python functions pass on as it is."""
    return df.schema[name].dataType.simpleString()


def held_out(doc_id: Column) -> Column:
    """The fixed test fold: crc32 of the id as text, modulo 4, is 2 (a null id is in the training fold)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of the undirected ``edges``: rows (node, root), root being the component's least node.

    Alternates two star steps until the edge set is stable. Each step is a minimum per node (combined map-side) and a
    join back, so no adjacency list is ever gathered; the minima are written out first so that the join is between two
    plain shuffles and adaptive execution can split a hub's rows. Null ends and self loops are ignored. ``drop_cut`` deletes what the result reads.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u != v")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = cut(both.where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        joined = large.join(small, "u")
        after = cut(joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v"))).distinct())
        now = after.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first()
        for old in (e, least, large, small):
            drop_cut(old)
        e = after
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    out = e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
    out._cut_path = e._cut_path
    return out
