"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local session without one gets a new folder; a
    cluster without one is an error, as every machine would write its own."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="spark-ckpt-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scoreframe/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(table: DataFrame) -> None:
    """Deletes a table that stored() wrote. Only for tables that no plan reads any more, lost executors included."""
    jvm = table.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(table.stored_at)
    path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def spread(df: DataFrame) -> DataFrame:
    """At least one task a core for scans of a few large files; a no-op for inputs that are already split. Lowers the
    session's Arrow batches from their default of 10,000 rows to 2,000, as every batch of texts is held on both sides of a
    Python worker; a setting of the caller's own stays."""
    if df.sparkSession.conf.get(BATCH) == "10000":
        df.sparkSession.conf.set(BATCH, "2000")
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def smallest(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The n first rows of an order, cut in 16 groups before the driver sees any: what reaches it is bounded by 16 n rows,
    where a plain limit sends it n rows of every task."""
    keyed = df.withColumn("_order", F.struct(*order))
    first = F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64("_order"), F.lit(16))).orderBy("_order"))
    kept = keyed.withColumn("_nth", first).filter(F.col("_nth") <= n)
    return kept.orderBy("_order").limit(n).select(*df.columns)


def text_of(col: str):
    return F.coalesce(F.col(col), F.lit(""))
