"""Session helpers: the shared folder, written intermediate tables, table readers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor and the driver can see (``spark.checkpoint.dir``).

    Only a session in one process may name none: it gets one temporary folder. On a cluster
    a folder of the driver's own would lose rows, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if context.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if (folder := context.getCheckpointDir()) is None:
            context.setCheckpointDir(tempfile.mkdtemp(prefix="tessella-"))
            folder = context.getCheckpointDir()
    return folder.rstrip("/")


def _tables(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tables/{spark.sparkContext.applicationId}"


def release_tables(spark: SparkSession) -> None:
    """Delete the session's written tables, once no result that reads them is needed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_tables(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a re-computation, and
    the written size gives the planner true statistics for its broadcast decisions.
    """
    spark = df.sparkSession
    path = f"{_tables(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt over all cores, by ``keys`` if any, for dear work on each row: a small file is one task, whatever its rows cost."""
    return df.repartition(3 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def written_buckets(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Like ``written``, dealt into ``buckets`` by a hash of ``key``: tables of equal buckets join without an exchange.

    Rows that are dealt that way already (``df.repartition(buckets, key)``) give one file for each bucket. The session's
    catalogue keeps the table's name; its files go with the others.
    """
    own = f"{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(buckets, key).option("path", f"{_tables(df.sparkSession)}/{own}").saveAsTable(own)
    return df.sparkSession.table(own)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spare_name(df: DataFrame, base: str) -> str:
    """``base``, lengthened until no column of ``df`` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base
