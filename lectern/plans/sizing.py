"""Size-checked broadcasts, top-n per group, and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lectern.settings import BROADCAST_BYTES, QUESTION_BYTES_PER_PASS, QUESTIONS_PER_PASS


def broadcast_within(df: DataFrame, rows: int, row_bytes: int = 256, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint when ``rows`` (a known upper bound) is small enough, else leave the join to Spark."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


def top_per_group(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    n: int,
    rank: str = "rk",
    spread_on: Sequence[str] | None = None,
) -> DataFrame:
    """First ``n`` rows of each group under a total ``order``, numbered from 1.

    Up to ``spark.sql.optimizer.windowGroupLimitThreshold`` rows, Spark cuts every
    partition to n rows per group before the shuffle. Above that it would bring the
    whole group into one task, so with ``spread_on`` the cut is made first within
    hash slices of the group.
    """
    spark = df.sparkSession
    if spread_on:
        native = int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
        slices = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
        if n > native or slices > 32:
            within = W.partitionBy(*group, "__slice").orderBy(*order)
            df = (
                df.withColumn("__slice", F.pmod(F.xxhash64(*spread_on), F.lit(slices)))
                .withColumn("__rk", F.row_number().over(within))
                .where(F.col("__rk") <= n)
                .drop("__rk", "__slice")
            )
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)


def staging_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a local one only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        base = tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("spark.checkpoint.dir", base)
        return base
    raise ValueError("set spark.checkpoint.dir to a folder all executors share")


def staged(df: DataFrame, name: str, rows_per_file: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage in a way that survives lost executors, keeps costly upstream work
    (embedding, search, generation) from running once per consumer, and gives the
    planner true sizes.
    """
    spark = df.sparkSession
    path = f"{staging_dir(spark)}/lectern/{name}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows_per_file or 0).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Result of ``df`` as a table that later steps read without running it again.

    ``df`` has ids, numbers or question texts. With a known bound of ``rows`` that one
    pass of questions may have, it is kept as a local table; anything larger is
    :func:`staged`. Without a bound, the first rows are looked at.
    """
    if rows is not None and rows > QUESTIONS_PER_PASS:
        return staged(df, name)
    head = (df if rows is not None else df.limit(QUESTIONS_PER_PASS + 1)).toArrow()
    if head.num_rows > QUESTIONS_PER_PASS or head.nbytes > QUESTION_BYTES_PER_PASS:
        return staged(df, name)
    return df.sparkSession.createDataFrame(head, df.schema)


def spread_small(df: DataFrame) -> DataFrame:
    """Give every core a share of a table that is small and sits in few files.

    Such a table may be a single row group, and then one task would do all the work.
    At most one split's worth of data per core is moved; a larger table, or one with a
    file per core, is split by its scan and stays where it is.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = df._jdf.sparkSession().sessionState().conf().filesMaxPartitionBytes()
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if cores > 1 and size < cores * split and len(df.inputFiles()) < cores:
        return df.repartition(cores)
    return df
