"""Running sums over whole tables, dealt by ranges of their order.

Range boundaries are sampled each time a plan runs, so two branches of one plan
could cut a large table differently.  The dealt rows are therefore written once,
with the number of their range, to the folder that the cluster shares; whatever
follows reads that one division, also after an executor is lost.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, in local mode, a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        path = tempfile.mkdtemp(prefix="vellum-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """The folder of this application's tables below the shared one."""
    return f"{shared_dir(spark)}/vellum-{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Remove all tables that this application has written; results that read them are void then."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(session_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder; it stays until ``clean``, as results are lazy."""
    path = f"{session_dir(df.sparkSession)}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_total(df: DataFrame, order: str | list[str], value: str | Column, alias: str, parts: int | None = None) -> DataFrame:
    """The sum of ``value`` over all rows before each, in the order of ``order``, which must have no ties.

    There are ``parts`` ranges, as many as shuffle partitions if it isn't given; one number of each is summed in
    one place.  Every column of ``df`` is written, so it should have only what is needed.
    """
    order = [order] if isinstance(order, str) else order
    ranges = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = df.withColumn("_value", F.col(value) if isinstance(value, str) else value)
    dealt = written(cells.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("_range").agg(F.sum("_value").alias("_sum"))
    before = sums.select("_range", (F.sum("_sum").over(Window.orderBy("_range")) - F.col("_sum")).alias("_before"))
    inside = F.sum("_value").over(Window.partitionBy("_range").orderBy(*order)) - F.col("_value")
    total = (F.col("_before") + F.col("_inside")).cast("long")
    return dealt.withColumn("_inside", inside).join(F.broadcast(before), "_range").withColumn(alias, total).drop("_value", "_range", "_inside", "_before")
