"""Members assembled from a stream of fragments."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from vellum.operators import ranges, volumes


def assemble(fragments: DataFrame) -> DataFrame:
    """The state of every member once all that a stream holds now has come, in whatever order.

    Each batch adds the members it touched to a table in the shared folder, and the
    last state of each counts; the query's own state is a few numbers a member.  A
    batch that is run again after a failure replaces its rows.
    """
    spark = fragments.sparkSession
    base = f"{ranges.session_dir(spark)}/{uuid.uuid4().hex}"
    merged = volumes.merge_fragments(fragments)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/states/batch={number}")

    put(spark.createDataFrame([], merged.schema), -1)  # a stream without fragments has no members
    merged.writeStream.outputMode("update").option("checkpointLocation", f"{base}/checkpoint").foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    states = spark.read.schema(StructType([*merged.schema.fields, StructField("batch", LongType())])).parquet(f"{base}/states")
    last = states.groupBy("ord").agg(F.max_by(F.struct(*[c for c in merged.columns if c != "ord"]), "batch").alias("last"))
    return last.select("ord", "last.*")
