"""Continuous ingest of raw exports: an extension, built on file-source streams.

New files in a folder are processed as the batch pipelines do and appended to the tables;
with a key, rows that are there already aren't appended again after a restart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from retailflow.plans import ingest
from retailflow.sources import schema, tables


def stream_events(spark: SparkSession, inbox: str, kind: str, folder: str, checkpoint: str, key: list[str] | None = None) -> StreamingQuery:
    """Append what is new in the inbox, then stop. Files must have the contract's columns in
    its order, UTF-8."""
    sep, names = schema.RAW[kind]
    raw = spark.readStream.schema(T.StructType([T.StructField(c, T.StringType()) for c in names])).options(sep=sep, header=True, quote='"', escape='"', multiLine=True).csv(inbox)

    def put(batch: DataFrame, _: int) -> None:
        df = batch.select(*[F.col(f"`{k}`").alias(v) for k, v in names.items()])
        items = tables.read_table(spark, folder, "items", selection=False)
        if kind == "views":
            out = ingest.views(df, items, tables.read_table(spark, folder, "categories", selection=False), ordered=False)
        else:
            out = {"orders": ingest.orders, "favorites": ingest.favorites}[kind](df, items, ordered=False)
        ingest.put(out, folder, kind, "append", key)

    return raw.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def views_by_hour(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Views of each item and hour over a stream of (ts, item_code), with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "item_code").agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), "item_code", "n")
