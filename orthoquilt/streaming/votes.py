"""Votes as a stream: counts of each class on each face grow as images come in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orthoquilt.operators.votes import argmax_class


def streamed_votes(views: DataFrame) -> DataFrame:
    """face_id, class_id, n of a stream of views (camera_id, face_id, class_id), one row for each camera and face."""
    return views.where("class_id is not null").groupBy("face_id", "class_id").agg(F.count("*").alias("n"))


def windowed_votes(views: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """The same for each window of event time; rows later than the watermark are left out, so the state stays bounded."""
    return views.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "face_id", "class_id").agg(F.count("*").alias("n"))


def start(views: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Run streamed_votes into the in-memory table `name`, all counts after each batch."""
    return streamed_votes(views).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()


def consensus(counts: DataFrame) -> DataFrame:
    """The leading class of each face of the counts so far."""
    return argmax_class(counts)
