"""Frames from a folder as a stream: the batch plan over an incremental source.

The plan is stateless and has no shuffle, so a restart repeats at most the files
of one micro-batch and the sink's commit log keeps them from counting twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULT, ReadConfig
from ..operators.models import Detector, Recogniser
from ..plans.read import read_frames
from ..sources.frames import accepted, dimensions
from ..sources.sinks import results

FILE = "path string, modificationTime timestamp, length long, content binary"


def frame_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """The usable frames of a folder, new files as they come."""
    files = spark.readStream.format("binaryFile").schema(FILE).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.bgr888").load(folder)
    return accepted(files.withColumn("d", dimensions(F.col("path"))).select("path", "length", "content", "d.width", "d.height"))


def read_stream(spark: SparkSession, folder: str, sink: str, checkpoint: str, detector: Detector, recogniser: Recogniser, listed: Column, config: ReadConfig = DEFAULT, once: bool = True) -> StreamingQuery:
    """Read frames into Parquet at sink; with `once` all that is there, then stop."""
    out = results(read_frames(frame_stream(spark, folder), detector, recogniser, listed, config))
    writer = out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
