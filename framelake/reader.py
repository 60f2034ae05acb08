"""The reader: models and characters opened once, frames or regions read by it.

The checks of a read are columns: a row with a bad argument keeps its place in the
result with its code and message instead of ending the job.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import DEFAULT, INVALID_ARGUMENT, LOAD_FAILED, OK, ReadConfig
from .operators.models import Detector, Recogniser, onnx_detector, onnx_recogniser
from .plans.read import read_frames, read_regions
from .session import ship
from .sources.frames import FRAME, check_code, check_region_code
from .sources.regions import character_list, literal
from .sources.sinks import results

VERSION = 1
#: The files of a model folder.
DETECTOR, RECOGNISER, CHARACTERS = "detector.onnx", "recogniser.onnx", "characters.txt"


class ReadError(Exception):
    """A read that did not happen; `code` says why."""

    def __init__(self, code: int, message: str) -> None:
        super().__init__(message)
        self.code = code


def _size_error() -> Column:
    said = F.format_string("%d x %d pixels, %d bytes a row: the frame's bytes do not hold that", "width", "height", "stride")
    return F.when(F.col("bgr").isNull(), "the frame has no bytes").otherwise(said)


def _fits() -> Column:
    """Whether a frame has the bytes that its size and stride need."""
    return F.length("bgr") >= F.col("stride").cast("long") * (F.col("height") - 1) + 3 * F.col("width")


@dataclass(frozen=True)
class Reader:
    detector: Detector
    recogniser: Recogniser
    characters: list[str]
    config: ReadConfig = DEFAULT

    @classmethod
    def open(cls, spark: SparkSession, folder: str, config: ReadConfig = DEFAULT) -> Reader:
        """Open a model folder that every executor can read."""
        for name in (DETECTOR, RECOGNISER, CHARACTERS):
            if not os.path.isfile(os.path.join(folder, name)):
                raise ReadError(LOAD_FAILED, f"could not load {name} from {folder}")
        listed = character_list(spark, os.path.join(folder, CHARACTERS))
        return cls(onnx_detector(os.path.join(folder, DETECTOR)), onnx_recogniser(os.path.join(folder, RECOGNISER)), listed, config)

    def read_frames(self, frames: DataFrame) -> DataFrame:
        """One row per frame: frame_id, code, error, text, confidence, count, pieces.
        A frame that fails a check has a null text and no pieces."""
        ship(frames.sparkSession)
        code = F.when(check_code(F.col("bgr").isNotNull(), F.col("width"), F.col("height"), F.col("stride")) != OK, INVALID_ARGUMENT).when(~_fits(), INVALID_ARGUMENT).otherwise(OK)
        marked = frames.withColumn("_code", code)
        read = results(read_frames(marked.filter(F.col("_code") == OK).drop("_code"), self.detector, self.recogniser, literal(self.characters), self.config))
        good = read.select("frame_id", F.lit(OK).alias("code"), F.lit(None).cast("string").alias("error"), "text", "confidence", "count", "pieces")
        bad = marked.filter(F.col("_code") != OK).select("frame_id", F.col("_code").alias("code"), _size_error().alias("error"))
        return good.unionByName(bad, allowMissingColumns=True)

    def read_regions(self, frames: DataFrame, regions: DataFrame) -> DataFrame:
        """One row per region, as read_frames, with region_id. A region of an unknown
        frame, of one whose bytes are too few, or outside its frame, has a code."""
        ship(frames.sparkSession)
        sizes = frames.select(
            "frame_id", F.col("width").alias("_w"), F.col("height").alias("_h"), F.col("stride").alias("_s"),
            F.col("bgr").isNotNull().alias("_has"), F.coalesce(_fits(), F.lit(False)).alias("_fits"),
        )
        code = check_region_code(F.col("_has"), F.col("_w"), F.col("_h"), F.col("_s"), F.col("x"), F.col("y"), F.col("width"), F.col("height"))
        code = F.when(F.coalesce("_fits", F.lit(False)), code).otherwise(INVALID_ARGUMENT)
        marked = regions.join(sizes, "frame_id", "left").withColumn("_code", code)
        usable = marked.filter(F.col("_code") == OK).select("frame_id", "region_id", "x", "y", "width", "height")
        read = results(read_regions(frames, usable, self.detector, self.recogniser, literal(self.characters), self.config))
        good = read.select("frame_id", "region_id", F.lit(OK).alias("code"), F.lit(None).cast("string").alias("error"), "text", "confidence", "count", "pieces")
        said = F.format_string("no readable frame holds %d x %d pixels at (%d, %d)", "width", "height", "x", "y")
        bad = marked.filter(F.col("_code") != OK).select("frame_id", "region_id", F.col("_code").alias("code"), said.alias("error"))
        return good.unionByName(bad, allowMissingColumns=True)

    def read_frame(self, spark: SparkSession, bgr: bytes | None, width: int, height: int, stride: int):  # noqa: ANN201
        """The result row of one frame; a failed check raises ReadError."""
        frame = spark.createDataFrame([("frame", width, height, stride, None if bgr is None else bytearray(bgr))], FRAME)
        return self._one(self.read_frames(frame))

    def read_region(self, spark: SparkSession, bgr: bytes | None, width: int, height: int, stride: int, x: int, y: int, region_width: int, region_height: int):  # noqa: ANN201
        """The same for one region of a frame."""
        frame = spark.createDataFrame([("frame", width, height, stride, None if bgr is None else bytearray(bgr))], FRAME)
        region = spark.createDataFrame([("frame", "region", x, y, region_width, region_height)], "frame_id string, region_id string, x int, y int, width int, height int")
        return self._one(self.read_regions(frame, region))

    @staticmethod
    def _one(df: DataFrame):  # noqa: ANN205
        row = df.first()
        if row["code"] != OK:
            raise ReadError(row["code"], row["error"])
        return row
