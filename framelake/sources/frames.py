"""Raw frames: dense rows of BGR bytes in files named ..._<width>x<height>.bgr888."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import INVALID_ARGUMENT, OK
from ..functions.geometry import inside
from ..functions.text import screen_name

SUFFIX = ".bgr888"
FRAME = "frame_id string, width int, height int, stride int, bgr binary"


def _leading_int(text: Column) -> Column:
    """An integer as C reads one: white space, a sign, digits; 0 for anything else."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(0))


def dimensions(path: Column) -> Column:
    """(width, height) from a path: the last ".bgr888", the last "_" before it, the
    first "x" between; (0, 0) where one is missing."""
    stem = F.regexp_extract(path, r"(?s)^(.*)\.bgr888", 1)
    has = path.contains(SUFFIX) & stem.contains("_")
    size = F.substring_index(stem, "_", -1)
    ok = has & size.contains("x")
    width = F.substring_index(size, "x", 1)
    height = F.substring(size, F.length(width) + 2, F.length(size))
    pick = lambda part: F.when(ok, _leading_int(part)).otherwise(0)
    return F.struct(pick(width).alias("width"), pick(height).alias("height"))


def load_frames(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(frames, rejected): files that hold at least width * height * 3 bytes, cut to
    them, and the names and lengths of the others. One file is one row; a file's
    bytes are read only where its length suffices."""
    files = spark.read.format("binaryFile").load(path)
    sized = files.withColumn("d", dimensions(F.col("path"))).select("path", "length", "content", "d.width", "d.height")
    return accepted(sized), rejected(sized)


def accepted(sized: DataFrame) -> DataFrame:
    need = F.col("width").cast("long") * F.col("height") * 3
    good = sized.filter((F.col("width") > 0) & (F.col("height") > 0) & (F.col("length") >= need))
    return good.select(screen_name(F.col("path")).alias("frame_id"), "width", "height", (F.col("width") * 3).alias("stride"), F.substring("content", 1, need.cast("int")).alias("bgr"))


def rejected(sized: DataFrame) -> DataFrame:
    need = F.col("width").cast("long") * F.col("height") * 3
    return sized.filter((F.col("width") <= 0) | (F.col("height") <= 0) | (F.col("length") < need)).select("path", "length", "width", "height")


def check_code(has_bytes: Column, width: Column, height: Column, stride: Column) -> Column:
    """The return code of a whole-frame read's argument checks: bytes, then a size
    above zero with a stride of a row at least."""
    return F.when(~has_bytes | (width <= 0) | (height <= 0) | (stride < 3 * width), INVALID_ARGUMENT).otherwise(OK)


def check_region_code(has_bytes: Column, width: Column, height: Column, stride: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """The same for a region read: the region must lie in the frame."""
    frame = check_code(has_bytes, width, height, stride)
    return F.when((frame == OK) & ~inside(x, y, w, h, width, height), INVALID_ARGUMENT).otherwise(frame)
