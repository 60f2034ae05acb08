"""Stand-ins for the engine's inputs, made from the driver's tables by whole-row
arithmetic. Every row of a table takes part. plans/sql.py has the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import point

MODES = ("rec", "stretch", "pad")
ALPHABET = ("blank", *"ABCDEFG")
STEPS, CLASSES, MAP = 8, 8, 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axis-aligned boxes: a frame is a user, a box an event."""
    e = F.col("event_id")
    x0, y0 = e * 37 % 944, e * 53 % 708
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("frame_id"), e.alias("box_id"), x0.alias("x0"), y0.alias("y0"),
        (x0 + 20 + e * 7 % 60).alias("x1"), (y0 + 10 + e * 11 % 40).alias("y1"),
        F.col("event_type").alias("text"), (F.col("value") / 500).alias("score"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars in the cells of a grid, four by four a frame: a bar is an event. Some are
    too faint for a threshold, some are marks too small for text."""
    e = F.col("event_id")
    cell = e % 16
    mark = e % 11 == 5
    size = lambda normal: F.when(mark, 4).otherwise(normal).cast("int")
    return table(spark, sf_dir, "events").select(
        F.expr("event_id div 16").cast("string").alias("frame_id"), cell.alias("cell"), mark.alias("mark"),
        (cell % 4 * 150 + 20).cast("int").alias("x"), (F.floor(cell / 4) * 100 + 36 + e % 3 * 2).cast("int").alias("y"),
        size(100 + e % 2 * 10).alias("w"), size(20 + F.floor(cell / 4) * 2).alias("h"), (12 + e % 9 * 26).cast("int").alias("ink"),
    )


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tilted quads around the boxes, their corners in a rotated order."""
    b = boxes(spark, sf_dir)
    i = F.col("box_id")
    corners = F.array(point(F.col("x1") - i % 4, F.col("y1")), point(F.col("x0"), F.col("y1") - i % 2), point(F.col("x0") + i % 3, F.col("y0")), point(F.col("x1"), F.col("y0") + i % 5))
    return b.select("frame_id", "box_id", "score", corners.alias("corners"))


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame sizes."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(e.alias("size_id"), (300 + e % 1700).cast("int").alias("width"), (300 + e % 900).cast("int").alias("height"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected texts and readings with look-alike characters, in three modes."""
    t = table(spark, sf_dir, "benchmark")
    modes = F.explode(F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(m).alias("mode")) for k, m in enumerate(MODES)]))
    p = t.select("item_id", (F.col("item_id") % 4).cast("string").alias("category"), F.col("text").alias("expected"), modes.alias("m")).select("item_id", "category", "expected", F.col("m.mode").alias("mode"), F.col("m.ord").alias("ord"))
    got = F.when(F.col("ord") == 0, F.translate("expected", "lIO", "1l0")).when(F.col("ord") == 1, F.concat(F.lit("| "), F.col("expected"))).otherwise(F.replace("expected", F.lit("e"), F.lit("")))
    return p.select("item_id", "category", "mode", "expected", got.alias("text"), (F.col("item_id") * 3 % 97 + F.col("ord") * 10).cast("double").alias("ms"))


def engine_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for six engines and four screens."""
    from ..operators.evaluate import ENGINES

    t = table(spark, sf_dir, "benchmark")
    engines = F.explode(F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(m).alias("engine")) for k, m in enumerate(ENGINES)]))
    i = F.col("item_id")
    p = t.select(i.alias("region_id"), F.concat(F.lit("s"), i % 4).alias("screen"), (i % 3).cast("string").alias("category"), F.col("text").alias("expected"), engines.alias("e")).select("region_id", "screen", "category", "expected", "e.*")
    hit = (F.col("region_id") + F.col("ord")) % 3
    got = F.when(hit == 0, F.col("expected")).when(hit == 1, F.translate("expected", "aeo", "")).otherwise(F.translate("expected", "t", ""))
    return p.select("region_id", "screen", "category", "engine", F.col("ord").alias("engine_ord"), "expected", got.alias("text"), (F.col("region_id") % 50 + F.col("ord") * 5).cast("double").alias("ms"))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An embedding as eight steps over eight classes."""
    t = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("crop_id"), F.posexplode("embedding").alias("i", "p"))
    return t.select("crop_id", F.expr(f"i div {CLASSES}").cast("int").alias("t"), (F.col("i") % CLASSES).cast("int").alias("c"), F.col("p").cast("double").alias("p"))


def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of stages over cycles."""
    return table(spark, sf_dir, "events").select((F.col("event_id") % 50).alias("cycle"), F.col("event_type").alias("metric"), F.col("user_id").alias("screen_id"), F.col("event_id").alias("sample_id"), "value")
