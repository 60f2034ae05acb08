"""Cutting frames into overlapping tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, ReadConfig


def tile_count(total: Column, native: int, overlap: int) -> Column:
    """Tiles along an axis: one if it fits, else as many as steps of
    native - overlap need."""
    return F.when(total <= native, 1).otherwise(F.ceil((total - overlap) / max(1, native - overlap))).cast("int")


def spans(total: Column, n: Column, overlap: int) -> Column:
    """The (start, size) of each of n tiles along an axis; the last ends at total."""
    size = F.floor((total + (n - 1) * overlap) / n).cast("int")
    start = lambda i: F.when(i == n - 1, total - size).otherwise(i * (size - overlap)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(start(i).alias("start"), size.alias("size")))


def tiles(frames: DataFrame, config: ReadConfig = DEFAULT) -> DataFrame:
    """One row per frame and tile: every frame as a whole (tile 0) and, where it is
    larger than the detector's input, its tiles, row by row. Frames need width and
    height; the other columns are kept, so leave pixels out and join them late."""
    n_x = tile_count(F.col("width"), config.det_width, config.tile_overlap)
    n_y = tile_count(F.col("height"), config.det_height, config.tile_overlap)
    sized = frames.withColumns({"_n_x": n_x, "_n_y": n_y})
    xs, ys = spans(F.col("width"), F.col("_n_x"), config.tile_overlap), spans(F.col("height"), F.col("_n_y"), config.tile_overlap)
    box = lambda x, y, w, h: F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))
    whole = F.array(box(F.lit(0), F.lit(0), F.col("width"), F.col("height")))
    grid = F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: box(x["start"], y["start"], x["size"], y["size"]))))
    many = (F.col("_n_x") > 1) | (F.col("_n_y") > 1)
    cut = F.when(many, F.concat(whole, grid)).otherwise(whole)
    return sized.select(*frames.columns, F.posexplode(cut).alias("tile", "_box")).select(*frames.columns, "tile", "_box.x", "_box.y", "_box.w", "_box.h")
