"""Whole reads: frames or regions of frames to text.

Every stage works on a frame's own row: detection, layout and recognition are one
Arrow pass, which pixels enter and do not leave; decoding and lines are Catalyst
expressions after it. A frame is never shuffled; a run scales with the number of
frames.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, ReadConfig
from ..functions.geometry import centre, holds_point, shift, vertical_extent
from ..operators import imageops as im
from ..operators.ctc import decode_best
from ..operators.detect import READ_FIELDS, arrow_pass, read_by, read_image
from ..operators.models import Detector, Recogniser


def pieces(frames: DataFrame, detector: Detector, recogniser: Recogniser, listed: Column, config: ReadConfig = DEFAULT) -> DataFrame:
    """Frames (width, height, stride, bgr, ...) without pixels, with `pieces`, an
    array of (seq, text, score, box): detection, reading order, size filter,
    suppression, recognition, decoding and the score filter, in this order. det_ms,
    rec_ms and n_crops say what the models took."""
    return pieces_of(read_by(frames, detector, recogniser, [config]).drop("setting"), listed, config)


def pieces_of(read: DataFrame, listed: Column, config: ReadConfig) -> DataFrame:
    """What follows recognition: frames with `reads` to frames with `pieces`."""
    said = F.transform("reads", lambda r: F.struct(r["seq"].alias("seq"), decode_best(r["steps"], listed).alias("d"), r["box"].alias("box")))
    flat = F.transform(said, lambda r: F.struct(r["seq"].alias("seq"), r["d"]["text"].alias("text"), r["d"]["score"].alias("score"), r["box"].alias("box")))
    return read.withColumn("pieces", F.filter(flat, lambda p: p["score"] >= config.drop_score)).drop("reads")


def lines(kept: Column) -> Column:
    """(text, score) of an array of pieces: their lines, their mean score."""
    zero = F.struct(F.lit("").alias("text"), F.lit(0.0).alias("cy"), F.lit(0.0).alias("h"), F.lit(0).alias("n"), F.lit(0.0).alias("s"))

    def add(acc: Column, p: Column) -> Column:
        cy = centre(p["box"])["y"]
        gap = F.when(acc["n"] == 0, "").when(F.abs(cy - acc["cy"]) < acc["h"] / 2, " ").otherwise("\n")
        return F.struct(F.concat(acc["text"], gap, p["text"]).alias("text"), cy.alias("cy"), vertical_extent(p["box"]).alias("h"), (acc["n"] + 1).alias("n"), (acc["s"] + p["score"]).alias("s"))

    return F.aggregate(kept, zero, add, lambda a: F.struct(a["text"].alias("text"), F.when(a["n"] > 0, a["s"] / a["n"]).otherwise(0.0).alias("score")))


def _within(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.filter("pieces", lambda p: holds_point(x, y, w, h, centre(p["box"])["x"], centre(p["box"])["y"]))


def _readings(rows: DataFrame) -> DataFrame:
    named = rows.withColumn("_r", lines(F.col("pieces")))
    return named.select(*[c for c in rows.columns if c != "pieces"], "_r.text", "_r.score", "pieces")


def read_frames(frames: DataFrame, detector: Detector, recogniser: Recogniser, listed: Column, config: ReadConfig = DEFAULT) -> DataFrame:
    """The reading of each whole frame: text, score and pieces."""
    return frame_texts(pieces(frames, detector, recogniser, listed, config))


def frame_texts(found: DataFrame) -> DataFrame:
    """Frames with `pieces` to readings."""
    zero = F.lit(0)
    return _readings(found.withColumn("pieces", _within(zero, zero, F.col("width"), F.col("height"))))


def with_regions(frames: DataFrame, regions: DataFrame) -> DataFrame:
    """Frames that have regions (frame_id, region_id, x, y, width, height, ...) with them
    as one array, so that a frame's pixels are read once. Frames may come without pixels
    here and get them afterwards, where a shuffle of pixels is too much."""
    places = [F.col(n).cast("int").alias(k) for n, k in (("x", "x"), ("y", "y"), ("width", "w"), ("height", "h"))]
    others = [c for c in regions.columns if c not in ("frame_id", "x", "y", "width", "height")]
    return frames.join(regions.groupBy("frame_id").agg(F.collect_list(F.struct(*others, *places)).alias("regions")), "frame_id")


def cut_region(img: np.ndarray, r: dict, config: ReadConfig, padded: bool) -> tuple[np.ndarray, int, int] | None:
    """(canvas, left, top) of a region (x, y, w, h): the frame's part with the margin,
    and, if `padded`, padded on the right and below to the detector's input; none of a
    region outside its frame."""
    x, y, w, h = r["x"], r["y"], r["w"], r["h"]
    if w <= 0 or h <= 0 or x < 0 or y < 0 or x + w > img.shape[1] or y + h > img.shape[0]:
        return None
    x0, y0 = max(x - config.margin, 0), max(y - config.margin, 0)
    x1, y1 = min(x + w + config.margin, img.shape[1]), min(y + h + config.margin, img.shape[0])
    cut = img[y0:y1, x0:x1]
    return np.ascontiguousarray(im.pad_to(cut, config.det_width, config.det_height) if padded else cut), x0, y0


def region_canvases(frames: DataFrame, regions: DataFrame, config: ReadConfig = DEFAULT, padded: bool = True) -> DataFrame:
    """Each region as a frame of its own, by cut_region. Regions (frame_id, region_id, x,
    y, width, height) meet their frame as one array, so its pixels are read once; a region
    outside its frame, or without a frame, gives no row."""
    both = with_regions(frames, regions.select("frame_id", "region_id", "x", "y", "width", "height")).select("frame_id", "width", "height", "stride", "bgr", "regions")
    names = ("frame_id", "region_id", "dx", "dy", "x", "y", "w", "h", "width", "height", "stride", "bgr")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                img = im.frame_view(row["bgr"], row["width"], row["height"], row["stride"])
                out = []
                for r in row["regions"]:
                    if cut := cut_region(img, r, config, padded):
                        canvas, x0, y0 = cut
                        out.append((row["frame_id"], r["region_id"], x0, y0, r["x"] - x0, r["y"] - y0, r["w"], r["h"], canvas.shape[1], canvas.shape[0], 3 * canvas.shape[1], canvas.tobytes()))
                columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
                types = [pa.string(), pa.string(), *[pa.int32()] * 9, pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=list(names))

    return both.mapInArrow(run, "frame_id string, region_id string, dx int, dy int, x int, y int, w int, h int, width int, height int, stride int, bgr binary")


def region_texts(found: DataFrame) -> DataFrame:
    """Regions with `pieces` in their canvas's coordinates to readings: the pieces centred
    in the region, their boxes in frame coordinates."""
    r = F.col("region")
    kept = found.withColumn("pieces", _within(r["x"] - F.col("dx"), r["y"] - F.col("dy"), r["w"], r["h"]))
    placed = F.transform("pieces", lambda p: F.struct(p["seq"].alias("seq"), p["text"].alias("text"), p["score"].alias("score"), shift(p["box"], F.col("dx"), F.col("dy")).alias("box")))
    named = _readings(kept.withColumn("_placed", placed))
    return named.withColumn("pieces", F.col("_placed")).drop("_placed")


def read_listed(frames: DataFrame, detector: Detector, recogniser: Recogniser, listed: Column, config: ReadConfig = DEFAULT) -> DataFrame:
    """The reading of each region of frames that have them as with_regions() lists them.
    Canvases are cut, searched and read where the frame's pixels are, in one Arrow pass."""

    def read(img: np.ndarray, row: dict) -> Iterator[tuple]:
        for k, r in enumerate(row["regions"]):
            if cut := cut_region(img, r, config, True):
                yield k, cut[1], cut[2], *read_image(cut[0], detector, recogniser, [config])[0]

    places = [(n, pa.int32(), "int") for n in ("_place", "dx", "dy")]
    found = arrow_pass(frames.select("frame_id", "width", "height", "stride", "bgr", "regions"), read, [*places, *READ_FIELDS], ("regions",))
    found = found.withColumn("region", F.get("regions", "_place")).select("frame_id", "region", "dx", "dy", "reads")
    return region_texts(pieces_of(found, listed, config)).select("frame_id", "region.region_id", "text", "score", "pieces")


def read_regions(frames: DataFrame, regions: DataFrame, detector: Detector, recogniser: Recogniser, listed: Column, config: ReadConfig = DEFAULT) -> DataFrame:
    """The reading of each region: of its padded canvas, the pieces centred in the
    region. A region without such a piece reads as empty with score 0."""
    return read_listed(with_regions(frames, regions), detector, recogniser, listed, config)
