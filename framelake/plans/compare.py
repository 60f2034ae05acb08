"""Whole evaluations: benchmark cycles, region modes, engines, parameter sweeps.

Cycles repeat a read where its pixels are; the first is an untimed warm-up.
"""

from __future__ import annotations

import dataclasses
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, ReadConfig
from ..functions.text import one_line, tidy
from ..operators import evaluate
from ..operators import imageops as im
from ..operators.ctc import decode_best
from ..operators.detect import CYCLE_FIELDS, arrow_pass, in_cycles, read_by, read_image, read_whole
from ..operators.models import Detector, Recogniser
from .read import cut_region, frame_texts, pieces_of, region_canvases, region_texts, with_regions

#: How a region is read: its crop recognised as it is; its crop searched for text;
#: its padded crop searched, which is what a region read does.
MODES = ("rec", "stretch", "pad")

#: Another engine: a prepared crop (height x width x 3, BGR) to (text, percent).
Engine = Callable[[np.ndarray], tuple[str, float]]


def benchmark(frames: DataFrame, detector: Detector, recogniser: Recogniser, listed: Column, cycles: int, config: ReadConfig = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(timings, pieces): mean and deviation of each stage per frame over the timed
    cycles, and the pieces and number of crops that the last cycle left. A frame's cycles
    run one after another where its pixels are."""

    def read(img: np.ndarray, _: dict) -> Iterator[tuple]:
        yield in_cycles(lambda: read_image(img, detector, recogniser, [config])[0], cycles)

    runs = frame_texts(pieces_of(arrow_pass(frames, read, CYCLE_FIELDS), listed, config))
    t = F.col("t")
    stages = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), v.alias("value")) for n, v in (("det", t["det"]), ("rec", t["rec"]), ("total", t["det"] + t["rec"]))])).alias("s")
    timings = evaluate.timing_summary(runs.select("frame_id", F.explode("timed").alias("t")).select("frame_id", stages).select("frame_id", "s.*"), ["frame_id", "metric"])
    return timings, runs.select("frame_id", "n_crops", F.posexplode("pieces").alias("seq", "p")).select("frame_id", "n_crops", "seq", "p.score", "p.text", "p.box")


def reads_by_mode(frames: DataFrame, regions: DataFrame, detector: Detector, recogniser: Recogniser, listed: Column, cycles: int = 1, config: ReadConfig = DEFAULT) -> DataFrame:
    """Scored reads of regions (frame_id, region_id, x, y, width, height, category,
    expected) in every mode, with the mean time of the timed cycles."""
    return listed_by_mode(with_regions(frames, regions), detector, recogniser, listed, cycles, config)


def listed_by_mode(frames: DataFrame, detector: Detector, recogniser: Recogniser, listed: Column, cycles: int = 1, config: ReadConfig = DEFAULT) -> DataFrame:
    """The same of frames that have their regions as with_regions() lists them: all modes
    and cycles in one Arrow pass over a frame's pixels."""

    def read(img: np.ndarray, row: dict) -> Iterator[tuple]:
        for k, r in enumerate(row["regions"]):
            for mode in MODES:
                cut = cut_region(img, r, config, mode == "pad")
                if cut is None:
                    continue
                canvas, x0, y0 = cut
                one = (lambda: read_whole(canvas, recogniser, config)) if mode == "rec" else (lambda: read_image(canvas, detector, recogniser, [config])[0])  # noqa: B023
                yield k, x0, y0, mode, *in_cycles(one, cycles)

    places = [(n, pa.int32(), "int") for n in ("_place", "dx", "dy")]
    found = arrow_pass(frames.select("frame_id", "width", "height", "stride", "bgr", "regions"), read, [*places, ("mode", pa.string(), "string"), *CYCLE_FIELDS], ("regions",))
    # A crop recognised as it is reads as it does, whatever its score.
    whole = F.when(F.col("mode") == "rec", decode_best(F.get("reads", F.lit(0))["steps"], listed))
    total = F.aggregate("timed", F.lit(0.0), lambda a, t: a + t["det"] + t["rec"])
    ms = F.when(F.size("timed") > 0, total / F.size("timed"))
    found = found.select("frame_id", F.get("regions", "_place").alias("region"), "dx", "dy", "mode", ms.alias("ms"), whole.alias("whole"), "reads")
    readings = region_texts(pieces_of(found, listed, config))
    pick = lambda n: F.when(F.col("mode") == "rec", F.col("whole")[n]).otherwise(F.col(n)).alias(n)
    said = readings.select("frame_id", "region.region_id", "mode", "ms", pick("text"), pick("score"), "region.category", "region.expected")
    return evaluate.score_reads(said.withColumn("text", one_line(F.col("text"))))


def engine_reads(frames: DataFrame, regions: DataFrame, engine: Engine, cycles: int = 1, enlarge: int = 1, filters: bool = False) -> DataFrame:
    """What another engine reads in each region, cut without a margin and prepared
    for it: text, percent and the mean time after one warm-up. A negative percent
    is no text."""
    bare = dataclasses.replace(DEFAULT, margin=0)
    crops = region_canvases(frames, regions, bare, padded=False)
    names = crops.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for r in range(b.num_rows):
                get = lambda n: b.column(names.index(n))[r].as_py()  # noqa: B023, E731
                img = im.frame_view(get("bgr"), get("width"), get("height"), get("stride"))
                text, percent = engine(im.prepare(img, enlarge, filters))
                start = time.perf_counter()
                for _ in range(cycles):
                    engine(im.prepare(img, enlarge, filters))
                out.append((get("frame_id"), get("region_id"), 1000 * (time.perf_counter() - start) / max(cycles, 1), text if percent > -1 else "", float(percent)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            types = (pa.string(), pa.string(), pa.float64(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["frame_id", "region_id", "ms", "text", "confidence"])

    return crops.mapInArrow(run, "frame_id string, region_id string, ms double, text string, confidence double")


def compare_engines(reads: dict[str, DataFrame], regions: DataFrame) -> DataFrame:
    """Scored reads of named engines (frame_id, region_id, ms, text) in the order
    given, the best of the other engines among them, ready for tally_by_engine."""
    every = None
    for k, (name, df) in enumerate(reads.items()):
        one = df.select(F.col("frame_id").alias("screen"), "region_id", "ms", tidy(F.col("text")).alias("text"), F.lit(name).alias("engine"), F.lit(k).alias("engine_ord"))
        every = one if every is None else every.unionByName(one)
    wanted = regions.select(F.col("frame_id").alias("screen"), "region_id", "category", "expected")
    scored = evaluate.score_reads(every.join(wanted, ["screen", "region_id"]))
    return scored.unionByName(evaluate.best_reads(scored))


def sweep(
    frames: DataFrame, detector: Detector, recogniser: Recogniser, listed: Column, det: list[float], box: list[float], unclip: list[float], config: ReadConfig = DEFAULT
) -> DataFrame:
    """One row per frame and combination of the swept values: pieces, time of
    detection, texts joined by ";". The grid is a parameter list, not data. No swept
    value reaches the detector, so it sees a frame once for all of them."""
    grid = [(d, b, u) for d in det for b in box for u in unclip]
    if not grid:
        raise ValueError("a sweep needs a value of each parameter")
    runs = read_by(frames, detector, recogniser, [dataclasses.replace(config, det_thresh=d, box_thresh=b, unclip=u) for d, b, u in grid])
    read = frame_texts(pieces_of(runs, listed, config))
    value = lambda k: F.element_at(F.array(*[F.lit(float(g[k])) for g in grid]), F.col("setting") + 1)
    return read.select(
        F.col("frame_id").alias("image"), value(0).alias("det_thresh"), value(1).alias("box_thresh"), value(2).alias("unclip_ratio"),
        F.size("pieces").alias("n_pieces"), "det_ms", F.array_join(F.transform("pieces", lambda p: p["text"]), ";").alias("recognized_text"),
    )
