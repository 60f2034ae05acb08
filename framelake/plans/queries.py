"""The registered queries, one per operator or small group of them, over whole
tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import geometry as g
from ..functions import text as x
from ..operators import ctc, evaluate, jpeg, layout, tiling
from ..operators import imageops as im
from ..operators.models import ink_detector, ink_recogniser, shade_recogniser
from ..sources.frames import check_region_code, dimensions
from ..sources.regions import literal, parse_regions
from ..sources.sinks import piece_lines, reads_table, results, summary_table
from . import compare, views
from .read import read_frames, read_listed, with_regions

Query = Callable[[SparkSession, str], DataFrame]


def _round(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to comparable digits."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- sources --------------------------------------------------------------------


def frame_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    size = F.concat((300 + e % 1700).cast("string"), F.when(e % 7 == 0, "by").otherwise("x"), (300 + e % 900).cast("string"))
    end = F.when(e % 5 == 0, ".bgr888.part").when(e % 5 == 1, ".raw").otherwise(".bgr888")
    path = F.concat(F.lit("screens/"), F.col("event_type"), F.when(e % 11 == 0, "-").otherwise("_"), size, end)
    t = views.table(spark, sf_dir, "events").select("event_id", path.alias("path"))
    return t.select("event_id", "path", x.screen_name(F.col("path")).alias("screen"), dimensions(F.col("path")).alias("d")).select("event_id", "path", "screen", "d.width", "d.height")


def region_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    s = lambda c: c.cast("string")
    base = [F.concat(F.lit("r"), s(e)), F.col("event_type"), s(e * 37 % 944), s(e * 53 % 708), F.when(e % 13 == 0, "wide").otherwise(s(20 + e % 60)), s(10 + e % 40)]
    line = F.concat_ws("\t", *base)
    line = (
        F.when(e % 6 == 0, F.concat(line, F.lit("\tStart | Stop")))
        .when(e % 6 == 1, F.concat(F.lit("# "), line, F.lit("\tnote")))
        .when(e % 6 == 2, F.concat(line, F.lit("\tReset\r")))
        .when(e % 6 == 3, line)
        .when(e % 6 == 4, F.concat(line, F.lit("\t")))
        .otherwise(F.concat(line, F.lit("\tOn\tOff")))
    )
    return parse_regions(views.table(spark, sf_dir, "events").select("event_id", line.alias("value")))


def argument_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("box_id")
    b = views.boxes(spark, sf_dir).withColumns({"fw": 1024 - e % 40 * 30, "fh": 768 - e % 30 * 30, "gap": e % 3 - 1})
    code = check_region_code(e % 17 != 0, F.col("fw"), F.col("fh"), 3 * F.col("fw") + F.col("gap"), F.col("x0"), F.col("y0"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return b.select("frame_id", "box_id", code.alias("code"))


# --- tiles ----------------------------------------------------------------------


def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.tiles(views.sizes(spark, sf_dir))


def region_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = views.boxes(spark, sf_dir)
    w = g.widen(F.col("x0"), F.col("y0"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(DEFAULT.margin), F.lit(960), F.lit(720))
    out = b.select("frame_id", "box_id", w.alias("w"))
    named = lambda part, pre: [F.col(f"w.{part}.{c}").cast("long").alias(f"{pre}_{c}") for c in ("x", "y", "width", "height")]
    return out.select("frame_id", "box_id", *named("outer", "outer"), *named("keep", "keep"))


def crop_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = views.quads(spark, sf_dir).select("frame_id", "box_id", g.crop_size(g.clockwise(F.col("corners"))).alias("s"))
    w, h = F.col("s.width"), F.col("s.height")
    return q.select("frame_id", "box_id", w.alias("width"), h.alias("height"), g.is_rotated(w, h, DEFAULT.rotate_ratio).alias("rotated"), g.letterbox_width(w, h, DEFAULT.rec_height, DEFAULT.rec_width).alias("letterbox"))


# --- geometry -------------------------------------------------------------------


def quad_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = views.quads(spark, sf_dir).withColumn("q", g.clockwise(F.col("corners")))
    c = g.centre(F.col("q"))
    return _round(q.select("frame_id", "box_id", g.area(F.col("q")).alias("area"), g.perimeter(F.col("q")).alias("perimeter"), c["x"].alias("cx"), c["y"].alias("cy"), g.vertical_extent(F.col("q")).alias("tall"), g.edge_height(F.col("q")).alias("edge_height"), g.edge_width(F.col("q")).alias("edge_width")), 4)


def quad_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = views.quads(spark, sf_dir).withColumn("q", g.clockwise(F.col("corners")))
    return q.select("frame_id", "box_id", x.corners(F.col("q")).alias("corners"))


def quad_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = views.quads(spark, sf_dir)
    moved = g.shift(F.col("corners"), F.lit(-40.0), F.lit(-30.0))
    clipped = g.clip(moved, F.lit(900), F.lit(700))
    scaled = g.rescale(F.col("corners"), F.lit(480 / 1024), F.lit(480 / 768), F.lit(1800), F.lit(1000))
    return q.select("frame_id", "box_id", x.corners(moved).alias("shifted"), x.corners(clipped).alias("clipped"), x.corners(scaled).alias("rescaled"))


def unclipped_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = views.boxes(spark, sf_dir)
    d = lambda c: F.col(c).cast("double")
    u = g.unclip_box(d("x0"), d("y0"), d("x1"), d("y1"), F.lit(DEFAULT.unclip))
    out = b.select("frame_id", "box_id", u.alias("u")).select("frame_id", "box_id", "u.*")
    return out.withColumns({c: F.floor(F.col(c) * 1000 + 0.5).cast("long") for c in ("x0", "y0", "x1", "y1")})


def sized_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes past the size, side and score filters."""
    q = views.quads(spark, sf_dir).withColumn("q", g.clip(g.clockwise(F.col("corners")), F.lit(960), F.lit(720)))
    tall, wide = g.edge_height(F.col("q")), g.edge_width(F.col("q"))
    kept = q.filter((F.floor(wide) > DEFAULT.min_side) & (F.floor(tall) > DEFAULT.min_side) & (tall >= DEFAULT.min_height) & (wide >= DEFAULT.min_width) & (F.col("score") >= DEFAULT.drop_score))
    return kept.select("frame_id", "box_id")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first candidates of a frame in the order of extraction; the cap is the
    detector's own."""
    b = views.boxes(spark, sf_dir).select("frame_id", "box_id", F.row_number().over(Window.partitionBy("frame_id").orderBy("box_id")).alias("n"))
    return b.filter(F.col("n") <= DEFAULT.max_candidates)


def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(layout.overlapping_pairs(views.boxes(spark, sf_dir), "frame_id"))


# --- layout ---------------------------------------------------------------------


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = views.boxes(spark, sf_dir).select("frame_id", "box_id", "x0", "y0")
    return layout.reading_order(b, "frame_id", DEFAULT.row_tolerance)


def overlap_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = views.boxes(spark, sf_dir).select("frame_id", "x0", "y0", "x1", "y1", F.col("box_id").alias("seq"))
    return layout.suppress_overlaps(b, "frame_id", DEFAULT.iom).select("frame_id", F.col("seq").alias("box_id"))


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four quarters and an empty corner of each frame."""
    part = F.explode(F.array(*[F.struct(F.lit(k).alias("region_id"), F.lit(a).alias("x"), F.lit(b).alias("y"), F.lit(w).alias("width"), F.lit(h).alias("height")) for k, (a, b, w, h) in enumerate([(0, 0, 472, 354), (472, 0, 472, 354), (0, 354, 472, 354), (472, 354, 472, 354), (2000, 2000, 10, 10)])]))
    return views.boxes(spark, sf_dir).select("frame_id").distinct().select("frame_id", part.alias("r")).select("frame_id", "r.*")


def region_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = views.boxes(spark, sf_dir).filter(F.col("score") >= DEFAULT.drop_score)
    p = b.select("frame_id", F.col("box_id").alias("seq"), ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"), (F.col("y1") - F.col("y0")).alias("tall"), "text", "score")
    met = layout.pieces_in_regions(_regions(spark, sf_dir), p, "frame_id")
    return _round(layout.join_lines(met, ["frame_id", "region_id"], height="tall"))


def conversation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as pieces of a frame, all kept: lines by place."""
    t = views.table(spark, sf_dir, "conversations")
    p = t.select("conv_id", F.col("turn").alias("seq"), (F.col("turn") * 13 % 40).cast("double").alias("cy"), F.lit(20.0).alias("height"), x.one_line(F.col("text")).alias("text"), (F.length("text") % 100 / 100).alias("score"))
    return _round(layout.join_lines(p, ["conv_id"]))


# --- decoding -------------------------------------------------------------------


def ctc_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(ctc.decode(views.logits(spark, sf_dir), "crop_id", literal(list(views.ALPHABET))), 4)


def ctc_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.table(spark, sf_dir, "embeddings")
    steps = F.transform(F.sequence(F.lit(0), F.lit(views.STEPS - 1)), lambda k: F.slice("embedding", k * views.CLASSES + 1, F.lit(views.CLASSES)))
    return _round(t.select(F.col("vec_id").alias("crop_id"), ctc.decode_array(steps, literal(list(views.ALPHABET))).alias("d")).select("crop_id", "d.*"), 4)


# --- scores ---------------------------------------------------------------------


def scored_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = evaluate.score_reads(views.pairs(spark, sf_dir))
    return _round(s.select("item_id", "category", "mode", "match", "cer", "ms"))


def tally_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(evaluate.tally_by_mode(evaluate.score_reads(views.pairs(spark, sf_dir))))


def _engine_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = evaluate.score_reads(views.engine_reads(spark, sf_dir))
    return scored.unionByName(evaluate.best_reads(scored))


def tally_by_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(evaluate.tally_by_engine(_engine_scores(spark, sf_dir)))


def best_engine_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = evaluate.best_reads(evaluate.score_reads(views.engine_reads(spark, sf_dir)))
    return _round(best.select("screen", "region_id", "engine_ord", "match", "cer", "ms"))


def overall_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(evaluate.overall(evaluate.score_reads(views.pairs(spark, sf_dir))))


def printed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary_table(evaluate.tally_by_mode(evaluate.score_reads(views.pairs(spark, sf_dir))).withColumn("mean_cer", F.round("mean_cer", 6)), ["mode", "category"])


def printed_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = evaluate.score_reads(views.pairs(spark, sf_dir)).withColumn("cer", F.round("cer", 6))
    return reads_table(s).select("item_id", "category", "mode", "ms", "match", "cer", x.one_line(F.col("text")).alias("text"))


# --- timings and sweeps ---------------------------------------------------------


def timing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(evaluate.timing_summary(views.cycles(spark, sf_dir), ["metric"]))


def timed_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(evaluate.timed_mean(views.cycles(spark, sf_dir), ["screen_id", "metric"]))


def last_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.cycles(spark, sf_dir).groupBy("screen_id", "cycle").agg(F.count("*").alias("n_crops"), F.max("value").alias("value"))
    return _round(evaluate.last_cycle(c, ["screen_id"], ["n_crops", "value"]))


def process_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.cycles(spark, sf_dir).groupBy("screen_id").agg(F.sum("value").alias("busy"), F.sum(F.col("cycle") - 20).alias("clock"), F.max("value").alias("most"), F.avg("value").alias("mean"))
    return _round(c.select("screen_id", evaluate.usage(F.col("busy"), F.col("clock"), F.lit(8)).alias("cpu_pct"), "most", (F.col("most") - F.col("mean")).alias("other")), 4)


def sweep_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole parameter grid, 180 runs."""
    names = [f"{r}_1024x768.bgr888" for r in ("alarm", "auto_1", "auto_2", "normal", "full")]
    return evaluate.sweep_grid(spark, names, [0.2, 0.3, 0.4], [0.3, 0.4, 0.5, 0.6], [1.0, 1.5, 2.0])


def sweep_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces that survive each swept score, per frame."""
    thresholds = F.explode(F.array(*[F.lit(v) for v in (0.2, 0.3, 0.4)])).alias("det_thresh")
    b = views.boxes(spark, sf_dir).select("frame_id", F.col("box_id").alias("seq"), "text", "score", thresholds).filter("score >= det_thresh")
    return evaluate.sweep_report(b, ["frame_id", "det_thresh"])


def report_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields read back from a printed report of each conversation."""
    t = views.table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("seq"), x.one_line(F.replace("text", F.lit('"'), F.lit("'"))).alias("text"), F.lit(0.5).alias("score"), F.expr("array(named_struct('x', 1.0D, 'y', 2.0D))").alias("box"))
    printed = piece_lines(t).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda p: p["line"]), "\n").alias("lines"))
    head = F.when(F.col("conv_id") % 3 == 0, "").otherwise(F.concat(F.lit("    Det      : "), (F.col("conv_id") % 97).cast("string"), F.lit(".5 ms\n")))
    report = F.concat(head, F.col("lines"))
    return printed.select("conv_id", x.report_det_ms(report).alias("det_ms"), x.report_pieces(report).alias("n_pieces"), F.array_join(x.report_texts(report), ";").alias("recognized_text"))


def tidied_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.table(spark, sf_dir, "conversations")
    raw = F.concat(F.lit(" \n\t"), F.translate("text", ",", "\t"), F.lit("\r\n \f"))
    return t.select("conv_id", "turn", x.tidy(raw).alias("tidied"), x.normalise(raw).alias("normalised"))


def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of frames as results of the library's shape, flattened."""
    b = views.boxes(spark, sf_dir).withColumn("box", g.quad(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))
    piece = F.struct(F.col("box_id").alias("seq"), "text", "score", "box")
    r = b.groupBy("frame_id").agg(F.round(F.avg("score"), 9).alias("score"), F.array_sort(F.collect_list(piece)).alias("pieces")).withColumn("text", F.element_at("pieces", 1)["text"])
    out = results(r)
    return out.select("frame_id", "text", "confidence", "count", F.aggregate("pieces", F.lit(0.0), lambda a, p: a + p["box"][4].cast("double")).cast("long").alias("right_sum"))


# --- images ---------------------------------------------------------------------


def map_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability maps: pixels above the threshold, the mean inside a rectangle, the
    edge colour."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = views.MAP
        for b in batches:
            above, score, edge = [], [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                p = np.array(v, dtype=np.float64).reshape(n, n)
                x0, y0 = i % 4, i % 3
                quad = np.array([[x0, y0], [x0 + 3, y0], [x0 + 3, y0 + 4], [x0, y0 + 4]], float)
                above.append(int(im.binarize(p, DEFAULT.det_thresh).sum()))
                score.append(round(im.box_score(p, quad), 5))
                edge.append(round(float(im.edge_colour(p)[0]), 5))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(above, pa.int64()), pa.array(score, pa.float64()), pa.array(edge, pa.float64())], names=["vec_id", "n_above", "score", "edge"])

    return views.table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInArrow(run, "vec_id long, n_above long, score double, edge double")


def _drawn(rows: DataFrame, width: int, height: int, draw: Callable[[np.ndarray, list[dict]], None]) -> DataFrame:
    """Rows (frame_id, bars, ...) as frames: white ones on which `draw` puts the bars.
    Other columns pass through."""
    kept = [n for n in rows.columns if n != "bars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, bars in enumerate(b.column("bars").to_pylist()):
                img = np.full((height, width, 3), 255, dtype=np.uint8)
                draw(img, bars)
                size = [pa.array([v], pa.int32()) for v in (width, height, 3 * width)]
                yield pa.RecordBatch.from_arrays([*b.select(kept).slice(k, 1).columns, *size, pa.array([img.tobytes()], pa.binary())], names=[*kept, "width", "height", "stride", "bgr"])

    # A frame is little data and much work: deal the frames out, whatever their bytes.
    dealt = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)
    schema = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in kept)
    return dealt.mapInArrow(run, f"{schema}, width int, height int, stride int, bgr binary")


def _frames(spark: SparkSession, sf_dir: str, regions: DataFrame | None = None) -> DataFrame:
    """Drawn frames: a bar for each of a user's boxes on white; with their regions, if
    any are given, which they meet before they have pixels."""

    def draw(img: np.ndarray, bars: list[dict]) -> None:
        for r in bars:
            y, x0 = r["y"] // 3, r["x"] // 3
            img[y : y + 12, x0 : x0 + 40] = r["ink"]

    b = views.boxes(spark, sf_dir).select(F.col("frame_id").cast("string").alias("frame_id"), F.struct(F.col("box_id").alias("i"), F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("box_id") % 120).alias("ink")).alias("r"))
    rows = b.groupBy("frame_id").agg(F.array_sort(F.collect_list("r")).alias("bars"))
    return _drawn(rows if regions is None else with_regions(rows, regions), 320, 240, draw)


_LISTED = ["blank", *"ABCDEFGHIJ", " "]


def frame_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole frames with the synthetic models."""
    out = read_frames(_frames(spark, sf_dir), ink_detector, ink_recogniser(), literal(_LISTED))
    return results(out).select("frame_id", "text", "confidence", "count")


def _frame_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two regions of each frame."""
    regions = views.boxes(spark, sf_dir).select(F.col("frame_id").cast("string").alias("frame_id")).distinct()
    named = (("left", (0, 0, 160, 240), "tight", "A"), ("low", (0, 150, 320, 90), "loose", "B"))
    part = [
        F.struct(F.lit(n).alias("region_id"), *[F.lit(v).alias(k) for k, v in zip(("x", "y", "width", "height"), r, strict=True)], F.lit(c).alias("category"), F.lit(e).alias("expected"))
        for n, r, c, e in named
    ]
    return regions.select("frame_id", F.explode(F.array(*part)).alias("r")).select("frame_id", "r.*")


def region_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two regions of each frame with the synthetic models."""
    out = read_listed(_frames(spark, sf_dir, _frame_regions(spark, sf_dir)), ink_detector, ink_recogniser(), literal(_LISTED))
    return results(out).select("frame_id", "region_id", "text", "confidence", "count")


#: How sure the stand-in is of each shade; it drops what it is least sure of.
_SURE = [0.5, 0.55, 0.6, 0.3, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]


def _barred(spark: SparkSession, sf_dir: str, regions: DataFrame | None = None) -> DataFrame:
    """Frames larger than the detector's input with the bars of views.bars; with their
    regions, if any are given."""

    def draw(img: np.ndarray, bars: list[dict]) -> None:
        for r in bars:
            img[r["y"] : r["y"] + r["h"], r["x"] : r["x"] + r["w"]] = r["ink"]

    rows = views.bars(spark, sf_dir).groupBy("frame_id").agg(F.collect_list(F.struct("x", "y", "w", "h", "ink")).alias("bars"))
    return _drawn(rows if regions is None else with_regions(rows, regions), 600, 400, draw)


def barred_frame_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole frames whose text follows from where their bars are: tiles, thresholds,
    growth, suppression, reading order, crops, decoding, score filter and lines."""
    out = read_frames(_barred(spark, sf_dir), ink_detector, shade_recogniser(_SURE), literal(_LISTED))
    return out.select("frame_id", "text", F.round("score", 5).alias("score"), F.size("pieces").alias("n_pieces"))


def barred_region_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of the same frames: a half, a row of cells, a cell, and one without bars."""
    frames = views.bars(spark, sf_dir).select("frame_id").distinct()
    named = (("half", 0, 0, 300, 400), ("row", 0, 100, 600, 100), ("cell", 300, 200, 150, 100), ("none", 0, 0, 20, 20))
    part = [F.struct(F.lit(n).alias("region_id"), *[F.lit(v).alias(k) for k, v in zip(("x", "y", "width", "height"), r, strict=True)]) for n, *r in named]
    regions = frames.select("frame_id", F.explode(F.array(*part)).alias("r")).select("frame_id", "r.*")
    out = read_listed(_barred(spark, sf_dir, regions), ink_detector, shade_recogniser(_SURE), literal(_LISTED))
    return out.select("frame_id", "region_id", "text", F.round("score", 5).alias("score"), F.size("pieces").alias("n_pieces"))


def recompressed_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of one colour after a JPEG round trip at quality 50."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pixels = [bytes([e * 7 % 256, e * 11 % 256, e * 13 % 256]) * 99 for e in b.column(0).to_pylist()]
            size = [pa.array([v] * b.num_rows, pa.int32()) for v in (11, 9, 33)]
            yield pa.RecordBatch.from_arrays([b.column(0), *size, pa.array(pixels, pa.binary())], names=["event_id", "width", "height", "stride", "bgr"])

    drawn = views.table(spark, sf_dir, "events").select("event_id").mapInArrow(draw, "event_id long, width int, height int, stride int, bgr binary")
    seen = jpeg.recompressed(drawn, 50).withColumn("shown", F.hex("bgr"))
    colour = [F.conv(F.substring("shown", 1 + 2 * k, 2), 16, 10).cast("int").alias(n) for k, n in enumerate("bgr")]
    return seen.select("event_id", *colour, (F.col("shown") == F.repeat(F.substring("shown", 1, 6), 99)).alias("even"))


def benchmark_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last of two timed cycles leaves of each frame."""
    _, pieces = compare.benchmark(_frames(spark, sf_dir), ink_detector, ink_recogniser(), literal(_LISTED), cycles=2)
    return pieces.select("frame_id", "n_crops", "seq", F.round("score", 5).alias("score"), "text")


def mode_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions read in every mode, tallied."""
    scored = compare.listed_by_mode(_frames(spark, sf_dir, _frame_regions(spark, sf_dir)), ink_detector, ink_recogniser(), literal(_LISTED))
    return scored.groupBy("mode", "category").agg(F.count("*").alias("n"), F.sum(F.col("match").cast("long")).alias("matched"), F.round(F.avg("cer"), 4).alias("cer"))


def _ink_engine(img: np.ndarray) -> tuple[str, float]:
    """Another engine's stand-in: a letter for the darkest pixel, none on white."""
    darkest = int(img.min())
    return ("ABCDEFGHIJ"[darkest // 26], 90.0) if darkest < 255 else ("", -1.0)


def engine_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions read by two settings of another engine and the best of them, tallied."""
    frames, regions = _frames(spark, sf_dir), _frame_regions(spark, sf_dir)
    reads = {"own": compare.engine_reads(frames, regions, _ink_engine), "filtered": compare.engine_reads(frames, regions, _ink_engine, enlarge=2, filters=True)}
    scored = compare.compare_engines(reads, regions)
    return scored.groupBy("engine", "category").agg(F.count("*").alias("n"), F.sum(F.col("match").cast("long")).alias("matched"), F.round(F.avg("cer"), 4).alias("cer"))


def swept_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole frames read with two thresholds and two growths, detected once."""
    out = compare.sweep(_frames(spark, sf_dir), ink_detector, ink_recogniser(), literal(_LISTED), [0.3, 0.7], [0.4], [1.2, 1.8])
    return out.select("image", "det_thresh", "box_thresh", "unclip_ratio", "n_pieces", "recognized_text")


_ALL: tuple[Query, ...] = (
    tally_by_mode, scored_reads, tally_by_engine, best_engine_reads, overall_report, printed_summary, printed_reads,
    frame_dimensions, region_lines, argument_checks, tile_grid, region_windows, crop_shapes,
    quad_measures, quad_order, quad_mapping, unclipped_boxes, sized_boxes, candidates, overlap_pairs,
    reading_order, overlap_suppression, region_readings, conversation_lines, ctc_rows, ctc_arrays,
    timing_summary, timed_means, last_cycles, process_usage, sweep_grid, sweep_report, report_fields, tidied_texts,
    result_rows, map_scores, frame_readings, region_reads, barred_frame_readings, barred_region_reads, recompressed_colours, benchmark_pieces, mode_readings, engine_readings, swept_readings,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in _ALL}
