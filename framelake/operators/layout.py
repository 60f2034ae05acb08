"""Layout: reading order, overlap suppression, lines.

The two ordered folds run over one frame's boxes as an array. A frame is one
screen: the detector bounds its boxes (max_candidates a tile), so the array is
bounded and frames spread over tasks. Both folds need the square of a frame's
boxes in the worst case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import holds_point, overlap_of_boxes


def in_reading_order(boxes: Column, tolerance: float) -> Column:
    """An array of structs (y, x, id, ...) in reading order.

    Boxes are taken by (y, x, id) and each is put after the last one that it may
    not pass; it may pass a box that is less than `tolerance` away in y and lies
    right of it. The relation is not transitive, so no sort key gives this order.
    """
    # An empty slice gives the accumulator the boxes' own type.
    empty = F.slice(boxes, 1, 0)

    def put(acc: Column, box: Column) -> Column:
        stays = F.transform(acc, lambda a, i: F.when((F.abs(box["y"] - a["y"]) < tolerance) & (box["x"] < a["x"]), 0).otherwise(i + 1))
        k = F.coalesce(F.array_max(stays), F.lit(0))
        return F.concat(F.slice(acc, F.lit(1), k), F.array(box), F.slice(acc, k + 1, F.size(acc)))

    return F.aggregate(F.array_sort(boxes), empty, put)


def reading_order(boxes: DataFrame, frame: str, tolerance: float, x: str = "x0", y: str = "y0", id_col: str = "box_id") -> DataFrame:
    """Add `seq`, a box's place in its frame's reading order, from 0."""
    rest = [c for c in boxes.columns if c not in (frame, x, y, id_col)]
    entry = F.struct(F.col(y).alias("y"), F.col(x).alias("x"), F.col(id_col).alias("id"), *rest)
    ordered = boxes.groupBy(frame).agg(F.collect_list(entry).alias("b")).select(frame, F.posexplode(in_reading_order(F.col("b"), tolerance)).alias("seq", "b"))
    return ordered.select(frame, F.col("b.id").alias(id_col), F.col("b.x").alias(x), F.col("b.y").alias(y), *[F.col(f"b.{c}").alias(c) for c in rest], "seq")


def survivors(boxes: Column, threshold: float) -> Column:
    """Greedy suppression over an array of structs (rank, x0, y0, x1, y1, ...): in
    order of rank, a box stays unless a kept one shares more than `threshold` of
    the smaller area with it."""
    empty = F.slice(boxes, 1, 0)
    return F.aggregate(F.array_sort(boxes), empty, lambda acc, b: F.when(F.exists(acc, lambda k: overlap_of_boxes(k, b) > threshold), acc).otherwise(F.concat(acc, F.array(b))))


def suppress_overlaps(boxes: DataFrame, frame: str, threshold: float, seq: str = "seq") -> DataFrame:
    """Drop boxes that a larger one of the frame covers, the largest first, equal
    ones by `seq`. The rows left keep all columns and their seq."""
    corners = ["x0", "y0", "x1", "y1"]
    rest = [c for c in boxes.columns if c not in (frame, *corners, seq)]
    size = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    entry = F.struct((-size).alias("rank"), F.col(seq).alias("seq"), *corners, *rest)
    kept = boxes.groupBy(frame).agg(F.collect_list(entry).alias("b")).select(frame, F.explode(survivors(F.col("b"), threshold)).alias("b"))
    return kept.select(frame, *[F.col(f"b.{c}") for c in corners], *[F.col(f"b.{c}").alias(c) for c in rest], F.col("b.seq").alias(seq))


def overlapping_pairs(boxes: DataFrame, frame: str, id_col: str = "box_id") -> DataFrame:
    """Every pair of boxes of a frame that overlap, with their shared part `iom`.
    The frame is an equi-join key and bounds are compared before areas."""
    a, b = boxes.alias("a"), boxes.alias("b")
    c = lambda s, n: F.col(f"{s}.{n}")
    meets = (c("a", "x0") < c("b", "x1")) & (c("b", "x0") < c("a", "x1")) & (c("a", "y0") < c("b", "y1")) & (c("b", "y0") < c("a", "y1"))
    pairs = a.join(b, (c("a", frame) == c("b", frame)) & (c("a", id_col) < c("b", id_col)) & meets)
    box = lambda s: F.struct(*[c(s, n).alias(n) for n in ("x0", "y0", "x1", "y1")])
    pairs = pairs.select(c("a", frame).alias(frame), c("a", id_col).alias("box_a"), c("b", id_col).alias("box_b"), box("a").alias("p"), box("b").alias("q"))
    return pairs.select(frame, "box_a", "box_b", overlap_of_boxes(F.col("p"), F.col("q")).alias("iom"))


def pieces_in_regions(regions: DataFrame, pieces: DataFrame, frame: str) -> DataFrame:
    """Regions (frame, region_id, x, y, width, height) with the pieces (frame, seq,
    cx, cy, ...) whose centre they hold; a region without any keeps one row with
    null piece columns. The larger side is not broadcast."""
    r, p = regions.alias("r"), pieces.alias("p")
    c = F.col
    holds = holds_point(c("r.x"), c("r.y"), c("r.width"), c("r.height"), c("p.cx"), c("p.cy"))
    joined = r.join(p, (c(f"r.{frame}") == c(f"p.{frame}")) & holds, "left")
    return joined.select(*[c(f"r.{n}") for n in regions.columns], *[c(f"p.{n}").alias(n) for n in pieces.columns if n not in regions.columns])


def join_lines(pieces: DataFrame, keys: list[str], seq: str = "seq", cy: str = "cy", height: str = "height", text: str = "text", score: str = "score") -> DataFrame:
    """The reading of each group of kept pieces, in order of seq.

    A piece whose centre is less than half the last kept piece's height below or
    above that piece's centre goes on in its line, any other begins a new one.
    Returns keys, text, score (the mean, 0 without pieces) and n_pieces. A row
    with a null seq is a group without pieces.
    """
    w = Window.partitionBy(*keys).orderBy(seq)
    near = F.abs(F.col(cy) - F.lag(cy).over(w)) < F.lag(height).over(w) / 2
    said = F.concat(F.when(F.lag(seq).over(w).isNull(), "").when(near, " ").otherwise("\n"), F.col(text))
    joined = pieces.withColumn("_said", F.when(F.col(seq).isNotNull(), said))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(seq).isNotNull(), F.struct(F.col(seq).alias("seq"), F.col("_said").alias("said"))))), lambda p: p["said"]), "")
    return joined.groupBy(*keys).agg(whole.alias("text"), F.coalesce(F.avg(F.when(F.col(seq).isNotNull(), F.col(score))), F.lit(0.0)).alias("score"), F.count(seq).alias("n_pieces"))
