import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.config import DEFAULT
from framelake.functions import geometry as g
from framelake.operators import detect, imageops, layout, tiling


def _swap_order(boxes):
    """Reading order by neighbour swaps, as it is defined."""
    b = sorted(boxes)
    for i in range(len(b) - 1):
        j = i
        while j >= 0 and abs(b[j + 1][0] - b[j][0]) < 10 and b[j + 1][1] < b[j][1]:
            b[j], b[j + 1] = b[j + 1], b[j]
            j -= 1
    return [i for _, _, i in b]


@pytest.fixture(scope="module")
def frames():
    rng = random.Random(4)
    return {f: [(rng.randint(0, 90), rng.randint(0, 200), i) for i in range(rng.randint(1, 25))] for f in range(60)}


def test_reading_order_is_the_swap_loop(spark, frames):
    rows = [(f, i, x, y, "t") for f, bs in frames.items() for y, x, i in bs]
    got = layout.reading_order(spark.createDataFrame(rows, "frame int, box_id int, x0 int, y0 int, label string"), "frame", 10.0)
    order = {}
    for r in got.collect():
        order.setdefault(r.frame, {})[r.seq] = r.box_id
    assert {f: [o[k] for k in range(len(o))] for f, o in order.items()} == {f: _swap_order(bs) for f, bs in frames.items()}


def test_suppression_leaves_no_covered_box(spark):
    rng = random.Random(5)
    rows = [(f, i, x, y, x + rng.randint(5, 40), y + rng.randint(5, 40)) for f in range(30) for i in range(25) for x, y in [(rng.randint(0, 80), rng.randint(0, 80))]]
    d = spark.createDataFrame(rows, "frame int, seq int, x0 int, y0 int, x1 int, y1 int")
    kept = {(r.frame, r.seq) for r in layout.suppress_overlaps(d, "frame", 0.6).collect()}
    quad = {(f, i): np.array([[a, b], [c, b], [c, e], [a, e]], float) for f, i, a, b, c, e in rows}
    for f in range(30):
        own = [quad[f, i] for i in range(25)]
        assert [i for i in range(25) if (f, i) in kept] == imageops.suppress(own, 0.6)
        for k, q in ((k, q) for k, q in quad.items() if k[0] == f):
            near = [imageops.iom(q, quad[j]) for j in kept if j[0] == f and j != k]
            assert (max(near, default=0) <= 0.6) if k in kept else max(near) > 0.6


def test_lines_chain_over_kept_pieces(spark):
    rows = [(1, 0, 10.0, 20.0, "a", 0.5), (1, 1, 19.0, 20.0, "b", 0.7), (1, 2, 28.0, 20.0, "c", 0.6), (1, 3, 38.0, 20.0, "d", 1.0), (2, None, None, None, None, None)]
    d = spark.createDataFrame(rows, "k int, seq int, cy double, height double, text string, score double")
    got = {r.k: (r.text, round(r.score, 6), r.n_pieces) for r in layout.join_lines(d, ["k"]).collect()}
    assert got == {1: ("a b c\nd", 0.7, 4), 2: ("", 0.0, 0)}


def test_regions_without_pieces_stay(spark):
    regions = spark.createDataFrame([(1, "a", 0, 0, 10, 10), (1, "b", 50, 50, 10, 10)], "frame int, region_id string, x int, y int, width int, height int")
    pieces = spark.createDataFrame([(1, 0, 9.5, 5.0), (1, 1, 10.5, 0.0), (1, 2, 8.5, 9.4), (2, 3, 1.0, 1.0)], "frame int, seq int, cx double, cy double")
    got = sorted((r.region_id, -1 if r.seq is None else r.seq) for r in layout.pieces_in_regions(regions, pieces, "frame").collect())
    # 9.5 and 10.5 round to the even 10, which the half-open rectangle excludes.
    assert got == [("a", 2), ("b", -1)]


@pytest.mark.parametrize(("w", "h", "n"), [(480, 480, 1), (481, 480, 3), (1024, 768, 13), (1024, 384, 5), (300, 200, 1), (1999, 1199, 41)])
def test_tiles_cover_the_frame(spark, w, h, n):
    rows = tiling.tiles(spark.createDataFrame([(1, w, h)], "id int, width int, height int")).collect()
    assert [(r.x, r.y, r.w, r.h) for r in rows] == detect.tile_grid(w, h) and len(rows) == n
    cover = np.zeros((h, w), int)
    for r in rows[1:] or rows:
        cover[r.y : r.y + r.h, r.x : r.x + r.w] += 1
    assert cover.min() >= 1 and all(0 <= r.x and r.x + r.w <= w and 0 <= r.y and r.y + r.h <= h for r in rows)


def test_tile_spans_of_known_sizes(spark):
    rows = tiling.tiles(spark.createDataFrame([(1024, 768)], "width int, height int")).collect()[1:]
    assert {(r.w, r.h) for r in rows} == {(448, 426)}
    assert [r.x for r in rows[:4]] == [0, 192, 384, 576] and [r.y for r in rows[::4]] == [0, 170, 342]


def test_quads_like_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [(float(a), float(b)) for a, b in rng.integers(0, 100, (4, 2))]) for i in range(200)]
    d = spark.createDataFrame(rows, "i int, p array<struct<x:double,y:double>>")
    q = g.clockwise(F.col("p"))
    out = d.select("i", q.alias("q"), g.area(F.col("p")).alias("a"), g.perimeter(F.col("p")).alias("l"), g.unclip_distance(F.col("p"), F.lit(1.8)).alias("d")).collect()
    for r, (_, p) in zip(out, rows, strict=True):
        p = np.array(p)
        assert [(c.x, c.y) for c in r.q] == [tuple(c) for c in imageops.order_quad(p)]
        assert r.a == pytest.approx(imageops.polygon_area(p)) and r.l == pytest.approx(imageops.perimeter(p))
        assert r.d == pytest.approx(imageops.polygon_area(p) * 1.8 / imageops.perimeter(p))


def test_equal_heights_take_the_second_point_as_top(spark):
    d = spark.sql("select array(named_struct('x', 0D, 'y', 5D), named_struct('x', 1D, 'y', 5D), named_struct('x', 8D, 'y', 5D), named_struct('x', 9D, 'y', 5D)) q")
    assert [p.x for p in d.select(g.order_quad(F.col("q"))).first()[0]] == [1, 9, 8, 0]


def test_rounding_rules(spark):
    d = spark.sql("select 2.5D a, -2.5D b, 3.5D c")
    assert tuple(d.select(g.half_away(F.col("a")), g.half_away(F.col("b")), F.rint("a"), F.rint("c")).first()) == (3, -3, 2, 4)


def test_unclip_closed_form_is_within_a_pixel():
    for w, h in ((189, 30), (40, 12), (300, 300)):
        quad = np.array([[50, 60], [50 + w, 60], [50 + w, 60 + h], [50, 60 + h]], float)
        d = w * h * DEFAULT.unclip / (2 * (w + h))
        grown, side = imageops.smallest_box(imageops.unclip(quad, DEFAULT.unclip))
        want = quad + np.array([[-d, -d], [d, -d], [d, d], [-d, d]])
        assert np.abs(grown - want).max() <= 1 and side > min(w, h)
    assert d == pytest.approx(135.0)
