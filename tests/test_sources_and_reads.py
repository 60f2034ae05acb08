import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.config import DEFAULT, INVALID_ARGUMENT, OK
from framelake.operators import ctc, detect
from framelake.operators import imageops as im
from framelake.operators.models import ink_detector, ink_recogniser
from framelake.plans.read import read_frames, read_regions
from framelake.sources import frames, regions, sinks
from framelake.streaming.ingest import read_stream

LISTED = ["blank", *"ABCDEFGHIJ", " "]


def _canvas(w, h, bars):
    img = np.full((h, w, 3), 255, np.uint8)
    for x, y, bw, bh, v in bars:
        img[y : y + bh, x : x + bw] = v
    return img


@pytest.mark.parametrize(
    ("path", "want"),
    [("/a/b_c_1024x768.bgr888", (1024, 768)), ("x.bgr888", (0, 0)), ("a_1x2.bgr888.bgr888", (1, 2)), ("a_x5.bgr888", (0, 5)), ("q_12x7b.raw", (0, 0)), ("a_9x8.bgr888_tmp", (9, 8)), ("a_12 x 7.bgr888", (12, 7)), ("a_99999999999x1.bgr888", (0, 1))],
)
def test_dimensions(spark, path, want):
    r = spark.createDataFrame([(path,)], "p string").select(frames.dimensions(F.col("p")).alias("d")).first().d
    assert (r.width, r.height) == want


def test_region_lines(spark):
    lines = ["# note", "", "a\tc\t1\t2\t3\t4\ttext | more", "b\tc\tx\t 7y\t-3\t4\tq\r", "six\tc\t1\t2\t3\t4", "empty\tc\t1\t2\t3\t4\t", "seven\tc\t1\t2\t3\t4\tt\t", "eight\tc\t1\t2\t3\t4\tt\tu", " # kept\tc\t1\t2\t3\t4\tt", "\r"]
    got = regions.parse_regions(spark.createDataFrame([(v,) for v in lines], "value string")).collect()
    assert [(r.id, r.x, r.y, r.width, r.expected) for r in got] == [("a", 1, 2, 3, "text | more"), ("b", 0, 7, -3, "q"), ("seven", 1, 2, 3, "t"), (" # kept", 1, 2, 3, "t")]


def test_files(spark, tmp_path):
    img = _canvas(8, 4, [(2, 1, 3, 2, 9)])
    (tmp_path / "one_8x4.bgr888").write_bytes(img.tobytes() + b"tail")
    (tmp_path / "short_8x5.bgr888").write_bytes(img.tobytes())
    (tmp_path / "odd.bgr888").write_bytes(b"x")
    good, bad = frames.load_frames(spark, str(tmp_path))
    row = good.first()
    assert good.count() == 1 and (row.frame_id, row.width, row.height, row.stride) == ("one_8x4", 8, 4, 24)
    assert np.array_equal(im.frame_view(bytes(row.bgr), 8, 4, 24), img)
    assert bad.count() == 2
    (tmp_path / "keys.txt").write_bytes("a\r\n　\nb\n".encode())
    assert regions.character_list(spark, str(tmp_path / "keys.txt")) == ["blank", "a", "　", "b", " "]
    (tmp_path / "s_8x4.tsv").write_text("r\tc\t0\t0\t8\t4\tx\n")
    assert regions.load_regions(spark, str(tmp_path / "s_8x4.tsv")).first().screen == "s_8x4"


def test_argument_checks(spark):
    code = lambda has, w, h, s, *r: spark.range(1).select((frames.check_region_code if r else frames.check_code)(F.lit(has), *map(F.lit, (w, h, s, *r))).alias("c")).first().c
    assert code(True, 10, 5, 30) == OK and code(True, 10, 5, 29) == code(False, 10, 5, 30) == code(True, 0, 5, 30) == INVALID_ARGUMENT
    assert code(True, 10, 5, 30, 0, 0, 10, 5) == OK
    assert code(True, 10, 5, 30, 1, 0, 10, 5) == code(True, 10, 5, 30, 0, 0, 0, 5) == code(True, 10, 5, 30, -1, 0, 2, 2) == INVALID_ARGUMENT


@pytest.mark.parametrize(
    ("best", "text"),
    [([1, 0, 1], "AA"), ([1, 1, 2, 2, 0, 2], "ABB"), ([0, 0], ""), ([11, 1], " A"), ([12, 1], "A"), ([], "")],
)
def test_ctc(spark, best, text):
    steps = [[0.9 if c == k else 0.1 for c in range(13)] for k in best]
    listed = regions.literal(LISTED)
    d = spark.createDataFrame([(steps,)], "s array<array<double>>")
    r = d.select(ctc.decode_array(F.col("s"), listed).alias("r")).first().r
    assert (r.text, round(r.score, 6)) == (text, 0.9 if text else 0.0)
    if best:
        rows = spark.createDataFrame([(1, t, c, p) for t, row in enumerate(steps) for c, p in enumerate(row)], "crop int, t int, c int, p double")
        r = ctc.decode(rows, "crop", listed).first()
        assert (r.text, round(r.score, 6)) == (text, 0.9 if text else 0.0)


def test_a_tie_goes_to_the_first_class(spark):
    d = spark.createDataFrame([([0.2, 0.4, 0.4],)], "p array<double>")
    assert d.select(ctc.likeliest(F.col("p"))).first()[0] == 1


# --- images ---------------------------------------------------------------------


def test_contours_find_outer_borders_and_holes():
    mask = np.zeros((14, 14), bool)
    mask[2:9, 2:10] = True
    mask[4:7, 4:8] = False
    mask[11, 12] = True
    found = [sorted(map(tuple, c.tolist())) for c in im.contours(mask)]
    assert sorted([(2, 2), (2, 8), (9, 8), (9, 2)]) in found and [(12, 11)] in found and len(found) == 3
    assert im.contours(np.zeros((3, 3), bool)) == []
    full = im.contours(np.ones((4, 5), bool))
    assert sorted(map(tuple, full[0].tolist())) == [(0, 0), (0, 3), (4, 0), (4, 3)] and len(full) == 1


@pytest.mark.parametrize("seed", range(5))
def test_every_region_has_one_outer_border(seed):
    mask = np.random.default_rng(seed).random((20, 20)) < 0.4
    label, n = np.zeros(mask.shape, int), 0
    for r, c in zip(*np.nonzero(mask)):
        if label[r, c]:
            continue
        n += 1
        todo = [(r, c)]
        while todo:
            y, x = todo.pop()
            if 0 <= y < 20 and 0 <= x < 20 and mask[y, x] and not label[y, x]:
                label[y, x] = n
                todo += [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    out, hole = ~mask, 0
    seen = np.zeros((22, 22), bool)
    padded = np.pad(out, 1, constant_values=True)
    for r, c in zip(*np.nonzero(padded)):
        if seen[r, c]:
            continue
        hole += 1
        todo = [(r, c)]
        while todo:
            y, x = todo.pop()
            if 0 <= y < 22 and 0 <= x < 22 and padded[y, x] and not seen[y, x]:
                seen[y, x] = True
                todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    assert len(im.contours(mask)) == n + hole - 1  # all but the background's outside


def test_smallest_box_of_a_tilted_rectangle():
    t = np.deg2rad(30)
    turn = np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]])
    box = np.array([[0, 0], [40, 0], [40, 10], [0, 10]]) @ turn.T + 50
    quad, side = im.smallest_box(np.vstack([box, box.mean(axis=0)]))
    assert side == pytest.approx(10) and im.polygon_area(quad) == pytest.approx(400)
    assert im.smallest_box(np.array([[3, 4]]))[1] == 0 and im.smallest_box(np.array([[0, 0], [9, 0]]))[1] == 0


def test_overlap_of_polygons():
    a = np.array([[0, 0], [10, 0], [10, 10], [0, 10]], float)
    assert im.convex_overlap(a, a + (5, 5)) == pytest.approx(25) and im.convex_overlap(a, a + (20, 0)) == 0
    diamond = np.array([[5, -5], [15, 5], [5, 15], [-5, 5]], float)
    assert im.convex_overlap(a, diamond) == pytest.approx(100) and im.iom(a, diamond) == pytest.approx(1, rel=1e-6)


def test_pixels():
    img = np.random.default_rng(0).integers(0, 256, (20, 30, 3)).astype(np.uint8)
    assert np.array_equal(im.resize(img, 30, 20), img)
    flat = np.full((7, 9, 3), 77, np.uint8)
    assert (im.resize(flat, 33, 5) == 77).all()
    box = np.array([[4, 3], [24, 3], [24, 13], [4, 13]], float)
    assert np.array_equal(im.crop_quad(img, box), img[3:13, 4:24])
    tall = np.array([[4, 2], [10, 2], [10, 18], [4, 18]], float)
    assert np.array_equal(im.crop_quad(img, tall), np.rot90(img[2:18, 4:10]))
    # The shift and the general map agree, over the border too; a hair's tilt takes the map.
    for corner in ((4, 3), (-3, 12), (20, 15)):
        q = box - box[0] + corner
        bent = q + np.array([[0, 0], [1e-9, 0], [1e-9, 1e-9], [0, 1e-9]])
        assert np.abs(im.crop_quad(img, q).astype(int) - im.crop_quad(img, bent)).max() <= 1
    small = im.letterbox(flat, 320, 48)
    assert small.shape == (48, 320, 3) and (small[:, :62] > 0).all() and (small[:, 62:] == 0).all()
    one = np.zeros((4, 4, 3), np.uint8)
    one[0] = 100
    # The top row counts fully, the left and right columns a quarter each.
    assert im.edge_colour(one)[0] == pytest.approx((100 * 4 + (25 + 25) * 4) / 16)
    padded = im.pad_to(one, 6, 4)
    assert padded.shape == (4, 6, 3) and (padded[:, 4:] == round((100 * 4 + 50 * 4) / 16)).all() and np.array_equal(padded[:, :4], one)
    wide = bytes(range(40))
    assert im.frame_view(wide, 3, 2, 20)[1, 0].tolist() == [20, 21, 22]
    with pytest.raises(ValueError, match="bytes"):
        im.frame_view(wide, 3, 3, 20)


@pytest.mark.parametrize(("bar", "n"), [((50, 60, 100, 20), 1), ((50, 60, 3, 3), 0), ((0, 0, 0, 0), 0)])
def test_boxes_of_a_map(bar, n):
    x, y, w, h = bar
    prob = np.zeros((480, 480))
    prob[y : y + h, x : x + w] = 0.9
    found = detect.quads_of(prob, 960, 480)
    assert len(found) == n
    if n:
        quad, score = found[0]
        d = (w - 1) * (h - 1) * DEFAULT.unclip / (2 * (w + h - 2))
        want = np.array([[x - d, y - d], [x + w - 1 + d, y - d], [x + w - 1 + d, y + h - 1 + d], [x - d, y + h - 1 + d]])
        assert score == pytest.approx(0.9) and np.abs(quad - want * (2, 1)).max() <= 2
    faint = np.where(prob > 0, 0.3, 0)
    assert detect.quads_of(faint, 960, 480) == []


# --- whole reads ----------------------------------------------------------------


@pytest.fixture(scope="module")
def screens(spark):
    bars = [(50, 50, 120, 24, 0), (200, 52, 100, 24, 60), (50, 120, 150, 30, 0)]
    rows = [("a", _canvas(640, 480, bars)), ("b", _canvas(300, 200, []))]
    return spark.createDataFrame([(n, i.shape[1], i.shape[0], i.shape[1] * 3, bytearray(i.tobytes())) for n, i in rows], frames.FRAME)


def test_decoding_grows_with_the_steps_alone(spark):
    rng = np.random.default_rng(1)
    listed = ["", *map(chr, range(0x4E00, 0x4E00 + 6905))]
    for n in (40, 160):
        best = rng.integers(0, 6906, n)
        best[5:9] = best[4]
        probs = np.full((n, 6906), 0.01, np.float32)
        probs[np.arange(n), best] = 0.9
        steps = detect.best_steps(probs)
        assert [s["c"] for s in steps] == best.tolist() and len(steps) == n
        want = "".join(listed[c] for k, c in enumerate(best) if c and (not k or c != best[k - 1]))
        d = spark.createDataFrame([([(s["c"], s["p"]) for s in steps],)], "s array<struct<c:int,p:double>>")
        r = d.select(ctc.decode_best(F.col("s"), regions.literal(listed)).alias("r")).first().r
        assert r.text == want and abs(r.score - 0.9) < 1e-6


def test_frames(screens):
    got = {r.frame_id: r for r in sinks.results(read_frames(screens, ink_detector, ink_recogniser(), regions.literal(LISTED))).collect()}
    assert got["a"].text.count("\n") == 1 and got["a"]["count"] == 3 and got["a"].confidence == 95
    assert got["a"].text.split("\n")[0].count(" ") == 1
    assert len(got["a"].pieces[0].box) == 8
    # Without a box the frame is read as one.
    assert got["b"]["count"] == 1 and list(got["b"].pieces[0].box) == [0, 0, 300, 0, 300, 200, 0, 200]


def test_regions(spark, screens):
    wanted = [("a", "left", 40, 40, 140, 44), ("a", "line", 40, 40, 300, 44), ("a", "blank", 400, 300, 50, 50), ("a", "outside", 600, 400, 100, 100)]
    d = spark.createDataFrame(wanted, "frame_id string, region_id string, x int, y int, width int, height int")
    got = {r.region_id: r for r in read_regions(screens, d, ink_detector, ink_recogniser(), regions.literal(LISTED)).collect()}
    assert set(got) == {"left", "line", "blank"}
    assert len(got["left"].pieces) == 1 and got["line"].text.count(" ") == 1 and (got["blank"].text, got["blank"].score) == ("", 0.0)
    box = got["left"].pieces[0].box
    assert abs(box[0].x - 33) <= 3 and abs(box[2].y - 91) <= 3  # in frame coordinates


def test_stream_equals_batch(spark, screens, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for r in screens.collect():
        (source / f"{r.frame_id}_{r.width}x{r.height}.bgr888").write_bytes(bytes(r.bgr))
    listed = regions.literal(LISTED)
    query = read_stream(spark, str(source), str(tmp_path / "out"), str(tmp_path / "mark"), ink_detector, ink_recogniser(), listed)
    query.awaitTermination(120)
    got = {r.frame_id.split("_")[0]: r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.frame_id: r.text for r in read_frames(screens, ink_detector, ink_recogniser(), listed).collect()}


def test_region_reads_move_pixels_once(spark, small):
    from framelake.plans import queries

    for query in (queries.barred_region_reads, queries.region_reads):
        plan = query(spark, small)._jdf.queryExecution().executedPlan().toString()
        after_drawing = plan[: plan.rindex("MapInArrow")]
        assert plan.count("MapInArrow") == 2 and "Exchange" not in after_drawing and "Join" not in after_drawing


def test_regions_outside_their_frame_or_without_one_give_no_row(spark):
    screens = spark.createDataFrame([("a", 64, 48, 192, bytearray(_canvas(64, 48, []).tobytes()))], frames.FRAME)
    wanted = spark.createDataFrame([("a", "in", 0, 0, 64, 48), ("a", "out", 1, 0, 64, 48), ("a", "flat", 0, 0, 0, 9), ("b", "lost", 0, 0, 9, 9)], "frame_id string, region_id string, x long, y long, width long, height long")
    got = read_regions(screens, wanted, ink_detector, ink_recogniser(), regions.literal(LISTED)).collect()
    assert [r.region_id for r in got] == ["in"]
