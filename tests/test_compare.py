import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.config import DEFAULT
from framelake.operators import detect, evaluate
from framelake.operators import imageops as im
from framelake.operators.models import ink_detector, ink_recogniser
from framelake.plans import compare as C
from framelake.plans import queries
from framelake.plans.read import read_frames
from framelake.sources import frames, regions

LISTED = ["blank", *"ABCDEFGHIJ", " "]


@pytest.fixture(scope="module")
def setting(spark):
    img = np.full((300, 400, 3), 255, np.uint8)
    for x, y, w, h, v in [(40, 40, 120, 24, 0), (200, 150, 100, 24, 60)]:
        img[y : y + h, x : x + w] = v
    screens = spark.createDataFrame([("s", 400, 300, 1200, bytearray(img.tobytes()))], frames.FRAME)
    wanted = spark.createDataFrame([("s", "one", 30, 30, 140, 44, "tight", "D"), ("s", "two", 190, 140, 120, 44, "loose", "C"), ("s", "none", 10, 220, 60, 60, "loose", "x")], "frame_id string, region_id string, x int, y int, width int, height int, category string, expected string")
    return screens, wanted, regions.literal(LISTED)


def test_benchmark(setting):
    screens, _, listed = setting
    timings, pieces = C.benchmark(screens, ink_detector, ink_recogniser(), listed, cycles=3)
    got = {r.metric: r for r in timings.collect()}
    assert set(got) == {"det", "rec", "total"} and all(r.n == 3 and r.mean > 0 for r in got.values())
    assert got["total"].mean == pytest.approx(got["det"].mean + got["rec"].mean)
    rows = pieces.collect()
    assert [r.seq for r in rows] == [0, 1] and {r.n_crops for r in rows} == {2}


def test_region_modes(setting):
    screens, wanted, listed = setting
    scored = C.reads_by_mode(screens, wanted, ink_detector, ink_recogniser(), listed, cycles=2)
    rows = {(r.region_id, r["mode"]): r for r in scored.collect()}
    assert len(rows) == 9 and all(r.ms > 0 for r in rows.values())
    assert rows["none", "pad"].text == "" and rows["none", "pad"].cer == 1 and rows["none", "rec"].text != ""
    assert rows["one", "pad"].text == rows["one", "stretch"].text != ""
    assert evaluate.tally_by_mode(scored).count() == 9


def test_engines(setting):
    screens, wanted, listed = setting
    own = C.reads_by_mode(screens, wanted, ink_detector, ink_recogniser(), listed).filter("mode = 'pad'")

    def engine(img):
        return ("D" if img.min() == 0 else "\tC \n", 90) if img.min() < 200 else ("lost", -1)

    reads = {"own": own, "other": C.engine_reads(screens, wanted, engine), "other_x2_filters": C.engine_reads(screens, wanted, engine, enlarge=2, filters=True)}
    scored = C.compare_engines(reads, wanted)
    got = {(r.engine, r.region_id): (r.match, r.text) for r in scored.collect()}
    assert got["other", "one"] == (True, "D") and got["other", "two"] == (True, "C") and got["other", "none"] == (False, "")
    groups = {(r.engine, r.group): (r.matched, r.n) for r in evaluate.tally_by_engine(scored).collect()}
    assert groups["other_best", "all"] == (2, 3) and groups["other", "category tight"] == (1, 1)


def test_sweep(setting):
    screens, _, listed = setting
    rows = C.sweep(screens, ink_detector, ink_recogniser(), listed, [0.2, 0.9], [0.4], [1.0, 1.8]).collect()
    assert len(rows) == 4
    n = {(r.det_thresh, r.unclip_ratio): r.n_pieces for r in rows}
    assert n[0.2, 1.8] == 2 and n[0.9, 1.8] == 1  # the paler bar is below 0.9
    # Each combination reads as a read with these settings does, and the model ran once a frame.
    for r in rows:
        own = dataclasses.replace(DEFAULT, det_thresh=r.det_thresh, box_thresh=r.box_thresh, unclip=r.unclip_ratio)
        alone = read_frames(screens, ink_detector, ink_recogniser(), listed, own).first()
        assert r.recognized_text == ";".join(p.text for p in alone.pieces)
    calls = []
    maps = detect.tile_maps(np.full((300, 400, 3), 255, np.uint8), lambda img: calls.append(1) or ink_detector(img))
    assert len(maps) == len(calls)


def test_preparation():
    img = np.full((4, 5, 3), 100, np.uint8)
    assert im.prepare(img).shape == (4, 5, 3) and im.prepare(img, 2).shape == (8, 10, 3)
    assert (im.prepare(img, 1, True) == 255).all()  # flat: brightened, nothing to sharpen
    dot = np.zeros((5, 5, 3), np.uint8)
    dot[2, 2] = 255
    assert (im.remove_noise(dot) == 0).all() and im.sharpen(dot, 0.85)[2, 2, 0] == 255
    assert im.greyscale(np.array([[[255, 0, 0]]], np.uint8))[0, 0].tolist() == [29, 29, 29]


def test_settings_share_borders_and_crops_and_read_as_alone(monkeypatch):
    img = np.full((240, 320, 3), 255, np.uint8)
    for x, y, w, h, v in [(40, 40, 60, 24, 0), (80, 50, 60, 24, 30), (200, 150, 100, 24, 60)]:
        img[y : y + h, x : x + w] = v
    configs = [dataclasses.replace(DEFAULT, det_thresh=d, unclip=u) for d in (0.3, 0.7) for u in (1.2, 1.8)]
    alone = [detect.read_image(img, ink_detector, ink_recogniser(), [c])[0] for c in configs]
    calls = {"contours": 0, "crop_quad": 0}
    for name in calls:
        whole = getattr(im, name)
        monkeypatch.setattr(im, name, lambda *a, name=name, whole=whole: calls.update({name: calls[name] + 1}) or whole(*a))
    together = detect.read_image(img, ink_detector, ink_recogniser(), configs)
    assert [(r, n) for r, _, _, n in together] == [(r, n) for r, _, _, n in alone]
    boxes = {(r["box"][0]["x"], r["box"][0]["y"], r["box"][2]["x"], r["box"][2]["y"]) for reads, *_ in together for r in reads}
    assert calls == {"contours": 2, "crop_quad": len(boxes)} and all(d > 0 for _, d, *_ in together)


def test_cycles_run_where_the_pixels_are(setting):
    screens, _, listed = setting
    calls = []
    img = np.frombuffer(bytes(screens.first().bgr), np.uint8).reshape(300, 400, 3)
    spied = lambda i: calls.append(1) or ink_detector(i)
    *_, n, timed = detect.in_cycles(lambda: detect.read_image(img, spied, ink_recogniser(), [DEFAULT])[0], 2)
    assert len(calls) == 3 and n == 2 and len(timed) == 2 and all(t["det"] > 0 and t["rec"] > 0 for t in timed)
    _, pieces = C.benchmark(screens, ink_detector, ink_recogniser(), listed, cycles=2)
    plan = pieces._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan


def test_modes_are_one_pass_over_the_pixels(spark, small, setting):
    screens, wanted, listed = setting
    plan = queries.mode_readings(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2
    outside = wanted.withColumn("x", F.when(F.col("region_id") == "one", 399).otherwise(F.col("x")))
    scored = C.reads_by_mode(screens, outside, ink_detector, ink_recogniser(), listed, cycles=0)
    assert scored.columns == ["frame_id", "region_id", "mode", "ms", "text", "score", "category", "expected", "match", "cer"]
    rows = scored.collect()
    assert {(r.region_id, r["mode"]) for r in rows} == {(i, m) for i in ("two", "none") for m in C.MODES} and all(r.ms is None for r in rows)
