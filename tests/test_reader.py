import numpy as np
import pytest

from framelake import reader as R
from framelake.config import INVALID_ARGUMENT, LOAD_FAILED
from framelake.functions import process
from framelake.operators.models import ink_detector, ink_recogniser
from framelake.sources.frames import FRAME

LISTED = ["blank", *"ABCDEFGHIJ", " "]


@pytest.fixture(scope="module")
def reader():
    return R.Reader(ink_detector, ink_recogniser(), LISTED)


@pytest.fixture(scope="module")
def image():
    img = np.full((100, 200, 3), 255, np.uint8)
    img[30:54, 40:160] = 0
    return img


def test_one_frame(spark, reader, image):
    row = reader.read_frame(spark, image.tobytes(), 200, 100, 600)
    assert row["count"] == 1 and len(row["text"]) == 1 and row["confidence"] == 95
    # A stride wider than a row gives the same.
    wide = np.full((100, 700), 9, np.uint8)
    wide[:, :600] = image.reshape(100, 600)
    assert reader.read_frame(spark, wide.tobytes(), 200, 100, 700)["text"] == row["text"]
    assert R.VERSION == 1


@pytest.mark.parametrize(("args", "said"), [((None, 200, 100, 600), "no bytes"), ((b"xx", 200, 100, 599), "599 bytes a row"), ((b"xx", 0, 100, 600), "0 x 100"), ((b"xx", 200, 100, 600), "200 x 100")])
def test_bad_frames(spark, reader, args, said):
    with pytest.raises(R.ReadError, match=said) as e:
        reader.read_frame(spark, *args)
    assert e.value.code == INVALID_ARGUMENT


def test_regions(spark, reader, image):
    data = image.tobytes()
    assert reader.read_region(spark, data, 200, 100, 600, 30, 20, 140, 50)["count"] == 1
    assert reader.read_region(spark, data, 200, 100, 600, 0, 70, 30, 30)["text"] == ""
    with pytest.raises(R.ReadError, match="no readable frame"):
        reader.read_region(spark, data, 200, 100, 600, 190, 20, 20, 20)


def test_a_bad_row_keeps_its_place(spark, reader, image):
    rows = [("good", 200, 100, 600, bytearray(image.tobytes())), ("none", 200, 100, 600, None), ("thin", 200, 100, 10, bytearray(b"x"))]
    got = {r.frame_id: (r.code, r.text is None) for r in reader.read_frames(spark.createDataFrame(rows, FRAME)).collect()}
    assert got == {"good": (0, False), "none": (-1, True), "thin": (-1, True)}


def test_regions_of_bad_frames_keep_their_place(spark, reader, image):
    data = image.tobytes()
    frames = [("good", 200, 100, 600, bytearray(data)), ("short", 200, 100, 600, bytearray(data[:30_000])), ("none", 200, 100, 600, None)]
    wanted = [(f, "r", 30, 20, 140, 50) for f in ("good", "short", "none", "unknown")] + [("good", "outside", 190, 20, 20, 20)]
    regions = spark.createDataFrame(wanted, "frame_id string, region_id string, x int, y int, width int, height int")
    got = {(r.frame_id, r.region_id): (r.code, r.count) for r in reader.read_regions(spark.createDataFrame(frames, FRAME), regions).collect()}
    assert {k: v[0] for k, v in got.items()} == {("good", "r"): 0, ("good", "outside"): -1, **{(f, "r"): -1 for f in ("short", "none", "unknown")}}


def test_wrong_outputs_read_as_empty(spark, image):
    frame = spark.createDataFrame([("f", 200, 100, 600, bytearray(image.tobytes()))], FRAME)
    for recogniser in (lambda crops: [np.zeros(5)] * len(crops), lambda crops: [], lambda crops: [np.zeros((3, 0))] * len(crops)):
        row = R.Reader(ink_detector, recogniser, LISTED).read_frames(frame).first()
        assert (row.code, row.text, row["count"]) == (0, "", 0)
    for detector in (lambda img: np.zeros((2, 3, 4)), lambda img: np.zeros((0, 7))):  # no map: the frame is read as one box
        assert R.Reader(detector, ink_recogniser(), LISTED).read_frames(frame).first()["count"] == 1


def test_missing_models(spark, tmp_path):
    with pytest.raises(R.ReadError, match="detector") as e:
        R.Reader.open(spark, str(tmp_path))
    assert e.value.code == LOAD_FAILED


def test_process_samples():
    before = (process.cpu_ticks(), process.system_ticks())
    sum(range(10**6))
    after = (process.cpu_ticks(), process.system_ticks())
    assert process.memory_mb() > 1 and process.cpu_percent(before, after) >= 0 and process.cpu_percent(before, before) == 0
