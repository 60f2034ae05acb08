import numpy as np
import pytest

from framelake.operators import jpeg
from framelake.sources import frames


def test_steps_follow_the_quality():
    assert (jpeg.steps(jpeg.LUMA, 100) == 1).all()
    assert jpeg.steps(jpeg.LUMA, 50)[0, :3].tolist() == [16, 11, 10]
    assert jpeg.steps(jpeg.CHROMA, 25)[0, 0] == 34 and jpeg.steps(jpeg.CHROMA, 1).max() == 255


def test_full_quality_is_near_the_pixels():
    y, x = np.mgrid[0:37, 0:53]
    smooth = np.stack([x * 4, y * 5, 255 - x * 2 - y], axis=-1).clip(0, 255).astype(np.uint8)
    assert np.abs(jpeg.round_trip(smooth).astype(int) - smooth).max() <= 6
    grey = np.repeat(np.random.default_rng(5).integers(0, 256, (24, 40, 1), dtype=np.uint8), 3, axis=2)
    assert np.abs(jpeg.round_trip(grey).astype(int) - grey).max() <= 2
    flat = np.full((9, 11, 3), 200, np.uint8)
    assert (jpeg.round_trip(flat) == flat).all()


@pytest.mark.parametrize("quality", [10, 40, 75, 95])
def test_a_lower_quality_loses_more(quality):
    noise = np.random.default_rng(3).integers(0, 256, (64, 64, 3), dtype=np.uint8)
    loss = lambda q: np.square(jpeg.round_trip(noise, q).astype(float) - noise).mean()
    assert loss(quality) > loss(min(100, quality + 5)) > 0


def test_coefficients_are_multiples_of_the_steps():
    noise = np.random.default_rng(4).integers(60, 190, (8, 8), dtype=np.uint8)
    by = jpeg.steps(jpeg.LUMA, 50)
    k = np.arange(8)
    basis = [[np.outer(np.cos((2 * k + 1) * u * np.pi / 16), np.cos((2 * k + 1) * v * np.pi / 16)) for v in range(8)] for u in range(8)]
    want = np.zeros((8, 8))
    for u in range(8):
        for v in range(8):
            scale = (0.5**0.5 if u == 0 else 1) * (0.5**0.5 if v == 0 else 1) / 4
            want += np.rint((basis[u][v] * (noise.astype(float) - 128)).sum() * scale / by[u, v]) * by[u, v] * scale * basis[u][v]
    assert np.abs(jpeg._quantised(noise, by) - np.clip(want + 128, 0, 255)).max() <= 0.5 + 1e-6


def test_frames_without_their_bytes_stay(spark):
    dark = bytes(30) + b"zz"  # rows of 3 pixels and a byte
    rows = [("a", 3, 3, 10, bytearray(dark)), ("short", 3, 3, 9, bytearray(5)), ("none", 3, 3, 9, None), ("flat", 0, 0, 0, bytearray(b""))]
    seen = {r.frame_id: r for r in jpeg.recompressed(spark.createDataFrame(rows, frames.FRAME)).collect()}
    assert (seen["a"].stride, bytes(seen["a"].bgr)) == (9, bytes(27))
    assert bytes(seen["short"].bgr) == bytes(5) and seen["none"].bgr is None and bytes(seen["flat"].bgr) == b""
