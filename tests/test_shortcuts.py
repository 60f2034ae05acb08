"""Short cuts of the image primitives give what plain loops give."""

import math

import numpy as np
import pytest

from framelake.config import DEFAULT
from framelake.operators import detect
from framelake.operators import imageops as im
from framelake.operators.models import ink_detector


def _tables(seed, n, most=12):
    rng = np.random.default_rng(seed)
    for k in range(n):
        h, w = rng.integers(1, most, 2)
        img = rng.integers(0, 256, (h, w, 3)).astype(np.uint8)
        if k % 2:
            img = np.repeat(np.repeat(img, rng.integers(1, 7, h), axis=0), rng.integers(1, 7, w), axis=1)
        if k % 3 == 0:
            img[...] = img[..., :1]
        yield img, *rng.integers(1, 40, 2).tolist()


def test_bytes_are_resized_in_whole_numbers_with_halves_to_even():
    for img, to_w, to_h in _tables(1, 60):
        h, w = img.shape[:2]
        got = im.resize(img, to_w, to_h)
        if (h, w) == (to_h, to_w):
            continue
        for y in range(to_h):
            for x in range(to_w):
                ay, ax = (2 * y + 1) * h - to_h, (2 * x + 1) * w - to_w
                (ly, py), (lx, px) = divmod(ay, 2 * to_h), divmod(ax, 2 * to_w)
                at = lambda i, j: img[min(max(i, 0), h - 1), min(max(j, 0), w - 1)].astype(int)  # noqa: B023, E731
                low = at(ly, lx) * (2 * to_w - px) + at(ly, lx + 1) * px
                high = at(ly + 1, lx) * (2 * to_w - px) + at(ly + 1, lx + 1) * px
                whole, rest = np.divmod(low * (2 * to_h - py) + high * py, 4 * to_w * to_h)
                want = whole + ((rest * 2 > 4 * to_w * to_h) | (rest * 2 == 4 * to_w * to_h) & (whole % 2 == 1))
                assert got[y, x].tolist() == want.tolist()


def test_a_vertical_edge_is_even_along_its_length():
    # An exact half beside one: 255 and 12 meet at 133.5, in every column alike.
    img = np.full((3, 7, 3), 255, np.uint8)
    img[1:] = 12
    assert len({tuple(r) for r in im.resize(img, 31, 12).reshape(12, -1).tolist()}) == len({tuple(r) for r in im.resize(img[:, :1], 1, 12).reshape(12, -1).tolist()})
    assert all(len(np.unique(row)) == 1 for row in im.resize(img, 31, 12)[..., 0])


def test_filters_on_runs_are_those_of_the_whole():
    for img, *_ in _tables(2, 40):
        h, w = img.shape[:2]
        light = im.brighten(img, 255 - int(img.max()))
        near = lambda a, y, x: [a[min(max(y + i, 0), h - 1), min(max(x + j, 0), w - 1)] for i in (-1, 0, 1) for j in (-1, 0, 1)]  # noqa: B023, E731
        sharp = np.array([[np.clip(np.rint(light[y, x] + 0.85 * (light[y, x] - np.mean(near(light.astype(float), y, x), axis=0))), 0, 255) for x in range(w)] for y in range(h)]).astype(np.uint8)
        grey = im.greyscale(sharp)
        want = np.array([[np.median(near(grey, y, x), axis=0) for x in range(w)] for y in range(h)])
        assert np.array_equal(im.prepare(img, filters=True), want)


def test_squeezed_images_come_back_whole():
    for ends in (1, 2):
        for img, *_ in _tables(3, 30):
            small, rows, columns = im.squeeze(img, ends)
            assert np.array_equal(small[rows][:, columns], img)
    assert im.squeeze(np.zeros((90, 70, 3), np.uint8), 2)[0].shape == (5, 5, 3)


@pytest.mark.parametrize("ratio", [1.2, 1.8])
def test_grown_rectangles_are_those_of_the_outline(ratio):
    rng = np.random.default_rng(4)
    for x0, y0, w, h in zip(*rng.integers(3, 200, (4, 500)).tolist(), strict=True):
        quad, _ = im.smallest_box(im.unclip(np.array([[x0, y0], [x0 + w, y0], [x0 + w, y0 + h], [x0, y0 + h]], float), ratio))
        if got := im.grown_rectangle(x0, y0, x0 + w, y0 + h, ratio):
            a, b, c, d = got
            assert np.allclose(quad, [[a, b], [c, b], [c, d], [a, d]])


def test_a_pixelwise_detector_sees_runs_once_and_finds_the_same():
    seen = []

    def spied(img):
        seen.append(img.shape)
        return ink_detector(img)

    spied.pixelwise = True
    img = np.full((400, 600, 3), 255, np.uint8)
    img[36:56, 20:120], img[140:162, 170:280] = 12, 90
    found = detect.frame_quads(img, spied)
    plain = detect.frame_quads(img, lambda i: ink_detector(i))
    assert [(q.tolist(), s) for q, s in found] == [(q.tolist(), s) for q, s in plain] and len(found) > 1
    assert all(h * w < 480 * 480 / 50 for h, w, _ in seen)


def test_places_in_reading_order_are_the_folds():
    rng = np.random.default_rng(5)
    for _ in range(50):
        boxes = rng.integers(0, 40, (15, 2)).tolist()
        out = []
        for y, x, i in sorted((y, x, i) for i, (x, y) in enumerate(boxes)):
            k = max((j + 1 for j, (ay, ax, _) in enumerate(out) if not (abs(y - ay) < 10 and x < ax)), default=0)
            out.insert(k, (y, x, i))
        quads = [np.array([[x, y], [x + 9, y], [x + 9, y + 9], [x, y + 9]], float) for x, y in boxes]
        assert detect.reading_order(quads, DEFAULT.row_tolerance) == [i for *_, i in out]


def test_small_quads_go():
    quad = lambda w, h: np.array([[0, 0], [w, 0], [w, h], [0, h]], float)
    assert [detect.large_enough(quad(w, h), DEFAULT) for w, h in ((8, 10), (7, 10), (8, 9))] == [True, False, False]
    assert math.isclose(DEFAULT.min_height, 10)


def test_tilted_crops_are_the_sums_of_sixteen_pixels():
    rng = np.random.default_rng(6)
    for k in range(30):
        img = np.repeat(np.repeat(rng.integers(0, 256, (6, 7, 3)).astype(np.uint8), 1 + k % 9, axis=0), 1 + k % 7, axis=1)
        if k % 2:
            img[...] = img[..., :1]
        h, w = img.shape[:2]
        quad = np.array([[1, 0], [w - 1, 2], [w - 2, h - 1], [0, h - 3]], float)
        back = im.perspective(np.array([[0, 0], (a := [int(max(np.hypot(*(quad[0] - quad[1])), np.hypot(*(quad[2] - quad[3])))), 0]), [a[0], (b := int(max(np.hypot(*(quad[0] - quad[3])), np.hypot(*(quad[1] - quad[2])))))], [0, b]], float), quad)
        want = np.zeros((b, a[0], 3))
        for v in range(b):
            for u in range(a[0]):
                x, y, z = back @ (u, v, 1)
                x, y = x / z, y / z
                x0, y0 = math.floor(x), math.floor(y)
                wx, wy = im._cubic(np.array(x - x0)), im._cubic(np.array(y - y0))
                want[v, u] = sum(wy[j] * wx[i] * img[min(max(y0 + j - 1, 0), h - 1), min(max(x0 + i - 1, 0), w - 1)] for j in range(4) for i in range(4))
        got = im.crop_quad(img, quad, 99)
        assert got.shape == want.shape and (np.abs(got - np.clip(want, 0, 255)) <= 0.5 + 1e-9).all()


def test_maps_of_runs_are_the_whole_ones():
    rng = np.random.default_rng(7)
    for k in range(60):
        small = rng.random(rng.integers(1, 12, 2)).astype(np.float32)
        if k % 3 == 0:
            small = (small > 0.5).astype(np.float32)
        rows, columns = (np.repeat(np.arange(n), rng.integers(1, 7, n)) for n in small.shape)
        whole, runs = small[rows][:, columns], im.RunMap(small, rows, columns)
        assert runs.shape == whole.shape and np.array_equal(runs[1:9, 0:5], whole[1:9, 0:5])
        assert all(np.array_equal(a, b) for a, b in zip(im._ends(whole > 0.5, 1), (runs > 0.5).ends(1), strict=True))
        assert [b.tolist() for b in im.contours(runs > 0.5)] == [b.tolist() for b in im.contours(whole > 0.5)]
        assert [(q.tolist(), s) for q, s in detect.boxes_of(runs)] == [(q.tolist(), s) for q, s in detect.boxes_of(whole)]
