"""Detection and recognition: frames to quads, tile by tile, and quads to reads, inside
one Arrow pass per frame.

A frame's pixels stay where they were read: its tiles and crops are cut in the worker,
so pixels are neither shuffled nor repeated, and do not come back from it.
"""

from __future__ import annotations

import math
import struct
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..config import DEFAULT, ReadConfig
from . import imageops as im
from .models import Detector, Recogniser

POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
STEPS = "array<struct<c:int,p:double>>"
STEP_TYPE = pa.list_(pa.struct([("c", pa.int32()), ("p", pa.float64())]))


def tile_grid(width: int, height: int, config: ReadConfig = DEFAULT) -> list[tuple[int, int, int, int]]:
    """(x, y, w, h) of a frame as a whole and of its tiles, row by row."""

    def axis(total: int, native: int) -> list[tuple[int, int]]:
        lap = config.tile_overlap
        n = 1 if total <= native else -(-(total - lap) // max(1, native - lap))
        size = (total + (n - 1) * lap) // n
        return [(total - size if i == n - 1 else i * (size - lap), size) for i in range(n)]

    xs, ys = axis(width, config.det_width), axis(height, config.det_height)
    grid = [(x, y, w, h) for y, h in ys for x, w in xs]
    return [(0, 0, width, height), *(grid if len(grid) > 1 else [])]


def _rectangle(border: np.ndarray) -> tuple[int, int, int, int] | None:
    """(x0, y0, x1, y1) of four points, if they are an upright rectangle's corners."""
    (ax, ay), (bx, by), (cx, cy), (dx, dy) = border.tolist()
    straight = ax == bx and by == cy and cx == dx and dy == ay or ay == by and bx == cx and cy == dy and dx == ax
    return (min(ax, cx), min(ay, cy), max(ax, cx), max(ay, cy)) if straight and ax != cx and ay != cy else None


def boxes_of(prob: np.ndarray | im.RunMap, config: ReadConfig = DEFAULT) -> list[tuple[np.ndarray, float]]:
    """(quad, score) of each region of a probability map that is large and likely enough
    for text, not yet grown, in the map's coordinates."""
    out = []
    for border in im.contours(im.binarize(prob, config.det_thresh))[: config.max_candidates]:
        if len(border) == 4 and (rectangle := _rectangle(border)):
            x0, y0, x1, y1 = rectangle
            if min(x1 - x0, y1 - y0) < config.min_side:
                continue
            quad = np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1]], float)
            score = float(prob[y0 : y1 + 1, x0 : x1 + 1].ravel().mean())
        else:
            quad, side = im.smallest_box(border)
            if side < config.min_side:
                continue
            score = im.box_score(prob, quad)
        if score >= config.box_thresh:
            out.append((quad, score))
    return out


def grown_quad(quad: np.ndarray, shape: tuple[int, ...], width: int, height: int, config: ReadConfig = DEFAULT) -> np.ndarray | None:
    """A quad of a probability map grown, in the coordinates of an image of this size;
    none if it is too small then."""
    grown = None
    if im.upright(quad):
        (x0, y0), (x1, y1) = quad[0].tolist(), quad[2].tolist()
        if x0.is_integer() and y0.is_integer() and x1.is_integer() and y1.is_integer():
            grown = im.grown_rectangle(int(x0), int(y0), int(x1), int(y1), config.unclip)
    if grown:
        side, points = min(grown[2] - grown[0], grown[3] - grown[1]), [grown[:2], grown[2:]]
    else:
        outline = im.unclip(quad, config.unclip)
        if len(outline) < 3:
            return None
        box, side = im.smallest_box(outline)
        points = box.tolist()
    if side < config.min_side + 2:
        return None
    ratios, most = (shape[1] / width, shape[0] / height), (width - 1, height - 1)
    into = [[float(math.floor(min(max(math.copysign(math.floor(abs(v / r) + 0.5), v), 0), m))) for v, r, m in zip(p, ratios, most, strict=True)] for p in points]
    if grown:
        (a, b), (c, d) = into
        return np.array([[a, b], [c, b], [c, d], [a, d]]) if min(int(c - a), int(d - b)) > config.min_side else None
    quad = im.order_quad(np.array(into))
    return quad if min(int(np.hypot(*(quad[0] - quad[1]))), int(np.hypot(*(quad[0] - quad[3])))) > config.min_side else None


def quads_of(prob: np.ndarray | im.RunMap, width: int, height: int, config: ReadConfig = DEFAULT) -> list[tuple[np.ndarray, float]]:
    """(quad, score) of each text box of a probability map, in the coordinates of an
    image of this size."""
    grown = ((grown_quad(q, prob.shape, width, height, config), s) for q, s in boxes_of(prob, config))
    return [(q, s) for q, s in grown if q is not None]


def tile_maps(img: np.ndarray, detector: Detector, config: ReadConfig = DEFAULT) -> list[tuple[int, int, int, int, np.ndarray | im.RunMap]]:
    """(x, y, w, h, probability map) of a frame as a whole and of its tiles. A tile
    whose output is no map has none: the read goes on without it."""
    out = []
    for x, y, w, h in tile_grid(img.shape[1], img.shape[0], config):
        if getattr(detector, "pixelwise", False):
            small, rows, columns = im.detector_parts(img[y : y + h, x : x + w], config.det_width, config.det_height)
            prob = detector(small)
            if rows is not None and prob.ndim == 2 and prob.size:
                out.append((x, y, w, h, im.RunMap(prob, rows, columns)))
                continue
        else:
            tensor, _, _ = im.detector_input(img[y : y + h, x : x + w], config.det_width, config.det_height)
            prob = np.asarray(detector(tensor))
        if prob.ndim == 2 and prob.size:
            out.append((x, y, w, h, prob))
    return out


def frame_quads(img: np.ndarray, detector: Detector, config: ReadConfig = DEFAULT) -> list[tuple[np.ndarray, float]]:
    """The quads of a frame and of all its tiles, in frame coordinates."""
    return placed_quads(tile_maps(img, detector, config), config)


def placed_quads(maps: list[tuple[int, int, int, int, np.ndarray | im.RunMap]], config: ReadConfig) -> list[tuple[np.ndarray, float]]:
    return [(q + (x, y), s) for x, y, w, h, prob in maps for q, s in quads_of(prob, w, h, config)]


def best_steps(output: np.ndarray) -> list[dict]:
    """Each step's first likeliest class and its probability: all that decoding needs of
    a crop's steps x classes output. An output of another shape is no step, so that its
    crop reads as empty and the read goes on."""
    output = np.asarray(output)
    if output.ndim != 2 or not output.shape[1]:
        return []
    best = output.argmax(axis=1)
    return [{"c": c, "p": p} for c, p in zip(best.tolist(), output[np.arange(len(best)), best].tolist(), strict=True)]


def read_crops(recogniser: Recogniser, crops: list[np.ndarray], config: ReadConfig) -> list[list[dict]]:
    """The steps of each crop; a crop that the recogniser has no output for has none."""
    blank = np.zeros((config.rec_height, config.rec_width, 3), np.float32)
    outputs = recogniser([im.letterbox(c, config.rec_width, config.rec_height) if c.size else blank for c in crops])
    steps = [best_steps(o) for o in outputs[: len(crops)]]
    return steps + [[] for _ in crops[len(steps) :]]


def reading_order(quads: list[np.ndarray], tolerance: float) -> list[int]:
    """The places of quads in reading order; layout.in_reading_order says which."""
    out: list[tuple[float, float, int]] = []
    for y, x, i in sorted((float(q[0, 1]), float(q[0, 0]), i) for i, q in enumerate(quads)):
        k = len(out)
        while k and abs(y - out[k - 1][0]) < tolerance and x < out[k - 1][1]:
            k -= 1
        out.insert(k, (y, x, i))
    return [i for *_, i in out]


def large_enough(quad: np.ndarray, config: ReadConfig) -> bool:
    """Whether a quad's left side and top are long enough for text."""
    (ax, ay), (bx, by), _, (dx, dy) = quad.tolist()
    return math.hypot(ax - dx, ay - dy) >= config.min_height and math.hypot(ax - bx, ay - by) >= config.min_width


READS = pa.list_(pa.struct([("seq", pa.int32()), ("box", pa.list_(POINT)), ("steps", STEP_TYPE)]))
READS_SQL = f"array<struct<seq:int,box:array<struct<x:double,y:double>>,steps:{STEPS}>>"


def _corners(quad: np.ndarray) -> list[dict]:
    return [{"x": x, "y": y} for x, y in quad.tolist()]


def read_whole(img: np.ndarray, recogniser: Recogniser, config: ReadConfig = DEFAULT) -> tuple[list[dict], float, float, int]:
    """(reads, det_ms, rec_ms, n_crops) of an image recognised as one crop that spans it."""
    h, w = img.shape[:2]
    start = time.perf_counter()
    steps = read_crops(recogniser, [img], config)
    return [{"seq": 0, "box": _corners(np.array([[0, 0], [w, 0], [w, h], [0, h]], float)), "steps": steps[0]}], 0.0, 1000 * (time.perf_counter() - start), 1


def read_image(img: np.ndarray, detector: Detector, recogniser: Recogniser, configs: list[ReadConfig]) -> list[tuple[list[dict], float, float, int]]:
    """(reads, det_ms, rec_ms, n_crops) of an image in each setting; read_by says what
    they are. Settings share what is the same in them: maps, boxes before they grow, and
    crops; each one's time has its share of them in whole."""
    start = time.perf_counter()
    maps = tile_maps(img, detector, configs[0])
    model = time.perf_counter() - start
    boxes: dict[tuple, tuple[list, float]] = {}
    cuts: dict[bytes, np.ndarray] = {}

    def crop(quad: np.ndarray, ratio: float) -> np.ndarray:
        key = quad.tobytes() + struct.pack("d", ratio)
        if key not in cuts:
            cuts[key] = im.crop_quad(pixels, quad, ratio)
        return cuts[key]

    # Of equal channels one is cropped and scaled; the detector and the recogniser get three.
    pixels = img[..., :1].copy() if im.is_grey(img) else img

    out = []
    for config in configs:
        key = (config.det_thresh, config.box_thresh, config.max_candidates, config.min_side)
        if key not in boxes:
            start = time.perf_counter()
            boxes[key] = [boxes_of(prob, config) for *_, prob in maps], time.perf_counter() - start
        found, shared = boxes[key]
        start = time.perf_counter()
        grown = [(x, y, grown_quad(q, prob.shape, w, h, config)) for (x, y, w, h, prob), each in zip(maps, found, strict=True) for q, _ in each]
        quads = [q + (x, y) for x, y, q in grown if q is not None]
        det_ms = 1000 * (model + shared + time.perf_counter() - start)
        quads = [quads[i] for i in reading_order(quads, config.row_tolerance) if large_enough(quads[i], config)]
        quads = [quads[i] for i in im.suppress(quads, config.iom)]
        if not quads:
            reads, _, rec_ms, n = read_whole(pixels, recogniser, config)
            out.append((reads, det_ms, rec_ms, n))
            continue
        crops = [crop(q, config.rotate_ratio) for q in quads]
        start = time.perf_counter()
        steps = read_crops(recogniser, crops, config)
        rec_ms = 1000 * (time.perf_counter() - start)
        out.append(([{"seq": k, "box": _corners(q), "steps": s} for k, (q, s) in enumerate(zip(quads, steps, strict=True))], det_ms, rec_ms, len(crops)))
    return out


def in_cycles(read: Callable[[], tuple], cycles: int) -> tuple:
    """A read (reads, det_ms, rec_ms, n_crops) run once to warm up and once for each
    timed cycle: what the last one left, with the times of each timed one."""
    last, timed = read(), []
    for _ in range(cycles):
        last = read()
        timed.append({"det": last[1], "rec": last[2]})
    return *last, timed


def arrow_pass(frames: DataFrame, read: Callable[[np.ndarray, dict], Iterator[tuple]], fields: list[tuple[str, pa.DataType, str]], needs: tuple[str, ...] = ()) -> DataFrame:
    """Frames without pixels, each as often as `read` yields a tuple of its pixels and of
    its columns named in `needs`; the tuples are the new columns `fields` (name, Arrow
    type, SQL type). Pixels enter the pass and do not leave it."""
    names = frames.columns
    kept = [n for n in names if n != "bgr"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[int] = []
            out: list[tuple] = []
            for r in range(b.num_rows):
                get = lambda n: b.column(names.index(n))[r]  # noqa: B023, E731
                img = im.frame_view(get("bgr").as_buffer(), get("width").as_py(), get("height").as_py(), get("stride").as_py())
                out += read(img, {n: get(n).as_py() for n in needs})
                rows += [r] * (len(out) - len(rows))
            columns = list(zip(*out, strict=True)) if out else [()] * len(fields)
            same = b.select(kept).take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays([*same.columns, *(pa.array(c, t) for c, (_, t, _) in zip(columns, fields, strict=True))], names=[*kept, *(n for n, *_ in fields)])

    schema = ", ".join([*(f"`{n}` {frames.schema[n].dataType.simpleString()}" for n in kept), *(f"{n} {t}" for n, _, t in fields)])
    return frames.mapInArrow(run, schema)


#: What a read leaves of an image, as columns.
READ_FIELDS = [("reads", READS, READS_SQL), ("det_ms", pa.float64(), "double"), ("rec_ms", pa.float64(), "double"), ("n_crops", pa.int32(), "int")]

#: The same after cycles.
CYCLE_FIELDS = [*READ_FIELDS, ("timed", pa.list_(pa.struct([("det", pa.float64()), ("rec", pa.float64())])), "array<struct<det:double,rec:double>>")]


def read_by(frames: DataFrame, detector: Detector, recogniser: Recogniser, configs: list[ReadConfig]) -> DataFrame:
    """A row per frame and setting, in which only what follows the detector and precedes
    recognition may differ: `setting` (its place in `configs`), `reads`, an array of
    (seq, box, steps: likeliest class and probability of each), det_ms, the time of the
    detector and of that setting's boxes, rec_ms, that of recognition alone, and n_crops.
    Quads are put in reading order, small ones and covered ones go, the rest are cropped
    and read; a frame without any is read as one box that spans it. The detector sees a
    frame once. Pixels and class scores stay in the worker; other columns pass through."""

    def read(img: np.ndarray, _: dict) -> Iterator[tuple]:
        return ((k, *found) for k, found in enumerate(read_image(img, detector, recogniser, configs)))

    return arrow_pass(frames, read, [("setting", pa.int32(), "int"), *READ_FIELDS])
