"""Image primitives in numpy, for Arrow functions.

Pixels are height x width x channels, uint8. Interpolations follow the usual
half-pixel convention; results may differ from a given library's in the last
level of a channel.
"""

from __future__ import annotations

import functools
import math

import numpy as np

# --- frames ---------------------------------------------------------------------


def frame_view(data: bytes, width: int, height: int, stride: int) -> np.ndarray:
    """A view over rows of `stride` bytes; nothing is copied."""
    raw = np.frombuffer(data, dtype=np.uint8)
    if stride < 3 * width or len(raw) < stride * (height - 1) + 3 * width:
        raise ValueError("fewer bytes than the frame needs")
    return np.lib.stride_tricks.as_strided(raw, (height, width, 3), (stride, 3, 1), writeable=False)


#: Pixels of an image below which looking for runs costs more than it saves.
_FEW = 1 << 14


def is_grey(img: np.ndarray) -> bool:
    """Whether all channels are equal, so that one stands for all."""
    if img.dtype == np.uint8 and img.shape[0] * img.shape[1] > _FEW:
        img = img[np.concatenate(([True], _fresh(img.reshape(img.shape[0], math.prod(img.shape[1:])))))]
    return all((img[..., 0] == img[..., k]).all() for k in range(1, img.shape[2]))


def _fresh(flat: np.ndarray) -> np.ndarray:
    """Whether each row but the first differs from the one before; bytes are compared
    eight at a time."""
    if flat.dtype.itemsize == 1 and flat.shape[1] % 8 == 0 and flat.shape[1] and flat.flags.c_contiguous:
        flat = flat.view(np.uint64)
    return (flat[1:] != flat[:-1]).any(axis=1)


def squeeze(img: np.ndarray, ends: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(small, rows, columns) with small[rows][:, columns] == img: runs of equal rows,
    and of equal columns, lose their middle. A run keeps `ends` at both ends and one
    between, so the pixels up to `ends` away from any pixel are the same as in small,
    and so is what an operator of that reach makes of them."""
    small, keep_y, keep_x = _ends(img, ends)
    back = lambda keep, n: np.repeat(np.arange(len(keep)), np.diff(keep, append=n))
    return small, back(keep_y, img.shape[0]), back(keep_x, img.shape[1])


def _run_ends(differs: np.ndarray, ends: int) -> np.ndarray:
    """The places that squeeze() keeps, given which differ from the one before."""
    n = len(differs) + 1
    first = np.concatenate(([0], np.flatnonzero(differs) + 1))
    size = np.diff(first, append=n)
    run = np.repeat(np.arange(len(first)), size)
    into = np.arange(n) - first[run]
    return np.flatnonzero(~((into > ends) & (into < size[run] - ends)))


def _fresh_columns(img: np.ndarray) -> np.ndarray:
    unlike = (img[:, 1:] != img[:, :-1]).any(axis=0)
    return unlike.reshape(len(unlike), math.prod(unlike.shape[1:])).any(axis=1)


def _ends(img: np.ndarray, ends: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """squeeze()'s small image and the rows and columns that it keeps."""
    keep_y = _run_ends(_fresh(img.reshape(img.shape[0], math.prod(img.shape[1:]))), ends)
    small = img[keep_y]
    keep_x = _run_ends(_fresh_columns(small), ends)
    return small[:, keep_x], keep_y, keep_x


class RunMap:
    """A map whose repeated rows and columns are held once: small[rows][:, columns],
    in which each row and column of `small` occurs, in order."""

    def __init__(self, small: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> None:
        self.small, self.rows, self.columns = small, rows, columns
        self.shape = (len(rows), len(columns))

    def __getitem__(self, at: tuple[slice, slice]) -> np.ndarray:
        return np.take(np.take(self.small, self.columns[at[1]], axis=1), self.rows[at[0]], axis=0)

    def __gt__(self, least: float) -> RunMap:
        return RunMap(self.small > least, self.rows, self.columns)

    def any(self) -> bool:
        return bool(self.small.any())

    def ends(self, ends: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """_ends() of the whole map."""

        def kept(fresh: np.ndarray, places: np.ndarray) -> np.ndarray:
            return _run_ends((places[1:] != places[:-1]) & np.concatenate(([False], fresh))[places[1:]], ends)

        keep_y = kept(_fresh(self.small), self.rows)
        keep_x = kept(_fresh_columns(self.small), self.columns)
        return self.small[self.rows[keep_y]][:, self.columns[keep_x]], keep_y, keep_x


@functools.lru_cache(maxsize=256)
def _stretch(n: int, to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(low, high, weight of high, sum of both weights) for each of `to` pixels out of
    n, as whole numbers."""
    at = (2 * np.arange(to, dtype=np.int64) + 1) * n - to  # in units of 1 / (2 to)
    low, part = at // (2 * to), at % (2 * to)
    unit = int(np.gcd(np.gcd.reduce(part), 2 * to))
    return np.clip(low, 0, n - 1), np.clip(low + 1, 0, n - 1), part // unit, 2 * to // unit


def _blend(a: np.ndarray, b: np.ndarray, part: np.ndarray, unit: int, kind: type) -> np.ndarray:
    """a * unit + (b - a) * part, along the first axis."""
    out = b.astype(kind)
    np.subtract(out, a, out=out)
    out *= part.astype(kind).reshape(-1, *[1] * (a.ndim - 1))
    out += a * kind(unit)
    return out


def _resized(img: np.ndarray, width: int, height: int, one: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """(small, rows, columns) of which small[rows][:, columns], or small where there are
    none, is the image of the new size: bilinear of bytes in whole numbers, exact halves
    to even. Runs of equal rows or columns are computed once, and equal channels too,
    of which `one` asks for one."""
    h, w = img.shape[:2]
    (y0, y1, fy, uy), (x0, x1, fx, ux) = _stretch(h, height), _stretch(w, width)
    runs = width * height > _FEW
    if runs:
        flat = img.reshape(h, math.prod(img.shape[1:]))
        starts = np.concatenate(([True], _fresh(flat)))
        y0, y1 = (np.cumsum(starts) - 1)[y0], (np.cumsum(starts) - 1)[y1]
    else:
        starts = slice(None)
    few = img[starts]
    channels = img.shape[2] if img.ndim == 3 else 0
    if channels > 1 and is_grey(few):
        few = few[..., 0]
    few = np.ascontiguousarray(few.swapaxes(0, 1))  # columns first
    column = np.arange(w)
    if runs:
        across = few.reshape(w, -1)
        column = np.cumsum(np.concatenate(([True], _fresh(across)))) - 1

    def outputs(low: np.ndarray, high: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which outputs differ from the one before, and each one's place among them."""
        fresh = np.ones(len(low), dtype=bool)
        fresh[1:] = (low[1:] != high[1:]) & (part[1:] != 0) | (low[1:] != low[:-1]) | (low[:-1] != high[:-1]) & (part[:-1] != 0)
        return np.flatnonzero(fresh), np.cumsum(fresh) - 1

    at_x, spread_x = outputs(column[x0], column[x1], fx) if runs else (slice(None), None)
    at_y, spread_y = outputs(y0, y1, fy) if runs else (slice(None), None)
    kind = np.int32 if 255 * ux * uy < 1 << 31 else np.int64
    wide = _blend(few[x0[at_x]].astype(kind), few[x1[at_x]], fx[at_x], ux, kind).swapaxes(0, 1)
    wide = np.ascontiguousarray(wide)
    total = _blend(wide[y0[at_y]], wide[y1[at_y]], fy[at_y], uy, kind)
    out = np.rint(total / (ux * uy)).astype(np.uint8)  # an exact half is one in floats too
    return np.repeat(out[..., None], channels, axis=2) if out.ndim < img.ndim and not one else out, spread_y, spread_x


def resize(img: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, pixel centres at halves, edges repeated."""
    h, w = img.shape[:2]
    if (h, w) == (height, width):
        return img.copy()
    if img.dtype == np.uint8 and img.size and width and height:
        return spread(*_resized(img, width, height))

    def axis(n: int, to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = (np.arange(to) + 0.5) * n / to - 0.5
        low = np.floor(at)
        return np.clip(low, 0, n - 1).astype(int), np.clip(low + 1, 0, n - 1).astype(int), at - low

    y0, y1, fy = axis(h, height)
    x0, x1, fx = axis(w, width)
    src = img.astype(np.float64)
    fx = fx.reshape(1, -1, *[1] * (img.ndim - 2))
    fy = fy.reshape(-1, 1, *[1] * (img.ndim - 2))
    rows = src[:, x0] * (1 - fx) + src[:, x1] * fx
    out = rows[y0] * (1 - fy) + rows[y1] * fy
    return np.rint(out).astype(img.dtype) if img.dtype == np.uint8 else out.astype(img.dtype)


def detector_input(img: np.ndarray, width: int, height: int) -> tuple[np.ndarray, float, float]:
    """(tensor, ratio_w, ratio_h): stretched to the input's size, unscaled floats."""
    return _floats(img, width, height), width / img.shape[1], height / img.shape[0]


def detector_parts(img: np.ndarray, width: int, height: int) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """detector_input() without its repeated rows and columns: (small, rows, columns)."""
    small, rows, columns = _resized(img, width, height)
    return small.astype(np.float32), rows, columns


def spread(small: np.ndarray, rows: np.ndarray | None, columns: np.ndarray | None) -> np.ndarray:
    """small[rows][:, columns], small without them"""
    if rows is None or columns is None:
        return small
    return np.take(np.take(small, columns, axis=1), rows, axis=0)


def _floats(img: np.ndarray, width: int, height: int, most: float = 1) -> np.ndarray:
    """resize() in floats, by `most`."""
    if img.dtype != np.uint8 or not img.size or img.shape[:2] == (height, width):
        out = resize(img, width, height).astype(np.float32)
        return out / most if most != 1 else out
    small, rows, columns = _resized(img, width, height)
    small = small.astype(np.float32)
    return spread(small / most if most != 1 else small, rows, columns)


def letterbox(img: np.ndarray, width: int, height: int) -> np.ndarray:
    """Scaled to the input's height, padded with zeros on the right, over 255."""
    w = min(max(math.ceil(height * img.shape[1] / max(img.shape[0], 1)), 1), width)
    out = np.zeros((height, width, 3), dtype=np.float32)
    if img.dtype != np.uint8 or not img.size or img.shape[:2] == (height, w):
        out[:, :w] = _floats(img, w, height, 255)
        return out
    small, rows, columns = _resized(img, w, height, one=True)
    pixels = spread(small.astype(np.float32) / 255, rows, columns)
    if pixels.ndim == 3 and pixels.shape[2] > 1:
        out[:, :w] = pixels
    else:
        for k in range(3):
            out[:, :w, k] = pixels.reshape(height, w)
    return out


def edge_colour(img: np.ndarray) -> np.ndarray:
    """The mean colour along the border, its corners counted twice."""
    h, w = img.shape[:2]
    flat = img.reshape(h, w, -1)
    first, last, left, right = (np.ascontiguousarray(e, dtype=np.float64).mean(0) for e in (flat[0], flat[-1], flat[:, 0], flat[:, -1]))
    across, down = first + last, left + right
    return (across * w + down * h) / (2 * (w + h))


def pad_to(img: np.ndarray, width: int, height: int) -> np.ndarray:
    """Padded on the right and below to at least this size with the edge colour."""
    h, w = img.shape[:2]
    out = np.empty((max(h, height), max(w, width), *img.shape[2:]), dtype=img.dtype)
    row = np.empty(out.shape[1:], dtype=img.dtype)  # whole rows are copied, not pixels
    row[...] = np.rint(edge_colour(img)).astype(img.dtype) if img.ndim == 3 else np.rint(edge_colour(img)[0]).astype(img.dtype)
    out[:h, w:], out[h:] = row[w:], row
    out[:h, :w] = img
    return out


def _cubic(t: np.ndarray) -> np.ndarray:
    """The four weights of the cubic kernel with a = -0.75."""
    a = -0.75
    d = np.stack([t + 1, t, 1 - t, 2 - t])
    near = ((a + 2) * d - (a + 3)) * d * d + 1
    far = ((a * d - 5 * a) * d + 8 * a) * d - 4 * a
    return np.where(d <= 1, near, far)


def perspective(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The 3 x 3 map that takes four src points to four dst points."""
    rows, right = [], []
    for (x, y), (u, v) in zip(src, dst, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1).reshape(3, 3)


def _even(img: np.ndarray) -> np.ndarray:
    """For each pixel from two before to one after the image, whether the four by four
    from the one above and left of it are equal, edges repeated."""
    across, down = True, True
    for k in range(1 if is_grey(img) else img.shape[2]):
        p = np.pad(img[..., k], 3, mode="edge")
        across, down = (p[:, 1:] == p[:, :-1]) & across, (p[1:] == p[:-1]) & down
    n, m = img.shape[0] + 3, img.shape[1] + 3
    flat = across[:, :m] & across[:, 1 : m + 1] & across[:, 2 : m + 2]
    tall = down[:n] & down[1 : n + 1] & down[2 : n + 2]
    return flat[:n] & flat[1 : n + 1] & flat[2 : n + 2] & flat[3 : n + 3] & tall[:, :m]


def crop_quad(img: np.ndarray, quad: np.ndarray, rotate_ratio: float = 1.5) -> np.ndarray:
    """The quad as an upright crop: perspective map, cubic, border repeated; turned
    a quarter to the left where it is tall."""
    (x, y), _, (right, bottom), _ = quad.tolist()
    if straight := upright(quad) and x.is_integer() and y.is_integer() and right.is_integer() and bottom.is_integer():
        w, h = int(right - x), int(bottom - y)
    else:
        side = lambda a, b: float(np.hypot(*(quad[a] - quad[b])))
        w, h = int(max(side(0, 1), side(2, 3))), int(max(side(0, 3), side(1, 2)))
    if w < 1 or h < 1:
        return np.zeros((0, 0, img.shape[2]), dtype=np.uint8)
    if straight:
        # Upright with whole corners: the map is a shift, the kernel the pixel itself.
        if x >= 0 and y >= 0 and x + w <= img.shape[1] and y + h <= img.shape[0]:
            crop = img[int(y) : int(y) + h, int(x) : int(x) + w]
            return np.rot90(crop).copy() if h / w >= rotate_ratio else crop
        rows, columns = np.clip(np.arange(h) + int(y), 0, img.shape[0] - 1), np.clip(np.arange(w) + int(x), 0, img.shape[1] - 1)
        crop = img[rows[:, None], columns]
        return np.rot90(crop).copy() if h / w >= rotate_ratio else crop
    back = perspective(np.array([[0, 0], [w, 0], [w, h], [0, h]], float), quad)
    u, v = np.meshgrid(np.arange(w), np.arange(h))
    at = np.einsum("ij,jhw->ihw", back, np.stack([u, v, np.ones_like(u)]).astype(float))
    x, y = at[0] / at[2], at[1] / at[2]
    x, y = x.ravel(), y.ravel()
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    # Only the part of the image around the quad is looked at.
    part = [(min(max(int(v.min()) - 3, 0), n - 1), min(max(int(v.max()) + 4, 0), n - 1)) for v, n in ((x0, img.shape[1]), (y0, img.shape[0]))]
    (left, right), (top, bottom) = part
    img = img[top : bottom + 1, left : right + 1]
    fx, fy, x0, y0 = x - x0, y - y0, x0 - left, y0 - top
    # The weights' sum is 1: where all sixteen pixels are equal, so is the result.
    crop = np.take(img.reshape(-1, img.shape[2]), np.clip(y0, 0, img.shape[0] - 1) * img.shape[1] + np.clip(x0, 0, img.shape[1] - 1), axis=0)
    mixed = np.flatnonzero(~_even(img)[np.clip(y0, -2, img.shape[0]) + 2, np.clip(x0, -2, img.shape[1]) + 2])
    x0, y0 = x0[mixed], y0[mixed]
    wx, wy = _cubic(fx[mixed]), _cubic(fy[mixed])
    grey = is_grey(img)
    source = (img[..., :1] if grey else img).astype(np.float64).reshape(img.shape[0] * img.shape[1], -1).T
    planes = [np.zeros(len(mixed)) for _ in source]
    columns = [np.clip(x0 + i - 1, 0, img.shape[1] - 1) for i in range(4)]
    for j in range(4):
        row = np.clip(y0 + j - 1, 0, img.shape[0] - 1) * img.shape[1]
        for i in range(4):
            at, weight = row + columns[i], wy[j] * wx[i]
            for plane, pixels in zip(planes, source, strict=True):
                plane += weight * pixels[at]
    crop[mixed] = np.stack([np.clip(np.rint(p), 0, 255).astype(np.uint8) for p in (planes * img.shape[2] if grey else planes)], axis=1)
    crop = crop.reshape(h, w, img.shape[2])
    return np.rot90(crop).copy() if h / w >= rotate_ratio else crop


# --- detection ------------------------------------------------------------------


def binarize(prob: np.ndarray | RunMap, thresh: float) -> np.ndarray | RunMap:
    return prob > thresh


#: The eight directions around a pixel, clockwise on the screen, from the right.
_RING = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))


def _turns() -> bytes:
    """For a pixel's eight neighbours (a bit for each direction) and the direction back
    to where a border comes from: the direction it goes on in, the first neighbour
    counter-clockwise, and 8 if it passes an empty pixel on the right."""
    out = bytearray(256 * 8)
    for code in range(1, 256):
        for back in range(8):
            passed = 0
            for k in range(1, 9):
                d = (back - k) % 8
                if code >> d & 1:
                    break
                passed |= 8 * (d == 0)
            out[8 * code + back] = d | passed
    return bytes(out)


_TURNS = _turns()


def contours(mask: np.ndarray | RunMap) -> list[np.ndarray]:
    """Outer and hole borders of the 8-connected regions, as (x, y) points, by
    border following (Suzuki and Abe, 1985); straight runs keep their ends. Inside a
    run of equal rows or columns borders go straight, so only its ends are followed."""
    if not mask.any():
        return []
    small, ys, xs = mask.ends(1) if isinstance(mask, RunMap) else _ends(mask, 1)
    h, w = small.shape
    wide = w + 2
    f = np.zeros((h + 2, wide), dtype=np.uint8)
    f[1:-1, 1:-1] = small
    code = np.zeros((h + 2, wide), dtype=np.uint8)
    for d, (dy, dx) in enumerate(_RING):
        code[1:-1, 1:-1] |= f[1 + dy : h + 1 + dy, 1 + dx : w + 1 + dx] << d
    # A border begins where a row enters a region, or leaves one into a hole.
    flat = f.ravel()
    enters = np.flatnonzero(flat[1:] > flat[:-1]) + 1
    leaves = np.flatnonzero(flat[:-1] > flat[1:])
    starts = np.sort(np.concatenate([2 * enters, 2 * leaves + 1])).tolist()
    # 1: not followed; 2: followed; 3: followed, with an empty pixel on the right.
    state, codes = bytearray(flat.tobytes()), code.tobytes()
    offsets = tuple(dy * wide + dx for dy, dx in _RING)
    places: list[int] = []
    until = [0]
    for s in starts:
        at, hole = s >> 1, s & 1
        if state[at] == 3 or not hole and state[at] == 2:
            continue
        places += _follow(state, codes, offsets, at, 0 if hole else 4)
        until.append(len(places))
    p = np.array(places, dtype=np.int64)
    points = np.stack([xs[p % wide - 1], ys[p // wide - 1]], axis=1)
    return [points[a:b] for a, b in zip(until[:-1], until[1:], strict=True)]


def _follow(state: bytearray, codes: bytes, offsets: tuple[int, ...], start: int, outside: int) -> list[int]:
    """The places where the border from `start` on turns."""
    code = codes[start]
    if not code:
        state[start] = 3
        return [start]
    d = next(d % 8 for d in range(outside, outside + 8) if code >> d % 8 & 1)  # clockwise from the outside
    first = start + offsets[d]
    out: list[int] = []
    here, back, before, begun = start, d, -1, -1
    turns = _TURNS
    while True:
        d = turns[8 * codes[here] + back]
        if d > 7:
            d -= 8
            state[here] = 3
        elif state[here] == 1:
            state[here] = 2
        if d != before:
            out.append(here)
            if begun < 0:
                begun = d
        nxt = here + offsets[d]
        if nxt == start and here == first:
            return out if d != begun or len(out) < 2 else out[1:]
        here, back, before = nxt, (d + 4) & 7, d


def hull(points: np.ndarray) -> np.ndarray:
    """The convex hull, counter-clockwise in mathematical axes (Andrew)."""
    pts = sorted(set(map(tuple, np.asarray(points, float).tolist())))  # by x, then y
    if len(pts) < 3:
        return np.array(pts, float)

    def half(seq: list) -> list:
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]), float)


@functools.lru_cache(maxsize=4096)
def _known_hull(points: bytes) -> tuple[np.ndarray, bool]:
    """The hull of whole-numbered points, and whether its smallest box is upright."""
    p = hull(np.frombuffer(points, dtype=np.int64).reshape(-1, 2))
    if len(p) < 3:
        return p, False
    k, along, *_ = _best_side(p)
    return p, bool((along[k] == 0).any())


def _hull(points: np.ndarray) -> tuple[np.ndarray, bool]:
    """The hull, and whether its smallest box is known to be upright. Outlines of one
    shape have one hull, wherever they are."""
    whole = points.astype(np.int64)
    if len(points) < 16 or not np.array_equal(whole, points):
        return hull(points), False
    p, upright = _known_hull((whole - whole[0]).tobytes())
    return p + whole[0], upright


def _best_side(p: np.ndarray) -> tuple:
    """Of a hull's sides the first on which the smallest box lies; the directions along
    and across all sides; the extents in them."""
    along = np.concatenate([p[1:], p[:1]]) - p
    along /= np.hypot(along[:, 0], along[:, 1])[:, None]
    across = np.stack([-along[:, 1], along[:, 0]], axis=1)
    s, t = along @ p.T, across @ p.T  # a row for each side of the hull
    s0, s1, t0, t1 = s.min(axis=1), s.max(axis=1), t.min(axis=1), t.max(axis=1)
    size = (s1 - s0) * (t1 - t0)
    return int(np.flatnonzero(size <= size.min() + 1e-9)[0]), along, across, s0, s1, t0, t1


def smallest_box(points: np.ndarray) -> tuple[np.ndarray, float]:
    """(quad, short side) of the rectangle of least area around the points: one of
    its sides lies on a side of the hull."""
    points = np.asarray(points, float)
    listed = set(map(tuple, points.tolist()))
    xs, ys = zip(*listed, strict=True)
    x0, y0, x1, y1 = min(xs), min(ys), max(xs), max(ys)
    if x0 < x1 and y0 < y1 and {(x0, y0), (x1, y0), (x1, y1), (x0, y1)} <= listed:
        return np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1]]), min(x1 - x0, y1 - y0)  # its hull is upright
    p, upright = _hull(points)
    if upright:
        return np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1]]), min(x1 - x0, y1 - y0)
    if len(p) == 1:
        return np.repeat(p, 4, axis=0), 0.0
    k, along, across, s0, s1, t0, t1 = _best_side(p)
    u, v = along[k], across[k]
    corners = np.array([u * x + v * y for x, y in ((s0[k], t0[k]), (s1[k], t0[k]), (s1[k], t1[k]), (s0[k], t1[k]))])
    return order_quad(corners), float(min(s1[k] - s0[k], t1[k] - t0[k]))


def order_quad(corners: np.ndarray) -> np.ndarray:
    """Four points as top left, top right, bottom right, bottom left."""
    a, b, c, d = sorted(corners.tolist(), key=lambda p: p[0])
    if b[1] <= a[1]:
        a, b = b, a
    if d[1] <= c[1]:
        c, d = d, c
    return np.array([a, c, d, b])


def polygon_area(p: np.ndarray) -> float:
    if len(p) == 4 and upright(p):
        return float((p[2, 0] - p[0, 0]) * (p[2, 1] - p[0, 1]))
    x, y = p[:, 0], p[:, 1]
    return abs(float(x @ np.concatenate([y[1:], y[:1]]) - y @ np.concatenate([x[1:], x[:1]]))) / 2


def perimeter(p: np.ndarray) -> float:
    if len(p) == 4 and upright(p):
        return float(2 * (p[2, 0] - p[0, 0] + (p[2, 1] - p[0, 1])))
    return float(np.hypot(*(p - np.concatenate([p[1:], p[:1]])).T).sum())


_ANGLES = np.arange(0, 2 * math.pi, math.pi / 64)
_RING_OF = np.stack([np.cos(_ANGLES), np.sin(_ANGLES)], axis=1)


def unclip(quad: np.ndarray, ratio: float) -> np.ndarray:
    """The quad grown by area * ratio / perimeter with round corners, as points;
    empty for a quad without extent. Its corners lose their fractions first."""
    around = perimeter(quad)
    d = polygon_area(quad) * ratio / around if around else 0.0
    base = np.trunc(quad)
    if d <= 0 or polygon_area(base) == 0:
        return np.zeros((0, 2))
    # The outline in each direction: the farthest corner, and d further.
    far = base[np.argmax(base @ _RING_OF.T, axis=0)]
    return np.rint(far + d * _RING_OF)


def upright(quad: np.ndarray) -> bool:
    """Whether a quad from top left on is an upright rectangle with an extent."""
    (ax, ay), (bx, by), (cx, cy), (dx, dy) = quad.tolist()
    return ay == by and cy == dy and ax == dx and bx == cx and ax < bx and ay < cy


@functools.lru_cache(maxsize=4096)
def _grown_is_upright(w: int, h: int, ratio: float, left: float, up: float, right: float, down: float) -> bool:
    """Whether the smallest box around a grown rectangle is upright. All but its four
    outermost points have no exact halves, so they don't depend on where it is."""
    points = unclip(np.array([[0, 0], [w, 0], [w, h], [0, h]], float), ratio)
    points[0, 0], points[32, 1], points[64, 0], points[96, 1] = w + right, h + down, left, up
    return _hull(points)[1]


def grown_rectangle(x0: int, y0: int, x1: int, y1: int, ratio: float) -> tuple[float, float, float, float] | None:
    """smallest_box(unclip()) of an upright rectangle, where it is upright itself."""
    w, h = x1 - x0, y1 - y0
    d = w * h * ratio / (2 * (w + h))
    if d < 1:
        return None
    a, b, c, e = round(x0 - d), round(y0 - d), round(x1 + d), round(y1 + d)
    return (a, b, c, e) if _grown_is_upright(w, h, ratio, a - x0, b - y0, c - x1, e - y1) else None


def filled(quad: np.ndarray, width: int, height: int) -> np.ndarray:
    """The pixels of a polygon with integer corners, its border included."""
    y, x = np.ogrid[0:height, 0:width]
    inside = np.zeros((height, width), dtype=bool)
    border = np.zeros((height, width), dtype=bool)
    n = len(quad)
    for k in range(n):
        (x0, y0), (x1, y1) = quad[k], quad[(k + 1) % n]
        if y0 != y1:
            crosses = (y >= min(y0, y1)) & (y < max(y0, y1))
            inside ^= crosses & (x < x0 + (y - y0) * (x1 - x0) / (y1 - y0))
        steps = int(max(abs(x1 - x0), abs(y1 - y0), 1))
        t = np.arange(steps + 1) / steps
        bx, by = np.rint(x0 + t * (x1 - x0)).astype(int), np.rint(y0 + t * (y1 - y0)).astype(int)
        ok = (bx >= 0) & (bx < width) & (by >= 0) & (by < height)
        border[by[ok], bx[ok]] = True
    return inside | border


def box_score(prob: np.ndarray | RunMap, quad: np.ndarray) -> float:
    """The mean probability inside a quad, whose corners lose their fractions."""
    h, w = prob.shape
    into = lambda v, n: min(max(int(v), 0), n - 1)
    (lx, ly), (hx, hy) = quad.min(axis=0).tolist(), quad.max(axis=0).tolist()
    x0, x1, y0, y1 = into(math.floor(lx), w), into(math.ceil(hx), w), into(math.floor(ly), h), into(math.ceil(hy), h)
    if upright(quad) and (x0, y0, x1, y1) == (int(lx), int(ly), int(hx), int(hy)):
        return float(prob[y0 : y1 + 1, x0 : x1 + 1].ravel().mean())
    mask = filled(np.trunc(quad) - (x0, y0), x1 - x0 + 1, y1 - y0 + 1)
    return float(prob[y0 : y1 + 1, x0 : x1 + 1][mask].mean()) if mask.any() else 0.0


def convex_overlap(a: np.ndarray, b: np.ndarray) -> float:
    """The area that two convex polygons share (Sutherland and Hodgman, 1974)."""
    a, b = hull(a), hull(b)
    if len(a) < 3 or len(b) < 3:
        return 0.0
    out = a.tolist()
    for (x0, y0), (x1, y1) in zip(b.tolist(), np.roll(b, -1, axis=0).tolist(), strict=True):
        side = lambda p: (x1 - x0) * (p[1] - y0) - (y1 - y0) * (p[0] - x0)  # noqa: B023, E731
        left = []
        for p, q in zip(out, out[1:] + out[:1], strict=True):
            sp, sq = side(p), side(q)
            if sp >= 0:
                left.append(p)
            if (sp > 0) != (sq > 0) and sp != sq:
                t = sp / (sp - sq)
                left.append([p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])])
        out = left
        if len(out) < 3:
            return 0.0
    return polygon_area(np.array(out))


def iom(a: np.ndarray, b: np.ndarray) -> float:
    """What two quads share of the smaller one's area."""
    return convex_overlap(a, b) / (min(polygon_area(a), polygon_area(b)) + 1e-6)


def suppress(quads: list[np.ndarray], threshold: float) -> list[int]:
    """The places of the quads that stay, the largest first deciding, in their own
    order. Bounds are compared before areas."""
    areas = [polygon_area(q) for q in quads]
    bounds = [(*q.min(axis=0).tolist(), *q.max(axis=0).tolist()) for q in quads]
    straight = [upright(q) for q in quads]

    def share(i: int, k: int) -> float:
        if not (straight[i] and straight[k]):
            return iom(quads[i], quads[k])
        a, b = bounds[i], bounds[k]
        return (min(a[2], b[2]) - max(a[0], b[0])) * (min(a[3], b[3]) - max(a[1], b[1])) / (min(areas[i], areas[k]) + 1e-6)

    kept: list[int] = []
    for i in sorted(range(len(quads)), key=lambda k: -areas[k]):
        x0, y0, x1, y1 = bounds[i]
        meets = (k for k in kept if bounds[k][0] <= x1 and x0 <= bounds[k][2] and bounds[k][1] <= y1 and y0 <= bounds[k][3])
        if not any(share(i, k) > threshold for k in meets):
            kept.append(i)
    return sorted(kept)


# --- preparation for other engines ----------------------------------------------


def brighten(img: np.ndarray, by: int) -> np.ndarray:
    return np.minimum(img.astype(np.int16) + by, 255).astype(np.uint8)


def _padded(img: np.ndarray) -> np.ndarray:
    """With one pixel more on each side, edges repeated."""
    return np.pad(img, ((1, 1), (1, 1), *[(0, 0)] * (img.ndim - 2)), mode="edge")


def sharpen(img: np.ndarray, amount: float) -> np.ndarray:
    """Away from the mean of the neighbourhood."""
    p = _padded(img).astype(np.int32)
    across = p[:, :-2] + p[:, 1:-1] + p[:, 2:]
    mean = (across[:-2] + across[1:-1] + across[2:]) / 9
    wide = img.astype(np.float64)
    return np.clip(np.rint(wide + amount * (wide - mean)), 0, 255).astype(np.uint8)


def greyscale(img: np.ndarray) -> np.ndarray:
    """Luma of BGR pixels, in all three channels."""
    luma = np.rint(img.astype(np.float64) @ (0.114, 0.587, 0.299)).astype(np.uint8)
    return np.repeat(luma[..., None], 3, axis=2)


def remove_noise(img: np.ndarray) -> np.ndarray:
    """The median of the neighbourhood: that of the largest of the columns' least, the
    middle one of their medians and the least of their largest."""
    low, high = np.minimum, np.maximum

    def middle(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        return high(low(a, b), low(high(a, b), c))

    p = _padded(img)
    a, b, c = p[:-2], p[1:-1], p[2:]
    least, mid, most = low(low(a, b), c), middle(a, b, c), high(high(a, b), c)
    at = lambda v, k: v[:, k : k + img.shape[1]]
    return middle(high(high(at(least, 0), at(least, 1)), at(least, 2)), middle(at(mid, 0), at(mid, 1), at(mid, 2)), low(low(at(most, 0), at(most, 1)), at(most, 2)))


def prepare(img: np.ndarray, enlarge: int = 1, filters: bool = False, amount: float = 0.85) -> np.ndarray:
    """A crop as another engine gets it: enlarged, then, with filters, brightened so
    that its brightest value before is the highest, sharpened, grey, without noise."""
    brightest = int(img.max()) if img.size else 255
    if enlarge > 1:
        img = resize(img, img.shape[1] * enlarge, img.shape[0] * enlarge)
    if filters and img.size:
        # A pixel depends on those up to two away, so that runs need their ends only.
        img, rows, columns = squeeze(img, 2)
        if brightest < 255:
            img = brighten(img, 255 - brightest)
        grey = greyscale(sharpen(img, amount))[..., 0]
        img = spread(np.repeat(remove_noise(grey)[..., None], 3, axis=2), rows, columns)
    return img
