"""What JPEG compression leaves of a frame.

The loss of a round trip is in the colour planes' rounding, the halved chroma and
the quantised cosine coefficients of 8 x 8 blocks; what follows them in a file,
entropy coding, has none. So the round trip needs no codec and no file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .imageops import frame_view, resize

# The example quantisation tables of the standard (ITU-T T.81, K.1 and
# K.2), row by row.
LUMA = """
16 11 10 16 24 40 51 61
12 12 14 19 26 58 60 55
14 13 16 24 40 57 69 56
14 17 22 29 51 87 80 62
18 22 37 56 68 109 103 77
24 35 55 64 81 104 113 92
49 64 78 87 103 121 120 101
72 92 95 98 112 100 103 99
"""
CHROMA = """
17 18 24 47 99 99 99 99
18 21 26 66 99 99 99 99
24 26 56 99 99 99 99 99
47 66 99 99 99 99 99 99
99 99 99 99 99 99 99 99
99 99 99 99 99 99 99 99
99 99 99 99 99 99 99 99
99 99 99 99 99 99 99 99
"""

_N = np.arange(8)
_DCT = np.cos((2 * _N[None, :] + 1) * _N[:, None] * np.pi / 16) / 2
_DCT[0] /= np.sqrt(2)


def steps(table: str, quality: int) -> np.ndarray:
    """The table's steps at a quality of 1 to 100, by the usual scale."""
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(table.split(), dtype=np.int64).reshape(8, 8) * scale + 50) // 100, 1, 255)


def _bytes(plane: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(plane), 0, 255).astype(np.uint8)


def _quantised(plane: np.ndarray, by: np.ndarray) -> np.ndarray:
    """A plane after its blocks' coefficients are rounded to multiples of `by`."""
    h, w = plane.shape
    wide = np.pad(plane, ((0, -h % 8), (0, -w % 8)), mode="edge").astype(np.float64) - 128
    tall, long = wide.shape
    blocks = wide.reshape(tall // 8, 8, long // 8, 8).swapaxes(1, 2)
    # Six decimals are kept, so that a tie does not hang on the last bit of a sum.
    kept = np.rint(np.round(_DCT @ blocks @ _DCT.T, 6) / by) * by
    back = (_DCT.T @ kept @ _DCT).swapaxes(1, 2).reshape(tall, long)
    return _bytes(np.round(back[:h, :w], 6) + 128)


def round_trip(img: np.ndarray, quality: int = 100) -> np.ndarray:
    """BGR pixels after compression with halved chroma and decoding."""
    if not img.size:
        return img.copy()
    h, w = img.shape[:2]
    b, g, r = (img[..., k].astype(np.float64) for k in range(3))
    y = _bytes(0.299 * r + 0.587 * g + 0.114 * b)
    planes = [y := _quantised(y, steps(LUMA, quality)).astype(np.float64)]
    for c in (0.5 * b - 0.168736 * r - 0.331264 * g + 128, 0.5 * r - 0.418688 * g - 0.081312 * b + 128):
        even = np.pad(_bytes(c), ((0, h % 2), (0, w % 2)), mode="edge").astype(np.float64)
        half = _bytes(even.reshape(even.shape[0] // 2, 2, even.shape[1] // 2, 2).mean(axis=(1, 3)))
        coarse = _quantised(half, steps(CHROMA, quality))
        planes.append(resize(coarse, even.shape[1], even.shape[0])[:h, :w].astype(np.float64) - 128)
    y, cb, cr = planes
    return np.stack([_bytes(y + 1.772 * cb), _bytes(y - 0.344136 * cb - 0.714136 * cr), _bytes(y + 1.402 * cr)], axis=-1)


def recompressed(frames: DataFrame, quality: int = 100) -> DataFrame:
    """Frames (width, height, stride, bgr and any others) as a receiver of JPEG frames
    sees them, in dense rows. A frame whose bytes don't hold its size stays as it is."""
    names = frames.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                columns = dict(zip(names, b.slice(k, 1).columns, strict=True))
                width, height, stride, data = (columns[n][0].as_py() for n in ("width", "height", "stride", "bgr"))
                if data and None not in (width, height, stride) and min(width, height) > 0 and stride >= 3 * width and len(data) >= stride * (height - 1) + 3 * width:
                    columns["bgr"] = pa.array([round_trip(frame_view(data, width, height, stride), quality).tobytes()], pa.binary())
                    columns["stride"] = pa.array([3 * width], pa.int32())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    return frames.mapInArrow(run, frames.schema)
