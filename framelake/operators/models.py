"""The models of a read, as plain callables.

A detector maps a float image (height x width x 3) to a probability map; a
recogniser maps crops to a steps x classes array each. The synthetic ones here
need no weights: they find dark ink and name crops by their ink, so that the flow
around them can be tested. Nothing about recognition accuracy follows from them.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np

Detector = Callable[[np.ndarray], np.ndarray]
Recogniser = Callable[[list[np.ndarray]], list[np.ndarray]]

#: What a model file's output of a wrong shape stands for.
NOTHING = np.zeros((0, 0), dtype=np.float32)


def ink_detector(img: np.ndarray) -> np.ndarray:
    """Darkness as probability."""
    if img.shape[2] != 3:
        return 1 - img.mean(axis=2) / 255
    out = img[..., 0] + img[..., 1]  # a mean over three is slow
    out += img[..., 2]
    out /= 3
    out /= 255
    return np.subtract(1, out, out=out)


#: A detector with this mark maps each pixel by itself: equal rows or columns of its
#: input are equal in its map, and it may be given one of them.
ink_detector.pixelwise = True


def _inked(crop: np.ndarray) -> np.ndarray:
    """The columns of a crop that are not all zero."""
    some = (crop != 0).any(axis=0).any(axis=1)
    n = int(some.sum())
    # The padding is on the right, as a rule.
    return np.ascontiguousarray(crop[:, :n]) if some[:n].all() else crop[:, np.flatnonzero(some)]


def ink_recogniser(n_classes: int = 12) -> Recogniser:
    """One character per crop: its class is the share of ink in steps."""

    def read(crops: list[np.ndarray]) -> list[np.ndarray]:
        out = []
        for crop in crops:
            p = np.full((3, n_classes), 0.05 / (n_classes - 1), dtype=np.float32)
            used = _inked(crop)
            used = used if used.size else crop
            ink = 1 - float(used.mean()) if used.size else 0.0
            p[:, 0] = 0.95
            p[1] = 0.05 / (n_classes - 1)
            p[1, 1 + min(n_classes - 2, int(ink * (n_classes - 1)))] = 0.95
            out.append(p)
        return out

    return read


def shade_recogniser(sure: list[float]) -> Recogniser:
    """One character per crop: its class is the shade of the darkest pixel, in steps of
    26 from class 1 on, with that class's probability in `sure`."""

    def read(crops: list[np.ndarray]) -> list[np.ndarray]:
        out = []
        for crop in crops:
            used = _inked(crop)  # without the padding
            shade = round(255 * float(used.min())) // 26 if used.size else 0
            n = len(sure) + 1
            p = np.zeros((3, n), dtype=np.float32)
            p[:, 0] = 1
            p[1] = (1 - sure[min(shade, n - 2)]) / (n - 1)
            p[1, 1 + min(shade, n - 2)] = sure[min(shade, n - 2)]
            out.append(p)
        return out

    return read


@functools.lru_cache(maxsize=4)
def _session(path: str):  # noqa: ANN202
    import onnxruntime

    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = 1
    return onnxruntime.InferenceSession(path, options, providers=["CPUExecutionProvider"])


def onnx_detector(path: str) -> Detector:
    """A detector from an ONNX file (1 x 3 x H x W in, 1 x 1 x H x W out), loaded once
    in each worker. The file must be where every executor can read it. An output of
    another shape is no map, and a read goes on without it."""

    def run(img: np.ndarray) -> np.ndarray:
        s = _session(path)
        out = s.run(None, {s.get_inputs()[0].name: img.transpose(2, 0, 1)[None].astype(np.float32)})[0]
        return out[0, 0] if out.ndim == 4 and out.shape[:2] == (1, 1) else NOTHING

    return run


def onnx_recogniser(path: str) -> Recogniser:
    """A recogniser from an ONNX file (1 x 3 x H x W in, 1 x steps x classes out).
    An output of another shape has no steps, and its crop reads as empty."""

    def run(crops: list[np.ndarray]) -> list[np.ndarray]:
        s = _session(path)
        outs = [s.run(None, {s.get_inputs()[0].name: c.transpose(2, 0, 1)[None].astype(np.float32)})[0] for c in crops]
        return [o[0] if o.ndim == 3 and o.shape[0] == 1 else NOTHING for o in outs]

    return run
