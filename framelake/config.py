"""Settings of a read. The defaults are the tuned values of the system whose
results this engine matches."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ReadConfig:
    # Fixed values, all of them.
    # Detection: a pixel is text above det_thresh, a box stays from box_thresh on,
    # and grows by area * unclip / perimeter.
    det_thresh: float = 0.2
    box_thresh: float = 0.4
    unclip: float = 1.8
    max_candidates: int = 3000
    min_side: int = 3
    det_height: int = 480
    det_width: int = 480
    # Layout: tiles overlap, boxes of a row are at most row_tolerance apart, and one
    # that shares more than iom of the smaller area with a larger one goes.
    tile_overlap: int = 256
    row_tolerance: float = 10.0
    iom: float = 0.6
    min_height: float = 10.0
    min_width: float = 8.0
    # Recognition.
    rec_height: int = 48
    rec_width: int = 320
    rotate_ratio: float = 1.5
    drop_score: float = 0.4
    # A region is read with this margin around it.
    margin: int = 8


DEFAULT = ReadConfig()

# Fixed values.
#: Return codes of a read: fine; a missing argument, a bad frame size or a region
#: outside the frame; models or characters that cannot be loaded; a failed read.
OK, INVALID_ARGUMENT, LOAD_FAILED, READ_FAILED = 0, -1, -2, -3
