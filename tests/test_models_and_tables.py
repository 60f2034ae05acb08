import numpy as np

from framelake.config import DEFAULT
from framelake.operators import detect, models
from framelake.sources import sinks


class _Session:
    """Stands in for an inference session: answers with a fixed array."""

    def __init__(self, answer):
        self.answer, self.seen = answer, []

    def get_inputs(self):
        return [type("Input", (), {"name": "x"})()]

    def run(self, _, feeds):
        self.seen.append(feeds["x"].shape)
        return [self.answer]


def test_a_detector_from_a_file(monkeypatch):
    session = _Session(np.ones((1, 1, 480, 480), np.float32))
    monkeypatch.setattr(models, "_session", lambda path: session)
    assert models.onnx_detector("d.onnx")(np.zeros((480, 480, 3), np.float32)).shape == (480, 480)
    assert session.seen == [(1, 3, 480, 480)]
    session.answer = np.ones((1, 2, 4, 4), np.float32)
    img = np.zeros((480, 480, 3), np.uint8)
    assert models.onnx_detector("d.onnx")(img).size == 0 and detect.frame_quads(img, models.onnx_detector("d.onnx")) == []


def test_a_recogniser_from_a_file(monkeypatch):
    session = _Session(np.zeros((1, 40, 7), np.float32))
    monkeypatch.setattr(models, "_session", lambda path: session)
    out = models.onnx_recogniser("r.onnx")([np.zeros((48, 320, 3), np.float32)] * 2)
    assert [o.shape for o in out] == [(40, 7)] * 2 and session.seen == [(1, 3, 48, 320)] * 2
    session.answer = np.zeros((40, 7), np.float32)
    assert detect.read_crops(models.onnx_recogniser("r.onnx"), [np.zeros((48, 320, 3), np.uint8)] * 2, DEFAULT) == [[], []]


def test_piece_tables(spark):
    d = spark.sql("select 's' screen, 'r' id, 'own' engine, 0 seq, 0.98765D score, 'a \"b\"' text, array(named_struct('x', 1.5D, 'y', 2.5D), named_struct('x', 10D, 'y', 0.4D)) box")
    row = sinks.pieces_table(d).first()
    assert (row.score, row.corners, row.text) == ("0.987", "(2,2)-(10,0)", 'a "b"')
    assert sinks.piece_lines(d).first().line == '    [ 0] score=0.988 text="a "b""  box=(2,2)-(10,0)'
