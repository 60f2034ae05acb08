"""A quality classifier: logistic regression on hashed word n-grams, trained with
follow-the-regularised-leader updates (McMahan et al., 2013) and scored as sparse
dot products.

Features of a text: single words and pairs of words, once as they stand and once
as shapes (runs of lower case, upper case and digits fall together, other
characters stay, a word that repeats the one before is marked), each hashed into
2^BITS buckets. A bucket's value is 1 + ln(count), and the vector has length one.
Only the text makes features.

Training reads a bounded sample of labelled rows, chosen by a hash of the id, in the
order of another hash. Its vectors stay in the shared folder: the driver holds them
where they are few bytes and streams them by partition, once a pass, where texts are
long. The weights are one vector of fixed size, which the scoring tasks get by
broadcast. Scoring is one pass over whole texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import encoded, slices, written

BITS = 18
#: Labelled documents that training reads at most.
SAMPLE_ROWS = 4_000
#: Passes over the sample at least, and updates at least: a small sample is seen more
#: often, as FTRL's steps shrink with what a weight has seen.
EPOCHS = 4
UPDATES = 16_000
THRESHOLD = 0.3
MOST_TEXT = 4 << 20
#: Bytes of the sample's vectors that the driver holds at most.
HELD = 64 << 20
#: Seed of the order in which training sees the sample.
ORDER = 7

_M1, _M2, _P = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), 0x100000001B3


def _classes() -> np.ndarray:
    c = np.arange(256, dtype=np.uint8)
    c[ord("a") : ord("z") + 1] = ord("a")
    c[128:] = ord("a")
    c[ord("A") : ord("Z") + 1] = ord("A")
    c[ord("0") : ord("9") + 1] = ord("0")
    return c


_CLASS = _classes()
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p^i and p^-i modulo 2^64, grown as texts need it."""
    global _POW  # noqa: PLW0603
    if len(_POW[0]) < n:
        size = max(n, 1 << 16)
        one = np.full(size, _P, dtype=np.uint64)
        back = np.full(size, pow(_P, -1, 1 << 64), dtype=np.uint64)
        one[0] = back[0] = 1
        _POW = np.multiply.accumulate(one), np.multiply.accumulate(back)
    return _POW


_POW = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


def _hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial hash of each codes[start:end], the same wherever it stands."""
    up, down = _powers(len(codes) + 1)
    total = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=total[1:])
    return _mixed((total[ends] - total[starts]) * down[starts])


def features(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a whole text and their values; none for a text without words."""
    codes = np.frombuffer(encoded(text), dtype=np.uint8)
    solid = np.concatenate(([False], ~_BLANK[codes], [False]))
    starts, ends = np.flatnonzero(solid[1:] & ~solid[:-1]), np.flatnonzero(~solid[1:] & solid[:-1])
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0)
    words = _hashes(codes, starts, ends)
    kinds = _CLASS[codes]
    # A byte stays if it differs from the one before it or begins a word.
    stays = np.ones(len(codes), dtype=bool)
    stays[1:] = kinds[1:] != kinds[:-1]
    stays[starts] = True
    place = np.concatenate(([0], np.cumsum(stays)))
    shapes = _hashes(kinds[stays], place[starts], place[ends])
    again = np.concatenate(([False], words[1:] == words[:-1]))
    shapes = np.where(again, shapes ^ np.uint64(0x9E3779B97F4A7C15), shapes)
    salt = [np.uint64(s) for s in (0x1B873593, 0x2545F4914F6CDD1D, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
    pair = lambda h, s: _mixed(h[:-1] * _M1 + (h[1:] ^ s))
    grams = np.concatenate((_mixed(words ^ salt[0]), pair(words, salt[1]), _mixed(shapes ^ salt[2]), pair(shapes, salt[3])))
    index, count = np.unique(grams >> np.uint64(64 - bits), return_counts=True)
    value = 1 + np.log(count)
    return index.astype(np.int64), value / np.sqrt(value @ value)


class Sample:
    """The rows (buckets, values, label) of a written sample, in the order of a hash;
    each iteration gives them anew, from memory or from the table."""

    def __init__(self, table: DataFrame, held: int = HELD) -> None:
        self.count, size = table.agg(F.count("*"), F.sum(F.length("i") + F.length("x"))).first()
        self.table = table.orderBy(F.xxhash64(F.lit(ORDER), "id"), "id")
        self.rows = self.table.collect() if (size or 0) <= held else None

    def __len__(self) -> int:
        return self.count

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        for r in self.table.toLocalIterator() if self.rows is None else self.rows:
            yield np.frombuffer(r["i"], "<i4").astype(np.int64), np.frombuffer(r["x"], "<f4").astype(float), r["y"]


def train(rows: Collection[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> np.ndarray:
    """FTRL-proximal over the rows (buckets, values, label); the last weight is the
    intercept. Classes count alike, so that a rare one is learnt."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(i: np.ndarray) -> np.ndarray:
        at = z[i]
        return np.where(np.abs(at) <= l1, 0.0, -(at - np.sign(at) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    ones = sum(y for _, _, y in rows)
    worth = (len(rows) / (2 * max(len(rows) - ones, 1)), len(rows) / (2 * max(ones, 1)))
    for _ in range(epochs):
        for index, value, y in rows:
            i, x = np.append(index, 1 << bits), np.append(value, 1.0)
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * worth[y] * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    return weights(np.arange((1 << bits) + 1)).astype(np.float32)


def held_out(id_col: str | Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text is a
    multiple of five. A null id counts as held out."""
    text = F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string")
    return F.coalesce(F.crc32(text.cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE_ROWS, bits: int = BITS, held: int = HELD) -> np.ndarray:
    """Learn the weights from a sample of at most `sample` labelled documents,
    those of the smallest hashes among ids that are not held out. A label that is
    neither 0 nor 1 is not used; of several labels of an id the smallest counts.
    Without labels every score is one half. The sample's vectors, `sample` at most but
    as long as their texts make them, are a table; the driver holds `held` bytes of
    them at most and streams them otherwise, with the same result."""
    usable = labels.filter(~held_out(id_col) & F.col(label_col).isin(0, 1))
    chosen = usable.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index, value = [], []
            for t in b.column(2):
                i, x = features(t.as_py() or "", bits)
                index.append(i.astype("<i4").tobytes())
                value.append(x.astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(index, pa.binary()), pa.array(value, pa.binary())], names=["id", "y", "i", "x"])

    kind = labels.schema[id_col].dataType.simpleString()
    # The sample has a bound of rows, so it may be broadcast: ids and labels only.
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id").select("id", "y", "text")
    made = texts.mapInArrow(run, f"id {kind}, y int, i binary, x binary")
    # Of repeated rows of an id one is used, which keeps the sample's bound.
    rows = Sample(written(made.groupBy("id").agg(F.min(F.struct("i", "x", "y")).alias("r")).select("id", "r.*"), "sample"), held)
    return train(rows, bits, max(EPOCHS, -(-UPDATES // max(len(rows), 1))))


def score_column(docs: DataFrame, weights: np.ndarray, text: Column, bits: int = BITS) -> Column:
    """The score of each whole text: the logistic of its sparse dot product. A null or
    empty text has no feature and gets the intercept's score; equal texts score
    alike. Only the text column is read, and an empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def score(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        w, out = shared.value, []
        for part in slices(texts, MOST_TEXT):
            for t in part:
                i, x = features(t, bits)
                out.append(float(w[i] @ x + w[-1]))
        return pd.Series(1 / (1 + np.exp(-np.clip(np.array(out, dtype=float), -35, 35))))

    return score.asNondeterministic()(text)
