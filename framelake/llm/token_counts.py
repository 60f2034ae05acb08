"""Token counts by a linear longest-match automaton (Song et al., 2021).

A vocabulary of word-initial and continuing pieces becomes a trie over bytes with
failure links. Where the greedy longest match must give up a path, the link leads
to the state after the pieces that it then emits, and each state stores how many
pieces that is. So a word is counted in one walk over its bytes, without a piece
being built or a byte being read twice.

One pass over the rows, no shuffle; the automaton is built once in each worker
and its size is that of the vocabulary.
"""

from __future__ import annotations

import functools
import json
from collections import deque
from collections.abc import Collection, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import encoded

#: Words whose counts a worker remembers; the memory starts anew when it is full.
REMEMBERED = 1 << 18
#: A longer word is counted but not remembered.
SHORT = 64


class LongestMatch:
    """Greedy longest-match counts of a word's pieces.

    `initial` pieces may begin a word and `inner` ones continue it. An empty initial
    piece is the mark of a word's begin as a piece of its own: it is taken where no
    other initial piece fits. A word that cannot be cut is unknown.
    """

    def __init__(self, initial: Collection[bytes], inner: Iterable[bytes]) -> None:
        self.edges: list[dict[int, int]] = [{}, {}]  # 0: a word's begin, 1: inside a word
        whole = [False, False]
        for root, pieces in ((0, initial), (1, inner)):
            for piece in pieces:
                at = root
                for byte in piece:
                    nxt = self.edges[at].get(byte)
                    if nxt is None:
                        nxt = self.edges[at][byte] = len(self.edges)
                        self.edges.append({})
                        whole.append(False)
                    at = nxt
                whole[at] = whole[at] or at > 1
        self.link = [-1] * len(self.edges)
        self.pops = [0] * len(self.edges)
        if b"" in initial:
            self.link[0], self.pops[0] = 1, 1
        queue = deque((0, 1))
        while queue:
            at = queue.popleft()
            for byte, nxt in self.edges[at].items():
                if whole[nxt]:
                    self.link[nxt], self.pops[nxt] = 1, 1
                else:
                    back, pops = self.link[at], self.pops[at]
                    while back >= 0 and byte not in self.edges[back]:
                        pops += self.pops[back]
                        back = self.link[back]
                    if back >= 0:
                        self.link[nxt], self.pops[nxt] = self.edges[back][byte], pops
                queue.append(nxt)

    def count(self, word: bytes) -> int:
        """The number of pieces; -1 if the word cannot be cut."""
        edges, link, pops = self.edges, self.link, self.pops
        at = total = 0
        for byte in word:
            nxt = edges[at].get(byte)
            while nxt is None:
                total += pops[at]
                at = link[at]
                if at < 0:
                    return -1
                nxt = edges[at].get(byte)
            at = nxt
        while at > 1:  # the empty word has no piece
            total += pops[at]
            at = link[at]
            if at < 0:
                return -1
        return total


def byte_level_pieces(path: str) -> tuple[list[bytes], list[bytes]]:
    """Word-initial and continuing pieces of a byte-level vocabulary file: what
    follows a space begins a word, what has no white space continues one. The space
    alone, a piece too, is the empty initial piece, so a word of any bytes is cut."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    pieces = [bytes(byte_of[c] for c in p) for p in vocabulary if all(c in byte_of for c in p)]
    initial = [p[1:] for p in pieces if p == b" " or p[:1] == b" " and len(p[1:].split()) == 1 and p[1:].strip() == p[1:]]
    inner = [p for p in pieces if len(p.split()) == 1 and p.strip() == p]
    return initial, inner


@functools.lru_cache(maxsize=2)
def automaton(path: str) -> LongestMatch:
    return LongestMatch(*byte_level_pieces(path))


def counted(text: str, auto: LongestMatch, memory: dict[bytes, int]) -> tuple[int, int, int]:
    """(words, tokens, unknown words) of a whole text."""
    words = encoded(text).split()
    tokens = unknown = 0
    for w in words:
        n = memory.get(w)
        if n is None:
            n = auto.count(w)
            if len(w) <= SHORT:
                if len(memory) >= REMEMBERED:
                    memory.clear()
                memory[w] = n
        if n < 0:
            unknown += 1
            n = 1
        tokens += n
    return len(words), tokens, unknown


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Count the tokens of every document.

    Returns one row per input row: id, n_words, n_tokens (a word that the vocabulary
    cannot cut is one token) and n_unknown, the number of such words; a byte-level
    vocabulary cuts every word, spaced or not. Words stand between ASCII white space. A null or empty text
    counts nothing; repeated rows count alike. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, memory = automaton(vocabulary), {}
        for b in batches:
            rows = [counted(t.as_py() or "", auto, memory) for t in b.column(1)]
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["id", "n_words", "n_tokens", "n_unknown"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_words long, n_tokens long, n_unknown long")
