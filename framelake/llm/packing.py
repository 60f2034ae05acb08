"""Best-fit packing of token sequences by bin completion (Korf, 2002).

Texts are tokenised where they are read; only (document, piece, length, checksum)
travels. Pieces of a whole sequence are sequences by themselves. The others are
dealt at random over groups of a bounded size, whose number grows with the table,
and each group is packed by branch and bound: the largest length left opens a
sequence, all its undominated fillings are enumerated with the least waste first,
one when it is asked for, and a branch ends where the waste so far exceeds what the
incumbent allows. The first incumbent is best-fit decreasing; every better solution
replaces it. A second search tries likely fillings first. A search stops at the
lower bound or after a documented number of nodes or of steps of the enumeration.

Equal lengths are interchangeable, so a group is a histogram of lengths and the
search never permutes equals.
"""

from __future__ import annotations

import base64
import bisect
import functools
import itertools
import json
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices, small_batches, written

LENGTH = 1024
END = 2
#: Pieces in a group: what one task packs at once. Each group may leave one
#: sequence unfilled, and each is searched twice, so larger groups waste less.
GROUP_PIECES = 1 << 14
MOST_TASKS = 20_000
#: Branches that the search of one group may open before its incumbent stands.
NODES = 4000
#: Steps of the enumeration of fillings, over all branches, before its incumbent stands.
STEPS = 1 << 18
#: Likely fillings that a branch of the second search tries before all others.
EARLY = 4


# --- tokens ---------------------------------------------------------------------


@functools.lru_cache(maxsize=4)
def encoder(vocabulary: str, ranks: str | None):
    """Texts to arrays of ids by the `tokenizers` file `vocabulary`.

    `ranks` may name the same vocabulary in rank form. Its ids are equal and come
    several times faster. The added tokens of `vocabulary` are no ranks: a text that
    holds one goes to `tokenizers`, as does a text that the rank form refuses.
    """
    from tokenizers import Tokenizer

    held: list[Tokenizer] = []

    def slow(text: str) -> np.ndarray:
        if not held:
            held.append(Tokenizer.from_file(vocabulary))
        return np.array(held[0].encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    if ranks is None:
        return slow
    import public_tokenizers
    import tiktoken

    with open(vocabulary, encoding="utf-8") as file:
        added = [t["content"] for t in json.load(file)["added_tokens"]]
    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(t in text for t in added):
            return slow(text)
        try:
            return np.array(fast.encode_ordinary(text), dtype=np.uint32)
        except BaseException as e:
            # The library's own failures: errors, or a panic, which is no Exception.
            if isinstance(e, (ValueError, RuntimeError)) or type(e).__name__ == "PanicException":
                return slow(text)
            raise

    return encode


def pieces(docs: DataFrame, vocabulary: str, ranks: str | None, id_col: str, text_col: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """One row per piece of a document: its ids and `end`, cut from the back so
    that only the first piece may be shorter than `length`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, ranks)
        for b in batches:
            at = 0
            for texts in slices(t.as_py() for t in b.column(1)):
                rows: list[int] = []
                piece: list[int] = []
                start: list[int] = []
                size: list[int] = []
                crc: list[int] = []
                for i, text in enumerate(texts):
                    ids = np.append(encode(text), np.uint32(end)).astype("<u4")
                    cuts = [0, *range((len(ids) - 1) % length + 1, len(ids) + 1, length)]
                    for p, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        rows.append(at + i)
                        piece.append(p)
                        start.append(s)
                        size.append(e - s)
                        crc.append(zlib.crc32(ids[s:e].tobytes()))
                at += len(texts)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())], names=["id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long")


# --- bin completion -------------------------------------------------------------


def best_fit(stock: Counter, room: int) -> list[list[int]]:
    """Best-fit decreasing over a histogram of lengths."""
    by_room: dict[int, list[list[int]]] = defaultdict(list)
    rooms = np.zeros(room + 1, dtype=bool)
    bins: list[list[int]] = []
    for size in sorted(stock, reverse=True):
        for _ in range(stock[size]):
            fit = int(np.argmax(rooms[size:])) + size
            if rooms[fit]:
                held = by_room[fit].pop()
                rooms[fit] = bool(by_room[fit])
            else:
                held, fit = [], room
                bins.append(held)
            held.append(size)
            by_room[fit - size].append(held)
            rooms[fit - size] = True
    return bins


def extend_sums(known: list[int], sizes: list[int], stock: list[int], room: int, least: int) -> None:
    """Extend `known`, sums of the smaller lengths, up to the j = `least` smallest.

    Bit t of known[j] says whether some of the j smallest of `sizes` (descending),
    as often as they are in stock, add up to t <= room.
    """
    every = (1 << room + 1) - 1
    n = len(sizes)
    for j in range(len(known), least + 1):
        sums, s = known[-1], sizes[n - j]
        if sums == every:
            known.extend([every] * (least + 1 - j))
            return
        if s <= room:
            most, unit = min(stock[n - j], room // s), 1
            while most:
                unit = min(unit, most)
                sums |= sums << s * unit
                most -= unit
                unit *= 2
            sums &= every
        known.append(sums)


def near(there: int, waste: int) -> int:
    """The set of t for which `there` has a member in t ... t + waste."""
    out, width = there, 1
    while width <= waste:
        step = min(width, waste + 1 - width)
        out |= out >> step
        width += step
    return out


def mirrored(sums: int, room: int) -> int:
    """The set of room - t for t in `sums`."""
    return int(f"{sums:0{room + 1}b}"[::-1], 2)


def fillings(
    sizes: list[int], stock: Sequence[int], room: int, known: list[int] | None = None, but: Sequence[tuple[int, ...]] = (), where: dict[int, int] | None = None
) -> Iterator[tuple[int, ...] | None]:
    """Every undominated filling of `room` from sizes (descending) with stock, once,
    `but` for those given: the least waste first, then the largest lengths. None
    marks a step without one.

    Subset sums over the histogram (`known`, by `extend_sums`) say exactly which
    sums the smaller lengths reach, so no start is followed that cannot end with
    the waste at hand. A filling is dominated (Martello and Toth: its lengths fit
    into another's) if and only if a length left out can stand for some of its
    lengths, whose sum is at most it and at least it less the waste. Lengths are
    chosen in falling order and such a length is longer than those it stands for,
    so a start that is dominated is known at once and not followed. The next length
    to take is read off a bit set: those in stock that leave a sum which lengths up to
    them reach. The search changes its stock and sums before it asks for the next
    filling: it gives copies, which are all that a branch holds.
    """
    n = len(sizes)
    top = bisect.bisect_left(sizes, -room, key=lambda s: -s)
    m, every = n - top, (1 << room + 1) - 1
    if known is None:
        known = [1]
        extend_sums(known, sizes, stock, room, m)
    if where is None:
        where = {s: k for k, s in enumerate(sizes)}
    there = sum(map((1).__lshift__, itertools.compress(sizes[top:], stock[top:])))
    back: dict[int, int] = {}
    totals = known[m] & every
    while totals:
        total = totals.bit_length() - 1
        totals ^= 1 << total
        waste = room - total
        # A level: the place of its length, how often it is taken at most, what is
        # left to fill; the lengths left out, the sums of any and of two or more chosen.
        levels = [(0, -1, total, there, 1, 0)]
        chosen: list[tuple[int, int]] = []
        while levels:
            k, often, left, out, some, more = levels.pop()
            del chosen[len(levels) :]
            if not left:
                # What is left out may not fit into the waste either.
                filling = tuple(s for s, c in chosen for _ in range(c))
                yield None if out & ((2 << waste) - 2) or filling in but else filling
                continue
            if often < 0:
                k = max(k, bisect.bisect_left(sizes, -left, lo=top, key=lambda s: -s) - top)
            # The next length, and how often, that leaves a sum which smaller ones reach.
            while often > 0 and not known[m - k - 1] >> left - often * sizes[top + k] & 1:
                often -= 1
            if often <= 0:
                if often == 0:
                    k += 1
                if k >= m:
                    continue
                if k not in back:
                    back[k] = mirrored(known[m - k] & every, room)
                able = there & (back[k] >> room - left) & ((2 << sizes[top + k]) - 1)
                while able:
                    s = able.bit_length() - 1
                    able ^= 1 << s
                    k = where[s] - top
                    often = min(stock[top + k], left // s)
                    while often > 0 and not known[m - k - 1] >> left - often * s & 1:
                        often -= 1
                    if often > 0:
                        break
                else:
                    continue
            s = sizes[top + k]
            levels.append((k, often - 1, left, out, some, more) if often > 1 else (k + 1, -1, left, out, some, more))
            chosen.append((s, often))
            if often == stock[top + k]:
                out ^= 1 << s
            for _ in range(often):
                more |= (some & -2) << s
                some |= some << s
            if more & near(out, waste) or waste and near(out >> 1, waste - 1) >> s & 1:
                yield None
            else:
                levels.append((k + 1, -1, left - often * s, out, some, more))


def likely(sizes: list[int], stock: list[int], room: int, where: dict[int, int], width: int = EARLY, tries: int = 24) -> list[tuple[int, ...]]:
    """A few fillings that often leave lengths which pack well: what a branch tries
    first in the second search, before all the others.

    A first length, of the largest that fit and of some spread over the rest, is
    followed by every length again and again that is the largest to fit; exact pairs
    join them. The least waste comes first, then the fewest and largest lengths.
    """
    top = bisect.bisect_left(sizes, -room, key=lambda s: -s)
    live = list(itertools.compress(sizes[top:], stock[top:]))
    if not live:
        return [()]
    rising = live[::-1]
    smallest = rising[0]
    found: dict[tuple[int, ...], int] = {}

    for first in dict.fromkeys([*live[:tries], *live[tries :: max(1, len(live) // tries)]]):
        used, left = [first], room - first
        while left >= smallest:
            k = bisect.bisect_right(rising, left) - 1
            while k >= 0 and rising[k] in used and used.count(rising[k]) >= stock[where[rising[k]]]:
                k -= 1
            if k < 0:
                break
            used.append(rising[k])
            left -= rising[k]
        used.sort(reverse=True)
        found.setdefault(tuple(used), left)
    pairs = (s for s in live if 2 * s >= room and room - s in where and stock[where[room - s]] > (room == 2 * s))
    for first in itertools.islice(pairs, width):
        found.setdefault((first, room - first), 0)
    kept: list[tuple[int, ...]] = []
    for f in sorted(sorted(found, reverse=True), key=lambda f: (found[f], len(f))):
        if not any(dominates(g, f) for g in kept):
            kept.append(f)
            if len(kept) == width:
                break
    return kept


def dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the lengths of b fit into those of a (first fit, so no false yes)."""
    rooms = list(a)
    for s in b:
        for i, r in enumerate(rooms):
            if s <= r:
                rooms[i] -= s
                break
        else:
            return False
    return True


def lower_bound(stock: Counter, room: int) -> int:
    """Martello and Toth's L2: lengths above half a bin need bins of their own,
    and for every k those above room - k take nothing of k or more."""
    count = np.zeros(room + 2, dtype=np.int64)
    for s, n in stock.items():
        count[s] += n
    number, total = np.cumsum(count), np.cumsum(count * np.arange(room + 2))
    half = room // 2
    best = -(-int(total[-1]) // room)
    for k in range(1, half + 1):
        alone = number[room] - number[room - k]
        large, large_sum = number[room - k] - number[half], total[room - k] - total[half]
        small_sum = total[half] - total[k - 1]
        best = max(best, int(alone + large + max(0, -(-(small_sum - (large * room - large_sum)) // room))))
    return best


def complete(stock: Counter, room: int, nodes: int = NODES, steps: int = STEPS) -> list[list[int]]:
    """Pack a histogram of lengths into as few bins of `room` as two searches find,
    which try the same fillings in different orders."""
    incumbent = best_fit(stock, room)
    bound = lower_bound(stock, room)
    for early in (False, True):
        if stock and len(incumbent) > bound:
            incumbent = search(stock, room, incumbent, bound, early, nodes, steps)
    return incumbent


def search(stock: Counter, room: int, incumbent: list[list[int]], bound: int, early: bool, nodes: int, steps: int) -> list[list[int]]:
    """Branch and bound from an incumbent; `early` tries likely fillings first."""
    total = sum(s * n for s, n in stock.items())
    sizes = sorted(stock, reverse=True)
    left = [stock[s] for s in sizes]
    where = {s: i for i, s in enumerate(sizes)}
    n, every = len(sizes), (1 << room + 1) - 1
    known = [1]
    #: One level per bin: the lengths chosen, the other fillings to try, the waste before it.
    path: list[tuple[int, tuple[int, ...], tuple[list[tuple[int, ...]], Iterator[tuple[int, ...] | None]], int]] = []
    waste = opened = 0
    steps += nodes + len(incumbent)

    def change(i: int, by: int) -> None:
        """Change the stock; forget the sums that this changes."""
        most, j = room // sizes[i], n - i
        if len(known) > j and known[j - 1] != every and min(left[i], most) != min(left[i] + by, most):
            del known[j:]
        left[i] += by

    def take(head: int, f: tuple[int, ...], by: int) -> None:
        change(head, by)
        for s in f:
            change(where[s], by)

    def following(first: list[tuple[int, ...]], rest: Iterator[tuple[int, ...] | None], most: int) -> tuple[int, ...] | None:
        """The next filling of at least the sum that the incumbent asks for."""
        nonlocal steps
        least = most - ((len(incumbent) - 1) * room - total - before)
        while first:
            f = first.pop(0)
            if sum(f) >= least:
                return f
        for f in rest:
            steps -= 1
            if f is not None:
                return f if sum(f) >= least else None
            if steps <= 0:
                break
        return None

    while True:
        lead = path[-1][0] if path else 0  # no length before the last head is left
        head = next((i for i in range(lead, n) if left[i]), None)
        options: tuple[list[tuple[int, ...]], Iterator[tuple[int, ...] | None]] = [], iter(())
        if head is None:  # a whole solution within the bound
            incumbent = [[sizes[h], *f] for h, f, _, _ in path]
            if len(incumbent) <= bound:
                return incumbent
        else:
            change(head, -1)
            gap = room - sizes[head]
            fit = n - bisect.bisect_left(sizes, -gap, key=lambda s: -s)
            extend_sums(known, sizes, left, room, fit)
            first = likely(sizes, left, gap, where) if early else []
            options = first, fillings(sizes, array("i", left), gap, known[: fit + 1], tuple(first), where)
            change(head, 1)
        opened += 1
        before = waste
        while True:
            f = following(*options, room - sizes[head]) if head is not None else None
            if f is not None:
                take(head, f, -1)
                path.append((head, f, options, before))
                waste = before + room - sizes[head] - sum(f)
                break
            if not path or opened > nodes + len(incumbent) or steps <= 0:
                return incumbent
            head, f, options, before = path.pop()
            take(head, f, 1)
    return incumbent


def pack(lengths: np.ndarray, room: int = LENGTH, nodes: int = NODES) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length."""
    waiting: dict[int, list[int]] = defaultdict(list)
    for i, s in enumerate(lengths.tolist()):
        waiting[s].append(i)
    bins = np.zeros(len(lengths), dtype=np.int64)
    offsets = np.zeros(len(lengths), dtype=np.int64)
    for b, sizes in enumerate(complete(Counter(lengths.tolist()), room, nodes)):
        at = 0
        for s in sizes:
            i = waiting[s].pop()
            bins[i], offsets[i] = b, at
            at += s
    return bins, offsets


def pack_documents(docs: DataFrame, vocabulary: str, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END, group: int = GROUP_PIECES, nodes: int = NODES) -> DataFrame:
    """Tokenise and pack every document.

    Returns one row per piece: id, piece, start, length, ids_crc32, sequence_id,
    offset. A null or empty text is the single token `end`. A document is cut only
    where it is longer than a sequence. Repeated rows and equal or null ids are
    packed as documents of their own. An empty table gives an empty result. Other
    columns are not read.
    """
    with small_batches(docs.sparkSession):
        cut = written(pieces(docs, vocabulary, ranks, id_col, text_col, length, end).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    whole = cut.filter(F.col("length") == length).select("id", "piece", "start", "length", "ids_crc32", (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    part = cut.filter(F.col("length") < length)
    groups = max(1, -(-part.count() // group))
    tasks = min(groups, MOST_TASKS)
    serial = 1 << 32

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid", ignore_index=True)
        bins, offsets = pack(pdf["length"].to_numpy(), length, nodes)
        return pd.DataFrame({"uid": pdf["uid"], "sequence_id": pdf["deal"].to_numpy(dtype=np.int64) * serial + bins, "offset": offsets})

    dealt = part.select(F.pmod(F.xxhash64("uid"), F.lit(groups)).alias("deal"), "uid", "length")
    # A group is little data and much work: groups get tasks of their own, which
    # adaptive execution would otherwise merge by their bytes.
    placed = dealt.repartition(tasks, "deal").groupBy("deal").applyInPandas(run, "uid long, sequence_id long, offset long")
    rest = part.join(placed, "uid").select("id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    return whole.unionByName(rest)
