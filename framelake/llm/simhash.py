"""SimHash near-duplicates: exact tiled comparison of 64-bit fingerprints with
numpy exclusive-or and bit counts, skipping tile pairs whose population counts
differ by more than the radius.

How tiles are dealt. A grid of tiles over all fingerprints would grow with the
square of the table, so tiles are cut inside buckets: the 64 bits are divided
into m blocks and, of two fingerprints within radius r, at least m - r blocks are
equal (pigeonhole), so each choice of m - r blocks deals the fingerprints into
buckets and no pair within the radius is missed. m follows the number of distinct
fingerprints, so that a bucket of unrelated ones stays at a tile or so; every m
gives the same links. Rows are range-partitioned by (bucket, population count,
fingerprint), which splits a large bucket over tasks, and cut into tiles of at
most TILE fingerprints. A tile is compared with itself where it is cut; tiles of
one bucket that may hold links between them meet in a join of tiles, never of
rows, on condition that their population counts come within the radius.

Only a star of the links of a tile pair leaves a task: n - 1 links for n connected
fingerprints, not n squared. Components follow by alternating
large-star and small-star steps (Kiveris et al., 2014) over written tables.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, encoded, salt, salt_bit, salt_of, salts, small_batches, written

SHINGLE = 4
RADIUS = 4
SEED = 42
TILE = 2048


# --- fingerprints ---------------------------------------------------------------


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit SimHash of a whole text; zero for a text without words."""
    words = encoded(text).lower().split()  # bytes: A-Z only, and the six ASCII spaces
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)), dtype=np.uint64, count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):  # bounded memory for a text of any length
        part = hashes[at : at + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE, uid: str | None = None) -> DataFrame:
    """(id, uid, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py() or "", shingle) for t in b.column(2)), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], names=["id", "uid", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), (F.col(uid) if uid else F.monotonically_increasing_id()).alias("uid"), F.col(text_col).cast("string").alias("text"))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("id", "uid")]
    return rows.mapInArrow(run, f"id {kinds[0]}, uid {kinds[1]}, fp long")


# --- links ----------------------------------------------------------------------


def blocks_for(n: int, radius: int, most: int = 2048) -> int:
    """The number m of blocks: the least for which a bucket of n even
    fingerprints holds at most `most`; past m = radius + 6 keys stop widening."""
    for m in range(radius + 1, radius + 7):
        if n / 2 ** (64 * (m - radius) // m) <= most:
            return m
    return radius + 6


def block_masks(m: int, radius: int) -> list[int]:
    """One 64-bit mask for each choice of m - radius of m blocks."""
    edges = [64 * i // m for i in range(m + 1)]
    blocks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(m)]
    return [sum(c) for c in itertools.combinations(blocks, m - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def tile_links(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links (from, to) that connect what the pairs of a x b within the radius connect:
    from each fingerprint to the smallest that it is connected with, so that stars
    have little to do afterwards."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    step = max(1, (1 << 20) // max(len(b), 1))
    for at in range(0, len(a), step):
        near = np.bitwise_count(a[at : at + step, None] ^ b[None, :]) <= radius
        i, j = np.nonzero(near)
        i += at
        if same:
            keep = i < j
            i, j = i[keep], j[keep]
        for x, y in zip(a[i].tolist(), b[j].tolist(), strict=True):
            p, q = root(x), root(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
    pairs = np.array([(x, root(x)) for x in list(parent)], dtype=np.uint64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


_TILES = "kind int, mask int, bucket long, tile long, lo int, hi int, prints binary, a long, b long"
_NAMES = ["kind", "mask", "bucket", "tile", "lo", "hi", "prints", "a", "b"]
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)


def cut_tiles(radius: int, size: int):
    """Sorted (mask, bucket, pop, fp) rows of a partition to tiles and links.

    Kind 1 rows are links inside a tile. Kind 0 rows are tiles that may have
    partners elsewhere: of a bucket with several tiles, or one that touches the
    partition's first or last row and so may go on in another partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        serial, key, held, several, first = 0, None, [], False, True
        carried: list[tuple] = []

        def close(whole: bool, more: bool) -> None:
            """End the held rows as a tile; more: the bucket goes on."""
            nonlocal serial, several
            rows = np.concatenate(held)
            links = tile_links(rows, rows, radius, same=True) if len(rows) > 1 else ((), ())
            carried.extend((1, None, None, None, None, None, None, _signed(int(x)), _signed(int(y))) for x, y in zip(*links, strict=True))
            if several or more or not whole:
                pops = np.bitwise_count(rows)
                carried.append((0, key[0], key[1], part + serial, int(pops.min()), int(pops.max()), rows.astype("<u8").tobytes(), None, None))
                serial += 1
            several = more

        for b in batches:
            mask, bucket = b.column(0).to_numpy(), b.column(1).to_numpy()
            fps = b.column(3).to_numpy().view(np.uint64)
            cuts = np.flatnonzero((mask[1:] != mask[:-1]) | (bucket[1:] != bucket[:-1])) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fps)], strict=True):
                if s == e:
                    continue
                now = (int(mask[s]), int(bucket[s]))
                if now != key:
                    if held:
                        close(whole=not first, more=False)
                        first = False
                    key, held, several = now, [], False
                while s < e:
                    room = size - sum(map(len, held))
                    if not room:
                        close(whole=not first, more=True)
                        held, room = [], size
                    held.append(fps[s : min(e, s + room)])
                    s = min(e, s + room)
            if len(carried) >= 1024:
                yield _batch(carried)
                carried.clear()
        if held:
            close(whole=False, more=False)
        yield _batch(carried)

    return run


def cross_tiles(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y in zip(b.column(0), b.column(1), strict=True):
                p, q = tile_links(np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8"), radius, same=False)
                yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.uint64).view(np.int64)), pa.array(q.astype(np.uint64).view(np.int64))], names=["a", "b"])

    return run


def links(distinct: DataFrame, n: int, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` that connect exactly the
    fingerprints which chains of pairs within the radius connect."""
    masks = block_masks(blocks_for(n, radius), radius)
    choices = F.array(*[F.lit(_signed(m)) for m in masks])
    keyed = distinct.select("fp", F.bit_count("fp").alias("pop"), F.posexplode(choices).alias("mask", "bits"))
    keyed = keyed.select("mask", F.col("fp").bitwiseAND(F.col("bits")).alias("bucket"), "pop", "fp")
    parts = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * len(masks) // 2_000_000))
    order = ["mask", "bucket", "pop", "fp"]
    cut = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(cut_tiles(radius, tile), _TILES)
    cut = written(cut, "tiles")
    tiles = cut.filter("kind = 0").select("mask", "bucket", "tile", "lo", "hi", "prints")
    x, y = tiles.alias("x"), tiles.alias("y")
    close = (F.col("x.lo") <= F.col("y.hi") + radius) & (F.col("y.lo") <= F.col("x.hi") + radius)
    pairs = x.join(y, (F.col("x.mask") == F.col("y.mask")) & (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.tile") < F.col("y.tile")) & close)
    across = pairs.select(F.col("x.prints").alias("p"), F.col("y.prints").alias("q")).mapInArrow(cross_tiles(radius), "a long, b long")
    return cut.filter("kind = 1").select("a", "b").unionByName(across)


# --- components -----------------------------------------------------------------


def stars(e: DataFrame) -> bool:
    """Whether links (u, v), v below u, are stars: no node has two links to smaller
    ones, none has such a link and is another's smaller node. Each v is then the
    smallest of its component, and a further round would change nothing."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above"))
    ends = ends.unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    return ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).filter("below + above > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge table (a, b): root is the smallest
    node of its component.

    Large-star gives every larger neighbour of a node its smallest neighbour,
    small-star does so for smaller neighbours, until only stars are left. Both are a
    minimum per node, partially aggregated, and an equi-join; the centre of a star is
    one key of all its links there, so the minima are repeated by the links' salts
    and the links spread. No neighbour list is gathered.
    """
    big = lambda e: e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = written(big(edges).filter("u <> v").distinct(), "edges")
    while not stars(e):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Only links to larger nodes ask for a minimum: theirs are the salts that count.
        least = both.groupBy("u").agg(F.min("v").alias("v"), F.bit_or(F.when(F.col("v") > F.col("u"), salt_of("v")).otherwise(0)).alias("bits"))
        least = least.select("u", F.least("u", "v").alias("m"), F.explode(salts("bits")).alias("salt"))
        # Large-star: (v, m) for neighbours v above u; u's own smallest link is kept with it.
        up = e.select(F.col("v").alias("u"), F.col("u").alias("v"), salt("u").alias("salt"))
        e1 = up.join(least, ["u", "salt"]).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small-star over links to smaller neighbours.
        down = e1.groupBy("u").agg(F.min("v").alias("m"), salt_bit("v").alias("bits"))
        spread = down.select("u", "m", F.explode(salts("bits")).alias("salt"))
        hung = e1.withColumn("salt", salt("v")).join(spread, ["u", "salt"]).select("v", "m")
        e2 = hung.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        e, done = written(e2.distinct(), "edges"), e
        discard(done)
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


# --- the operator ---------------------------------------------------------------


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", uid: str | None = None, shingle: int = SHINGLE, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Fingerprint every document and join those that chains of links connect.

    Returns one row per input row: id, uid, fp (signed long), component_id (the
    smallest id of its component; a null id counts only where no other is there),
    keep_uid (the row that a deduplication keeps: smallest id, null last, then
    place) and component_size. A null or empty text has fingerprint zero and is
    linked like any other; a text below `shingle` words is one shingle; repeated
    rows share their fingerprint. An empty table gives an empty result. Other
    columns are not read.
    """
    with small_batches(docs.sparkSession):
        rows = written(fingerprints(docs, id_col, text_col, shingle, uid), "prints")
    best = F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("uid"))
    distinct = written(rows.groupBy("fp").agg(F.min(best).alias("best"), F.count("*").alias("n"), salt_bit("uid").alias("copies")), "distinct")
    with small_batches(docs.sparkSession):  # a pair of tiles is 32 KB
        found = components(links(distinct.select("fp"), distinct.count(), radius, tile))
    members = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "best", "n", "copies")
    members = written(members, "members")
    # A component of many fingerprints is one key of them all: what is settled for it
    # is repeated by its members' salts.
    settled = members.groupBy("root").agg(F.min("best").alias("best"), F.sum("n").alias("size"), salt_bit("fp").alias("bits"))
    settled = settled.select("root", "best", "size", F.explode(salts("bits")).alias("salt"))
    by_print = members.select("fp", "root", "copies", salt("fp").alias("salt")).join(settled, ["root", "salt"])
    # So is what is settled for a fingerprint, by the salts of the rows that share it.
    by_print = by_print.select("fp", F.col("best.id").alias("component_id"), F.col("best.uid").alias("keep_uid"), F.col("size").alias("component_size"), F.explode(salts("copies")).alias("salt"))
    return rows.withColumn("salt", salt("uid")).join(by_print, ["fp", "salt"]).select("id", "uid", "fp", "component_id", "keep_uid", "component_size")
