"""Exact duplicates: a static binary-fuse filter per immutable snapshot screens
incoming digests, positives meet the snapshot in exact buckets with a byte check,
and duplicates inside the new batch are grouped on their own.

Data flow. A scan reduces every row to (digest, code points, id); texts stay
behind. A snapshot's distinct digests are dealt over shards and each shard
becomes one filter of 8-bit fingerprints, about 9 bits a digest. The batch's
distinct digests are dealt the same way, and each shard of digests is probed
against its filters (a cogroup: filters are never broadcast, they grow with
the snapshots). Only digests that pass meet the snapshots' rows, and the texts of
the digests that match are compared byte by byte.

Hot keys: copies collapse into one row per digest by partial aggregation before
any shuffle; the join that hands the decision back to every row is a plain
equi-join which adaptive execution splits.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, text_of, written

#: Digests in a shard, and so keys in one filter (about 0.3 MB); a size for
#: tasks, not a cap: there are as many shards as the snapshot needs.
SHARD_KEYS = 1 << 18
LEAST_SHARDS = 48
#: Matched digests up to which they are broadcast (about 20 MB); beyond, a join.
BROADCAST_DIGESTS = 1 << 18


# --- the filter -----------------------------------------------------------------


@dataclass
class BinaryFuse:
    """A static 3-wise binary fuse filter with 8-bit fingerprints (Graf and
    Lemire, 2022): no false negatives, about 1/256 false positives."""

    seed: int
    segment: int
    segments: int
    prints: np.ndarray

    @staticmethod
    def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
        h = keys + np.uint64(seed)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))

    @classmethod
    def _places(cls, h: np.ndarray, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
        """The three slots of each key, in consecutive segments, and its print."""
        first = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
        mask = np.uint64(segment - 1)
        inner = (h & mask, (h >> np.uint64(18)) & mask, (h >> np.uint64(36)) & mask)
        slots = np.stack([((first + np.uint64(i)) * np.uint64(segment) + inner[i]).astype(np.int64) for i in range(3)])
        return slots, ((h ^ (h >> np.uint64(32))) & np.uint64(255)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse:
        keys = np.unique(keys.astype(np.uint64))
        n = len(keys)
        segment = 1 << max(2, min(18, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
        factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 3)))
        segments = max(1, math.ceil(n * factor / segment) - 2)
        for attempt in range(1, 1000):
            if attempt % 10 == 0:  # a rare unlucky set gets more room
                segments += 1 + segments // 8
            seed = attempt * 0x9E3779B97F4A7C15 & (1 << 64) - 1
            slots, prints = cls._places(cls._mix(keys, seed), segment, segments)
            rounds = cls._peel(slots, (segments + 2) * segment)
            if rounds is not None:
                break
        else:
            raise RuntimeError("no seed peels these keys")
        table = np.zeros((segments + 2) * segment, dtype=np.uint8)
        for keyed, slot in reversed(rounds):
            a, b, c = (table[slots[i, keyed]] for i in range(3))
            table[slot] = prints[keyed] ^ a ^ b ^ c  # the own slot is still zero
        return cls(seed, segment, segments, table)

    @staticmethod
    def _peel(slots: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Rounds of (keys, the slot that only this key still uses)."""
        n = slots.shape[1]
        count = np.zeros(size, dtype=np.int32)
        held = np.zeros(size, dtype=np.int64)
        index = np.arange(n, dtype=np.int64)
        for row in slots:
            np.add.at(count, row, 1)
            np.bitwise_xor.at(held, row, index)
        rounds, left = [], n
        alone = np.flatnonzero(count == 1)
        while len(alone):
            keyed, where = np.unique(held[alone], return_index=True)
            rounds.append((keyed, alone[where]))
            left -= len(keyed)
            for row in slots:
                np.subtract.at(count, row[keyed], 1)
                np.bitwise_xor.at(held, row[keyed], keyed)
            touched = np.unique(slots[:, keyed])
            alone = touched[count[touched] == 1]
        return rounds if left == 0 else None

    def probe(self, keys: np.ndarray) -> np.ndarray:
        slots, prints = self._places(self._mix(keys.astype(np.uint64), self.seed), self.segment, self.segments)
        return (self.prints[slots[0]] ^ self.prints[slots[1]] ^ self.prints[slots[2]]) == prints


# --- the operator ---------------------------------------------------------------


def normalised(text: Column) -> Column:
    """The text without space, tab, line feed, vertical tab, form feed, return."""
    return F.translate(text, SPACE, "")


def digests(docs: DataFrame, snapshot: Column, id_col: str, text_col: str, uid: str | None) -> DataFrame:
    """One row per document: id, uid (its place in the scan unless a column is
    named), the snapshot that holds it (null: the new batch), digest, and rank (the
    negative number of code points)."""
    text = text_of(text_col)
    return docs.select(
        F.col(id_col).alias("id"),
        (F.col(uid) if uid else F.monotonically_increasing_id()).alias("uid"),
        snapshot.cast("long").alias("snapshot"),
        F.unhex(F.sha2(normalised(text).cast("binary"), 256)).alias("digest"),
        (-F.length(text)).cast("long").alias("rank"),
    )


def _best() -> Column:
    """Orders the documents of a group: most code points, then smallest id with a
    null id last, then a repeated row's place."""
    return F.struct(F.col("rank"), F.col("id").isNull().alias("no_id"), F.col("id"), F.col("uid"))


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.count("*").alias("n"), F.min(_best()).alias("best"))


def _shard(shards: int) -> Column:
    return F.pmod(F.hash("digest"), F.lit(shards)).alias("shard")


def snapshot_filters(held: DataFrame, shards: int) -> DataFrame:
    """One filter per snapshot and shard of its digests; a snapshot never changes, so
    its filters can be kept."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        f = BinaryFuse.build(pdf["key"].to_numpy(dtype=np.int64).view(np.uint64))
        return pd.DataFrame({"snapshot": pdf["snapshot"].iloc[:1], "shard": pdf["shard"].iloc[:1], "seed": [str(f.seed)], "segment": [f.segment], "segments": [f.segments], "prints": [f.prints.tobytes()]})

    keyed = held.select("snapshot", "digest").distinct().select("snapshot", _shard(shards), F.xxhash64("digest").alias("key"))
    return keyed.groupBy("snapshot", "shard").applyInPandas(build, "snapshot long, shard int, seed string, segment int, segments int, prints binary")


def screened(groups: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The batch's digests with `maybe`: whether any snapshot's filter lets them pass."""

    def probe(batch: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        maybe = np.zeros(len(batch), dtype=bool)
        keys = batch["key"].to_numpy(dtype=np.int64).view(np.uint64)
        for row in found.itertuples():
            maybe |= BinaryFuse(int(row.seed), int(row.segment), int(row.segments), np.frombuffer(row.prints, dtype=np.uint8)).probe(keys)
        return pd.DataFrame({"digest": batch["digest"], "maybe": maybe})

    keyed = groups.select(_shard(shards), F.xxhash64("digest").alias("key"), "digest")
    return keyed.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(probe, "digest binary, maybe boolean")


def exact_dedup(docs: DataFrame, snapshot: Column, id_col: str = "doc_id", text_col: str = "text", uid: str | None = None) -> DataFrame:
    """Screen the new rows against those in snapshots and settle every group of equal
    texts. `snapshot` numbers the snapshot that holds a row and is null for new ones.

    Returns one row per input row: id, uid, digest (binary), keep_id, keep_uid,
    group_size, kept. Rows are equal when their texts are, white space apart. A
    null or empty text equals every other text without a word. A repeated row is
    one more member of its group and exactly one row of a group is kept. An empty
    table gives an empty result. Two different texts under one SHA-256 digest fail
    the job in the byte check. Other columns of docs are not read.
    """
    rows = written(digests(docs, snapshot, id_col, text_col, uid), "digests")
    held, new = rows.filter("snapshot IS NOT NULL"), _groups(rows.filter("snapshot IS NULL"))
    old = written(_groups(held), "snapshots")
    shards = max(LEAST_SHARDS, -(-old.count() // SHARD_KEYS))
    passed = screened(new, snapshot_filters(held, shards), shards).filter("maybe").select("digest")

    met = written(passed.join(old.select("digest"), "digest"), "met")
    texts = docs.select(normalised(text_of(text_col)).alias("norm")).select(F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("digest"), "norm")
    # Few digests matched: a broadcast of checked size picks their texts in the scan.
    # Else every task first reduces its texts to one row a digest. Either way a group
    # of copies of any size is a few rows where its bytes are compared.
    few = met.count() <= BROADCAST_DIGESTS
    picked = texts.join(F.broadcast(met), "digest", "left_semi") if few else texts
    bounds = picked.groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
    checked = (bounds if few else bounds.join(met, "digest", "left_semi")).select("digest", (F.col("low") == F.col("high")).alias("same"))
    checked = checked.select("digest", F.when(F.col("same"), True).otherwise(F.raise_error(F.lit("different texts share a digest"))).alias("both"))

    # A digest of the batch that met no snapshot row is a group of the batch alone.
    fresh = new.join(met, "digest", "left_anti")
    joined = new.join(checked.filter("both"), "digest", "left_semi")
    settled = old.unionByName(joined).groupBy("digest").agg(F.sum("n").alias("n"), F.min("best").alias("best")).unionByName(fresh)
    # Written, so that both sides of the join are plain exchanges, which adaptive
    # execution can split where a group of copies is large.
    out = rows.join(written(settled, "settled"), "digest")
    return out.select(
        "id", "uid", "digest",
        F.col("best.id").alias("keep_id"), F.col("best.uid").alias("keep_uid"),
        F.col("n").alias("group_size"), (F.col("best.uid") == F.col("uid")).alias("kept"),
    )


def standing(id_col: Column, snapshots: int = 3) -> Column:
    """A standing rule for which rows of one table play the snapshots: even ids, dealt
    over them; the rest, null ids too, come in as the new batch. All rows are settled
    either way."""
    return F.when(F.pmod(id_col, F.lit(2)) == 0, F.pmod(F.shiftright(id_col, 1), F.lit(snapshots)))
