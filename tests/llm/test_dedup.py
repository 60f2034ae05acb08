import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from framelake.llm import exact_dedup as E
from framelake.llm import simhash as S

from .helpers import components, docs, rows, sentence


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 60_000])
def test_binary_fuse_has_no_false_negative_and_few_false_positives(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    f = E.BinaryFuse.build(keys)
    assert f.probe(keys).all()
    other = rng.integers(0, 1 << 63, 50_000, dtype=np.uint64)
    assert f.probe(other).mean() < 0.008
    if n >= 60_000:
        assert len(f.prints) / n < 1.3


def test_a_filter_takes_repeated_keys():
    f = E.BinaryFuse.build(np.array([5, 5, 5, 9], dtype=np.uint64))
    assert f.probe(np.array([5, 9], dtype=np.uint64)).all()


def _brute_exact(data):
    groups = defaultdict(list)
    for place, r in enumerate(data):
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append((-len(r[1] or ""), r[0] is None, r[0] or 0, place))
    out = []
    for norm, members in groups.items():
        best = min(members)
        for m in members:
            out.append((None if m[1] else m[2], None if best[1] else best[2], len(members), hashlib.sha256(norm.encode()).hexdigest()))
    return out, len(groups)


@pytest.mark.parametrize("split", ["even", "none", "all", "one", "many"])
def test_exact_dedup_against_brute_force(spark, split, monkeypatch):
    if split == "many":  # the way beyond the broadcast's bound
        monkeypatch.setattr(E, "BROADCAST_DIGESTS", 0)
        split = "even"
    data = rows()
    rule = {"even": E.standing(F.col("doc_id")), "none": F.lit(None), "all": F.lit(1), "one": F.when(F.col("doc_id") < 30, 7)}[split]
    got = E.exact_dedup(docs(spark), rule).collect()
    want, groups = _brute_exact(data)
    key = lambda t: tuple((v is None, v if v is not None else 0) for v in t)
    assert sorted([(r.id, r.keep_id, r.group_size, bytes(r.digest).hex()) for r in got], key=key) == sorted(want, key=key)
    assert sum(r.kept for r in got) == groups


def test_exact_dedup_of_an_empty_table(spark):
    assert E.exact_dedup(docs(spark, []), E.standing(F.col("doc_id"))).count() == 0


def _brute_print(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", None, "A", "a B", "a b c d", "The quick  brown\tfox\njumps ÄÖ over", "x " * 500, "É\xa0b c\x0bd e f g"])
def test_fingerprint(text):
    assert S.fingerprint(text or "") == _brute_print(text)


def test_block_masks_find_every_pair():
    rng = random.Random(1)
    for m in (5, 6, 7):
        masks = S.block_masks(m, 4)
        for _ in range(200):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), rng.randint(0, 4)):
                b ^= 1 << bit
            assert any(a & k == b & k for k in masks)


def _near_data():
    rng = random.Random(3)
    data = rows(1, 40)
    base = [sentence(rng, 300).split() for _ in range(6)]
    i = 1000
    for words in base:
        for _ in range(12):
            w = list(words)
            w[rng.randrange(len(w))] = "changed"
            words = w if rng.random() < 0.7 else words  # chains drift away from their start
            data.append((i, " ".join(w), "en", "s", 0, *["x"] * 9))
            i += 1
    return data


@pytest.mark.parametrize(("tile", "n"), [(2048, None), (4, None), (3, 10**8)])
def test_near_duplicates_against_brute_force(spark, tile, n, monkeypatch):
    data = _near_data()
    if n:
        real = S.blocks_for
        monkeypatch.setattr(S, "blocks_for", lambda _n, radius: real(n, radius))
    got = S.near_duplicates(docs(spark, data).repartition(3), tile=tile).collect()
    prints = [_brute_print(r[1]) for r in data]
    roots = components(len(data), [(i, j) for i in range(len(data)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    ids = defaultdict(list)
    for k, r in enumerate(data):
        ids[roots[k]].append(r[0])
    least = {k: min((v for v in m if v is not None), default=None) for k, m in ids.items()}
    want = sorted((-1 if r[0] is None else r[0], prints[k], least[roots[k]], len(ids[roots[k]])) for k, r in enumerate(data))
    assert sorted((-1 if r.id is None else r.id, r.fp & (1 << 64) - 1, r.component_id, r.component_size) for r in got) == want
    assert len({r.keep_uid for r in got}) == len(ids)


def test_near_duplicates_of_an_empty_table(spark):
    assert S.near_duplicates(docs(spark, [])).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, k) for k in range(1001, 1100)] + [(-5, -9)]
    got = {r.node: r.root for r in S.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0}
    assert {got[k] for k in range(1000, 1100)} == {1000}
    assert got[-5] == got[-9] == -9


def test_tile_links_are_stars():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, base[rng.integers(0, 12, 300)] ^ (np.uint64(1) << rng.integers(0, 10, 300, dtype=np.uint64))]))
    for a, b, same in ((fps, fps, True), (fps[::2], fps[1::2], False)):
        both = a.tolist() if same else [*a.tolist(), *b.tolist()]
        pairs = [(i, j) for i, x in enumerate(both) for j, y in enumerate(both) if i < j and (x ^ y).bit_count() <= 3 and (same or (i < len(a)) != (j < len(a)))]
        groups = defaultdict(list)
        for x, c in zip(both, components(len(both), pairs), strict=True):
            groups[c].append(x)
        u, v = S.tile_links(a, b, 3, same)
        assert sorted(zip(u.tolist(), v.tolist(), strict=True)) == sorted((x, min(g)) for g in groups.values() for x in g if x != min(g))


def test_stars_are_known(spark):
    known = lambda links: S.stars(spark.createDataFrame(links, "u long, v long"))
    assert known([]) and known([(2, 1)]) and known([(5, 1), (4, 1), (9, 7)])
    assert not known([(3, 2), (2, 1)])  # a chain
    assert not known([(3, 2), (3, 1)])  # two smaller nodes


def test_components_of_stars_are_written_once(spark, monkeypatch):
    tags = []
    monkeypatch.setattr(S, "written", lambda df, tag, f=S.written: tags.append(tag) or f(df, tag))
    edges = [(k, 100) for k in range(101, 140)] + [(k, 100) for k in range(120, 160)] + [(8, 7)]
    got = {r.node: r.root for r in S.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(100, 160)} | {7: 7, 8: 7}
    assert tags == ["edges"]


def test_near_duplicates_take_small_batches(spark, monkeypatch):
    from framelake.llm.shared import BATCH_ROWS, BATCHES

    rows_at = {}

    def watched(df, tag, f=S.written):
        rows_at.setdefault(tag, [int(spark.conf.get(b)) for b in BATCHES])
        return f(df, tag)

    monkeypatch.setattr(S, "written", watched)
    assert S.near_duplicates(docs(spark)).count() == len(rows())
    assert rows_at["prints"] == rows_at["tiles"] == rows_at["edges"] == [BATCH_ROWS] * 2
    assert all(spark.conf.get(b, None) is None for b in BATCHES)


def test_places_do_not_follow_the_splits(spark, small):
    from framelake.llm.shared import place, table

    docs = table(spark, small, "documents")
    name = "spark.sql.files.maxPartitionBytes"
    seen = []
    for size in ("128m", "20k"):
        spark.conf.set(name, size)
        d = table(spark, small, "documents")
        seen.append({r.doc_id: tuple(r.p) for r in d.select("doc_id", place(d).alias("p")).collect()})
    spark.conf.unset(name)
    assert seen[0] == seen[1] and len(set(seen[0].values())) == docs.count()
    assert spark.range(5).select(place(spark.range(5)).alias("p")).distinct().count() == 5
