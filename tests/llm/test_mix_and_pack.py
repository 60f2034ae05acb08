import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from framelake.llm import mixing as M
from framelake.llm import packing as P
from framelake.llm import sql as SQL
from framelake.llm.queries import vocabulary

from .helpers import docs, rows


def _size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def _targets(sizes, weights=(5, 2, 1), repeats=3):
    """The contract's own procedure: share, stop, share the excess again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > repeats * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = repeats * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mix_meets_its_targets(spark):
    data = rows(2, 80)
    got = M.mix(docs(spark, data)).collect()
    assert len(got) == len(data)
    sizes = Counter()
    for r in data:
        sizes[r[3]] += _size(r[1])
    want = _targets(dict(sizes))
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(2 * M.BLOCK, 0.01 * t)
    again = M.mix(docs(spark, data).repartition(5)).collect()
    total = lambda rs: sorted(((-1 if r.id is None else r.id), r.taken) for r in rs)
    assert total(again) == total(got)


def test_a_small_source_of_many_shards_meets_its_target(spark, monkeypatch):
    monkeypatch.setattr(M, "SHARD_DOCS", 4)
    rng = random.Random(11)
    # "a" has weight 5 and so few words that its target is three times its size.
    data = [(i, " ".join(["w"] * rng.randint(1, 10)), "en", "a", 0, *["x"] * 9) for i in range(100)]
    data += [(1000 + i, " ".join(["w"] * 40), "en", "b", 0, *["x"] * 9) for i in range(400)]
    got = M.mix(docs(spark, data)).collect()
    taken, target = Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert target["a"] == 3 * sum(_size(r[1]) for r in data if r[3] == "a")
    assert all(abs(taken[s] - t) <= M.BLOCK for s, t in target.items())


@pytest.mark.parametrize("shard_docs", [4, 1024])
def test_small_sources_and_the_statement_agree(spark, monkeypatch, shard_docs):
    monkeypatch.setattr(M, "SHARD_DOCS", shard_docs)
    rng = random.Random(12)
    text = lambda n: " ".join(["w"] * n)
    data = [(i, text(rng.randint(1, 60)), "en", "a", 0) for i in range(400)]
    data += [(1000 + i, text(5), "en", "b", 0) for i in range(30)] + [(2000 + i, text(2), "en", "c", 0) for i in range(10)]
    data += [(3000 + i, text(3), "en", f"host{i % 40:02}", 0) for i in range(240)]  # many sources of 18 words
    data += [(4000, text(9), "en", None, 0), (4001, None, "en", "a", 0), (4002, "", "en", "empty", 0)]
    got = M.mix(spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    taken, target = Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert target["b"] == 450 and target["c"] <= 60
    assert all(abs(taken[s] - t) <= M.BLOCK for s, t in target.items())
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(data, columns=["doc_id", "text", "lang", "source", "n_chars"]))
    want = {r[0]: r[1:] for r in con.sql(SQL.op3()).fetchall()}
    assert {r.id: (r.size, r.source_size, r.target, r.taken) for r in got} == want


def test_targets_cap_and_reshare(spark):
    sizes = {"a": 10, "b": 1000, "c": 500, "d": 0, None: 7}
    got = {r.source: r.target for r in M.targets(spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")).collect()}
    want = _targets(sizes)
    assert {k: pytest.approx(v) for k, v in want.items()} == got
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_sainte_lague_ranks_every_quotient(spark):
    rng = random.Random(5)
    data, want = [], {}
    for g in range(12):
        seats = rng.choice([0, 1, 3, 17, 200])
        votes = [rng.choice([0, 1, 5, 5, 40, 1000]) for _ in range(rng.randint(1, 9))]
        data += [(g, i, v, seats) for i, v in enumerate(votes)]
        bids = sorted(((-v / (k + 0.5), i) for i, v in enumerate(votes) if v for k in range(seats)))[:seats]
        won = Counter(i for _, i in bids)
        want |= {(g, i): won[i] for i in range(len(votes))}
    parties = spark.createDataFrame(data, "g int, i int, votes long, seats long")
    got = {(r.g, r.i): r.quota for r in M.sainte_lague(parties.withColumnRenamed("seats", "s"), ["g"], "votes", F.col("s"), [F.col("i")]).collect()}
    assert got == want


def test_mixed_documents_hold_the_taken_words(spark):
    data = rows(4, 70)
    d = docs(spark, data)
    out = M.mixed_documents(d)
    assert out.columns == d.columns and out.dtypes == d.dtypes
    words, most = Counter(), defaultdict(int)
    for r in out.collect():
        words[r.doc_id] += _size(r.text)
        assert r.n_chars == len(r.text)
        assert any(r.text in (x[1] or "") for x in data if x[0] == r.doc_id)
    taken = Counter()
    for r in M.mix(d).collect():
        taken[r.id] += r.taken
    assert words == Counter({k: v for k, v in taken.items() if v})


def test_mixing_empty_tables(spark):
    assert M.mix(docs(spark, [])).count() == 0
    assert M.mixed_documents(docs(spark, [])).count() == 0
    blank = [(1, None, "en", None, None, *["x"] * 9), (2, " ", "en", "s", 1, *["x"] * 9)]
    assert [r.taken for r in M.mix(docs(spark, blank)).collect()] == [0, 0]


def _least_bins(sizes, room):
    """The least number of bins by exhaustive search."""
    best = len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in sorted(set(bins)):
            if k + sizes[i] <= room:
                j = bins.index(k)
                go(i + 1, [*bins[:j], k + sizes[i], *bins[j + 1 :]])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best


def test_bin_completion_against_exhaustive_search():
    rng = random.Random(8)
    for _ in range(300):
        room = rng.choice([20, 50, 100])
        sizes = sorted((rng.randint(1, room) for _ in range(rng.randint(1, 11))), reverse=True)
        bins = P.complete(Counter(sizes), room)
        assert Counter(s for b in bins for s in b) == Counter(sizes)
        assert all(sum(b) <= room for b in bins)
        least = _least_bins(sizes, room)
        assert P.lower_bound(Counter(sizes), room) <= least == len(bins) <= len(P.best_fit(Counter(sizes), room))
    for _ in range(300):  # three to a bin, where best fit errs
        sizes = [rng.randint(12, 45) for _ in range(rng.randint(8, 12))]
        assert len(P.complete(Counter(sizes), 100)) == _least_bins(sorted(sizes, reverse=True), 100)
    assert len(P.complete(Counter([12, 44, 12, 20, 30, 31, 18, 32, 45, 22, 12, 22]), 100)) == 3


def test_bin_completion_beats_best_fit_where_it_wastes():
    sizes = np.random.default_rng(0).integers(200, 701, 500).tolist()
    assert len(P.complete(Counter(sizes), 1024)) < len(P.best_fit(Counter(sizes), 1024))


def test_dominance():
    assert P.dominates((6, 4), (5, 4)) and P.dominates((6,), (3, 3)) and not P.dominates((3, 3), (6,))


def _fits(inner, rooms):
    """Whether lengths can be dealt over rooms, by every way to deal them."""
    if not inner:
        return True
    s, tried = inner[0], set()
    for i, r in enumerate(rooms):
        if s <= r and r not in tried:
            tried.add(r)
            if _fits(inner[1:], [*rooms[:i], r - s, *rooms[i + 1 :]]):
                return True
    return False


def test_fillings_are_all_the_undominated_ones():
    rng = random.Random(3)
    several = 0
    for _ in range(60):
        room = rng.randint(8, 44)
        sizes = sorted(rng.sample(range(1, 24), rng.randint(1, 8)), reverse=True)
        stock = [rng.randint(0, 2) for _ in sizes]
        every = [()]
        for s, n in zip(sizes, stock):
            every = [f + (s,) * k for f in every for k in range(n + 1) if sum(f) + k * s <= room]
        want = {f for f in every if not any(g != f and _fits(f, list(g)) for g in every)}
        got = [f for f in P.fillings(sizes, stock, room) if f is not None]
        assert len(got) == len(set(got)) and set(got) == want
        assert [sum(f) for f in got] == sorted(map(sum, got), reverse=True)
        several += len(want) > 4
    assert several


@pytest.mark.parametrize("fast", [True, False])
def test_packed_documents(spark, fast):
    data = [r for r in rows(6, 50)]
    names = vocabulary()
    got = P.pack_documents(docs(spark, data), names[0], names[1] if fast else None, group=16).collect()
    t = Tokenizer.from_file(names[0])
    t.encode_special_tokens = True
    want = []
    for r in data:
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        for p, (s, e) in enumerate(zip(cuts, cuts[1:])):
            want.append((-1 if r[0] is None else r[0], p, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes())))
    assert sorted((-1 if r.id is None else r.id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 1024


@pytest.mark.parametrize("fast", [True, False])
def test_added_tokens_get_their_ids(fast):
    names = vocabulary()
    t = Tokenizer.from_file(names[0])
    encode = P.encoder(names[0], names[1] if fast else None)
    for text in ("a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y", "a <|endoftext| > b", "plain"):
        assert encode(text).tolist() == t.encode(text, add_special_tokens=False).ids
    assert 50256 in encode("a <|endoftext|> b")


def test_packing_an_empty_table(spark):
    assert P.pack_documents(docs(spark, []), *vocabulary()).count() == 0


def test_texts_travel_in_small_batches(spark, monkeypatch):
    from framelake.llm.shared import BATCH_ROWS, BATCHES, small_batches, written

    n = 3 * BATCH_ROWS + 5
    many = docs(spark, [{"doc_id": i, "text": f"text {i}"} for i in range(n)]).coalesce(1)
    sizes = []

    def watched(df, tag):
        assert [int(spark.conf.get(b)) for b in BATCHES] == [BATCH_ROWS] * 2
        seen = written(many.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long"), "sizes")
        sizes.extend(r.n for r in seen.collect())
        return written(df, tag)

    monkeypatch.setattr(P, "written", watched)
    before = [spark.conf.get(b, None) for b in BATCHES]
    assert P.pack_documents(many, *vocabulary()).count() == n
    assert sum(sizes) == n and max(sizes) <= BATCH_ROWS
    assert [spark.conf.get(b, None) for b in BATCHES] == before
    spark.conf.set(BATCHES[0], "7")  # a session's own smaller setting stays, also after an error
    with pytest.raises(KeyError), small_batches(spark):
        assert [spark.conf.get(b) for b in BATCHES] == ["7", str(BATCH_ROWS)]
        raise KeyError
    assert spark.conf.get(BATCHES[0]) == "7"
    spark.conf.unset(BATCHES[0])
