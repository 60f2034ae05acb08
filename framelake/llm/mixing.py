"""Mixing sources to target weights by Sainte-Lague apportionment.

Native: DataFrame operations only. The token budget is cut into equal blocks.
The blocks go to the sources by highest quotients target / (k + 1/2), then, with
the same rule, to the shards of a source. In each shard a source's documents lie
in seeded order on one token line that closes into a ring; the shard's quota is
that many consecutive blocks of the ring from a seeded start, whole rounds
included, so a document's share follows from its place alone and no block is
ever enumerated. A shard never takes more than its cap; the words of its quota
above that go to the source's other shards.

Scale: word counts shrink each row to (id, source, size) before any shuffle. The
tables of sources and of (source, shard) pairs are aggregates; ranks and running sums
over all sources are taken by range partitions, so that sources may be as many as
hosts. Documents meet in windows only inside one (source, shard), whose number grows
with the table, so a source with a third of all rows is spread over all shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACE, WORD, free_name, place, running, text_of, written

WEIGHTS = (5, 2, 1)
REPEATS = 3
#: Words of a block. Quotients are ranked near the boundary alone, so blocks can be
#: small, and a source of few words comes near its target too.
BLOCK = 4
SEED = 20240229
#: Documents in a shard, over all sources, and the number of shards that keeps
#: one window over a source's shards small. A size for tasks: no row is dropped.
SHARD_DOCS = 1024
MOST_SHARDS = 1 << 13


def word_count(text: Column) -> Column:
    """The number of words: each with the white space after it shrinks to one letter,
    and no list of words is built."""
    return F.length(F.regexp_replace(F.ltrim(text, F.lit(SPACE)), WORD + r"[\x20\x09-\x0D]*", "w")).cast("long")


def seeded(seed: int, *parts: Column) -> Column:
    """A seeded draw, 32 hexadecimal digits; null counts as empty."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def number(draw: str | Column) -> Column:
    """The first 32 bits of a draw."""
    return F.conv(F.substring(draw, 1, 8), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """Add `weight` and `target` to a table of (source, source_size).

    Weights repeat over the sources in code point order, null last. All sizes
    together are shared by weight; a target stops at `repeats` times its source's
    size and the excess is shared again by weight until none is above. That is
    min(cap, level * weight) for one level, found from running sums over the
    sources in order of cap / weight.
    """
    named = written(sources.select("source", "source_size", F.col("source").isNull().alias("last"), F.lit(1).cast("long").alias("one")), "sources")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("at"), F.lit(len(weights))) + 1).cast("int"))
    t = running(named, [], ["last", "source"], {"one": "at"}).withColumn("weight", weight.cast("long"))
    t = t.withColumn("cap", F.lit(repeats) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    t = t.select("source", "source_size", "last", "weight", "cap", "ratio")
    total, all_weights = t.agg(F.sum("source_size"), F.sum("weight")).first()
    t = running(t, [], ["ratio", "last", "source"], {"cap": "caps", "weight": "weights"})
    level = (F.lit(total) - F.col("caps")) / (F.lit(all_weights) - F.col("weights"))
    # The level is that of the first source, in this order, that stays under its cap.
    stays = t.select(level.alias("level"), "ratio", "last", "source").filter("level <= ratio")
    level = stays.agg(F.min_by("level", F.struct("ratio", "last", "source"))).first()[0]
    return t.select("source", "source_size", "weight", F.least(F.col("cap").cast("double"), F.lit(level).cast("double") * F.col("weight")).alias("target"))


def brackets(votes: Column, votes_all: Column, n: Column, seats: Column) -> tuple[Column, Column]:
    """Seats between which a party's lie: roundings at two divisors, one of which gives
    the n parties with votes at most `seats` in all, the other at least that."""
    usable, share = (votes > 0) & (seats > 0), votes / votes_all
    low = F.when(usable, F.greatest(F.floor(share * (seats - n / 2) + 0.5) - 1, F.lit(0))).otherwise(0).cast("long")
    high = F.when(usable, F.floor(share * (seats + n / 2) + 0.5) + 1).otherwise(0).cast("long")
    return low, high


def seats_of_sources(sources: DataFrame, seats: int) -> DataFrame:
    """Add `quota`, the seats of each source by the quotients target / (k + 1/2), ties
    in order of sources. As sainte_lague, but for parties that may be too many for one
    task: sums are aggregates, and the open quotients are ranked by range."""
    t = sources.withColumn("last", F.col("source").isNull())
    everyone, n = t.agg(F.sum("target"), F.count(F.when(F.col("target") > 0, 1))).first()
    low, high = brackets(F.col("target"), F.lit(everyone), F.lit(n), F.lit(seats))
    t = written(t.withColumn("low", low).withColumn("high", high), "brackets")
    still = max(seats, 0) - (t.agg(F.sum("low")).first()[0] or 0)
    bids = t.filter("high > low").select("last", "source", "target", F.explode(F.sequence("low", F.col("high") - 1)).alias("k"))
    bids = bids.select((-F.col("target") / (F.col("k") + 0.5)).alias("bid"), "last", "source", F.lit(1).cast("long").alias("one"))
    won = running(bids, [], ["bid", "last", "source"], {"one": "before"}).filter(F.col("before") < still)
    won = won.groupBy("last", "source").agg(F.count("*").alias("won"))
    out = t.alias("a").join(won.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "left")
    return out.select(*[F.col(f"a.{c}") for c in sources.columns], (F.col("a.low") + F.coalesce(F.col("b.won"), F.lit(0))).alias("quota"))


def sainte_lague(parties: DataFrame, group: list[str], votes: str, seats: Column, order: list[Column]) -> DataFrame:
    """Add `quota`, the integer seats of each party of a group that one task holds.

    Seat k + 1 of a party has the quotient votes / (k + 1/2); the highest
    quotients win, ties by `order`. Rounding at two divisors brackets the result, and
    only the quotients between them, about two a party, are ranked. A group without
    votes or seats gets no quota.
    """
    w = Window.partitionBy(*group)
    t = parties.withColumn("seats", F.greatest(seats.cast("long"), F.lit(0)))
    t = t.withColumn("votes_all", F.sum(votes).over(w).cast("double")).withColumn("n", F.sum(F.when(F.col(votes) > 0, 1).otherwise(0)).over(w))
    low, high = brackets(F.col(votes), F.col("votes_all"), F.col("n"), F.col("seats"))
    t = t.withColumn("low", low).withColumn("high", high)
    t = t.withColumn("open", F.col("seats") - F.sum("low").over(w)).withColumn("party", F.row_number().over(w.orderBy(*order)))
    bids = t.filter("high > low").select(*group, "party", "open", F.col(votes).alias("votes"), F.explode(F.sequence("low", F.col("high") - 1)).alias("k"))
    rank = F.row_number().over(w.orderBy((F.col("votes") / (F.col("k") + 0.5)).desc(), "party"))
    won = bids.withColumn("rank", rank).filter("rank <= open").groupBy(*group, "party").agg(F.count("*").alias("won"))
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*group, "party")]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    out = t.alias("a").join(won.alias("b"), cond, "left")
    return out.select(*[F.col(f"a.{c}") for c in parties.columns], (F.col("a.low") + F.coalesce(F.col("b.won"), F.lit(0))).alias("quota"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", uid: str | None = None, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """Settle how many words of each document the mix takes.

    Returns one row per input row: id, uid, source, size, source_size, target,
    taken, and the place of a last partial pass: `whole` full copies, then the
    words [first, first + first_n) and [0, second_n) of one more copy. taken is
    whole * size + first_n + second_n and never above repeats * size. The same
    rows and seed give the same result: the order inside a shard is by a seeded
    hash of id and text, and rows alike in both are interchangeable. A null
    source is a source of its own, last in order. A null or empty text has size 0
    and gives nothing, as does a table without words. Other columns are not read.
    """
    text = text_of(text_col)
    sized = docs.select(
        F.col(id_col).alias("id"), (F.col(uid) if uid else F.monotonically_increasing_id()).alias("uid"),
        F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"),
        seeded(seed, F.col(id_col), text).alias("draw"),
    )
    sized = written(sized, "sizes")
    shards = min(MOST_SHARDS, max(1, -(-sized.count() // SHARD_DOCS)))
    sized = sized.withColumn("shard", F.pmod(number("draw"), F.lit(shards)))

    lines = written(sized.groupBy("source", "shard").agg(F.sum("size").alias("line")), "lines")
    sources = targets(lines.groupBy("source").agg(F.sum("line").alias("source_size")), weights, repeats)
    blocks = lines.agg(F.round(F.sum("line") / block).cast("long")).first()[0] or 0
    sources = written(seats_of_sources(sources, blocks), "quotas")
    shared = lines.alias("l").join(sources.alias("s"), F.col("l.source").eqNullSafe(F.col("s.source")))
    shared = shared.select("l.source", "l.shard", "l.line", "s.source_size", "s.target", "s.quota")
    shared = sainte_lague(shared.withColumnRenamed("quota", "blocks"), ["source"], "line", F.col("blocks"), [F.col("shard")])

    # A shard takes `words` words: whole rounds of its line, then `rest` words from `start`.
    # What a quota has above its shard's cap goes to the source's other shards, in
    # proportion to their room: differences of a running share, whose sum is exact.
    shared = shared.withColumn("words", F.least(F.col("quota") * block, F.lit(repeats) * F.col("line")))
    shared = shared.withColumn("room", F.lit(repeats) * F.col("line") - F.col("words"))
    of_source = Window.partitionBy("source")
    shared = shared.withColumn("rooms", F.sum("room").over(of_source)).withColumn("excess", F.least(F.col("rooms"), F.sum(F.col("quota") * block - F.col("words")).over(of_source)))
    shared = shared.withColumn("upto", F.sum("room").over(of_source.orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    share = lambda upto: f"cast({upto} as decimal(19,0)) * cast(excess as decimal(19,0)) div cast(rooms as decimal(19,0))"
    more = F.expr(f"({share('upto')}) - ({share('(upto - room)')})")
    more = F.when((F.col("excess") > 0) & (F.col("rooms") > 0), more).otherwise(0)
    shared = shared.select("source", "shard", "line", "source_size", "target", (F.col("words") + more).alias("words"))
    shared = shared.withColumn("rounds", F.when(F.col("line") > 0, F.expr("words div line")).otherwise(0)).withColumn("rest", F.col("words") - F.col("rounds") * F.col("line"))
    shared = shared.withColumn("start", F.when(F.col("line") > 0, F.pmod(number(seeded(seed, F.col("source"), F.col("shard"))), F.col("line"))).otherwise(0))

    placed = sized.withColumn("at", F.sum("size").over(Window.partitionBy("source", "shard").orderBy("draw", "id", "uid").rowsBetween(Window.unboundedPreceding, -1)))
    placed = placed.withColumn("at", F.coalesce(F.col("at"), F.lit(0)))
    out = placed.alias("d").join(shared.alias("q"), F.col("d.source").eqNullSafe(F.col("q.source")) & (F.col("d.shard") == F.col("q.shard")))
    # The interval [start, start + rest) on the ring, cut at the line's end: [start, end) and [0, over).
    end, over = F.least(F.col("start") + F.col("rest"), F.col("line")), F.greatest(F.col("start") + F.col("rest") - F.col("line"), F.lit(0))
    stop = F.col("at") + F.col("size")
    first_n = F.greatest(F.least(end, stop) - F.greatest(F.col("start"), F.col("at")), F.lit(0))
    second_n = F.greatest(F.least(over, stop) - F.col("at"), F.lit(0))
    out = out.select("d.id", "d.uid", "d.source", "size", "source_size", "target", F.col("rounds").alias("whole"), F.greatest(F.col("start") - F.col("at"), F.lit(0)).alias("first"), first_n.alias("first_n"), second_n.alias("second_n"))
    return out.withColumn("taken", F.when(F.col("size") > 0, F.col("whole") * F.col("size") + F.col("first_n") + F.col("second_n")).otherwise(0).cast("long"))


def mixed_documents(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The mix as documents: docs' columns, one row for each whole copy and one for
    each partial one, whose text is the words that the mix takes of it with the
    white space after each. A column `n_chars` follows its text."""
    uid = free_name(docs, "uid")
    marked = docs.withColumn(uid, place(docs))
    shares = mix(marked, text_col=text_col, uid=uid, **options).filter("taken > 0").select("uid", "size", "whole", "first", "first_n", "second_n")
    part = lambda at, n: F.struct(at.cast("int").alias("at"), n.cast("int").alias("n"))
    one = F.array_repeat(part(F.lit(0), F.lit(-1)), F.col("whole").cast("int"))
    full = F.col("first_n") + F.col("second_n") == F.col("size")
    rest = F.when(full, F.array(part(F.lit(0), F.lit(-1)))).otherwise(F.filter(F.array(part(F.col("first"), F.col("first_n")), part(F.lit(0), F.col("second_n"))), lambda p: p["n"] > 0))
    shares = shares.select("uid", F.concat(one, rest).alias("parts"))
    cut, parts = free_name(docs, "cut"), free_name(docs, "parts")
    # The shares are narrow and their ids unique: hashed, so that texts need no sort.
    shares = shares.select(F.col("uid").alias(uid), F.col("parts").alias(parts)).hint("shuffle_hash")
    out = marked.join(shares, uid).withColumn(cut, F.explode(parts))
    words = F.regexp_extract_all(text_of(text_col), F.lit(f"({WORD}[\\x20\\x09-\\x0D]*)"), F.lit(1))
    text = F.when(F.col(cut)["n"] < 0, F.col(text_col)).otherwise(F.array_join(F.slice(words, F.col(cut)["at"] + 1, F.greatest(F.col(cut)["n"], F.lit(0))), ""))
    out = out.withColumn(text_col, text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text_of(text_col)).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
