"""Chat formatting by perspective rotation: for every participant of a dialogue,
the dialogue with that speaker as the assistant and the others as named users, and
the mask of what a model is trained on.

Native. A dialogue is rendered in the order of turn, then role, then digest of the
text. A row holds one part of it: at most PART turns of SEGMENT consecutive turn
numbers, so a dialogue of any length, and a turn number that repeats or is missing
any number of times, never meet in one task. Parts follow each other in that order,
`start` and the mask's places run on over the whole dialogue, and the parts'
renderings, one after another, are the dialogue's.

A place in a perspective's rendering is the place in one where all are named users,
less what the perspective's own heads are shorter by: so lengths are summed once for
all perspectives, on rows without text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import running, text_of, written

#: Turn numbers of a segment, and turns of a part of it: sizes of rows, which say
#: where a dialogue is cut and nothing else.
SEGMENT = 64
PART = 256
#: Segments whose lengths are summed before those of the ones after them.
SPAN = 4096
#: The template of one turn; a named user's name stands in the head.
HEAD_SELF, HEAD_OTHER, HEAD_END, TAIL = "<|assistant|>\n", "<|user:", "|>\n", "<|end|>\n"


def parted(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, segment: int, most: int) -> DataFrame:
    """(conv, turn, role, text, digest, segment, part). `conv` is the dialogue id in a
    struct, so that a null id is equal to itself. Parts number the runs of `most`
    turns of a segment."""
    rows = turns.select(
        F.struct(F.col(conv_col).alias("id")).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"), text_of(text_col).alias("text"),
    )
    rows = rows.withColumn("digest", F.md5("text")).withColumn("segment", F.coalesce(F.floor(F.col("turn") / segment), F.lit(-1)).cast("long"))
    # Segments of several parts are listed first; the list is written, so that its size
    # is known when the join is planned, and is empty where turn numbers don't repeat.
    large = written(rows.groupBy("conv", "segment").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("conv", "segment"), "large")
    few = rows.join(large, ["conv", "segment"], "left_anti").withColumn("part", F.lit(0).cast("long"))
    if large.isEmpty():
        return few
    many = rows.join(large, ["conv", "segment"])
    many = running(many.withColumn("one", F.lit(1).cast("long")), ["conv", "segment"], ["turn", "role", "digest"], {"one": "before"})
    return few.unionByName(many.withColumn("part", F.expr(f"before div {most}")).select(few.columns))


def starts(sizes: DataFrame, length: str, span: int = SPAN) -> DataFrame:
    """Add `start`, the sum of `length` over a (conv, perspective)'s parts before this
    one: first over spans of segments, then inside a span."""
    whole = sizes.withColumn("span", F.floor(F.col("segment") / span))
    sums = whole.groupBy("conv", "perspective", "span").agg(F.sum(length).alias("sum"))
    until = Window.partitionBy("conv", "perspective").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("sum").over(until), F.lit(0))).drop("sum")
    inside = Window.partitionBy("conv", "perspective", "span").orderBy("segment", "part").rowsBetween(Window.unboundedPreceding, -1)
    own = whole.withColumn("own", F.coalesce(F.sum(length).over(inside), F.lit(0)))
    return own.join(sums, ["conv", "perspective", "span"]).withColumn("start", F.col("base") + F.col("own")).drop("base", "own", "span")


def rotate(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", segment: int = SEGMENT, most: int = PART
) -> DataFrame:
    """Render every dialogue once for each of its participants.

    Returns one row per dialogue, participant, segment and part of a segment (0 but
    where turn numbers repeat): conv_id, perspective, segment, part, start (code
    points of the dialogue's rendering before this part), n_turns, n_own (turns of
    the perspective), rendered, n_chars (code points of rendered), mask_chars (code
    points to be learnt) and mask, an array of (start, end) in code points of the
    whole rendering: each own turn's text with its end mark. A null role is the
    participant "unknown", a null text is empty, turns without a number are segment
    -1 and come first; a null dialogue id is a dialogue. Repeated rows are turns of
    their own. A part without own turns keeps its row with an empty mask. An empty
    table gives an empty result. Other columns are not read.
    """
    rows = parted(turns, conv_col, turn_col, role_col, text_col, segment, most)
    keys = ["conv", "segment", "part"]
    # All heads as those of named users; a perspective's own are `less` shorter.
    others = len(HEAD_OTHER) + len(HEAD_END)
    rows = rows.withColumn("size", (F.length("role") + F.length("text") + others + len(TAIL)).cast("long"))
    less = lambda name: F.length(name) + others - len(HEAD_SELF)
    speakers = rows.select("conv", F.col("role").alias("perspective")).distinct()
    lengths = rows.groupBy(*keys).agg(F.sum("size").alias("size"))
    owned = rows.groupBy(*keys, F.col("role").alias("perspective")).agg(F.count("*").alias("n_own"))
    views = lengths.join(speakers, "conv").join(owned, [*keys, "perspective"], "left")
    views = views.withColumn("n_own", F.coalesce("n_own", F.lit(0)))
    views = views.withColumn("n_chars", (F.col("size") - F.col("n_own") * less("perspective")).cast("long")).drop("size")
    views = starts(views, "n_chars")

    before = Window.partitionBy(*keys).orderBy("turn", "role", "digest").rowsBetween(Window.unboundedPreceding, -1)
    said = rows.withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0)))
    said = said.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "role", "text"))).alias("said"))
    out = views.join(said, keys)

    own = lambda t: t["role"] == F.col("perspective")
    head = lambda t: F.when(own(t), F.lit(HEAD_SELF)).otherwise(F.concat(F.lit(HEAD_OTHER), t["role"], F.lit(HEAD_END)))
    body = F.transform("said", lambda t: F.concat(head(t), t["text"], F.lit(TAIL)))

    def span(t: Column, k: Column) -> Column:
        start = F.col("start") + t["at"] - k * less("perspective") + len(HEAD_SELF)
        return F.struct(start.alias("start"), (start + F.length(t["text"]) + len(TAIL)).alias("end"))

    out = out.withColumn("mask", F.transform(F.filter("said", own), span))
    return out.select(
        F.col("conv.id").alias("conv_id"), "perspective", "segment", "part", "start",
        F.size("said").cast("long").alias("n_turns"), "n_own", F.array_join(body, "").alias("rendered"), "n_chars",
        F.aggregate("mask", F.lit(0).cast("long"), lambda a, m: a + m["end"] - m["start"]).alias("mask_chars"), "mask",
    )
