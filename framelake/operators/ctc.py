"""Decoding a recogniser's output: the likeliest class per step, runs collapsed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def likeliest(row: Column) -> Column:
    """The index of the largest value, the first of equal ones."""
    return (F.array_position(row, F.array_max(row)) - 1).cast("int")


def decode_best(best: Column, listed: Column) -> Column:
    """(text, score) of an array of (c, p), each step's likeliest class and its
    probability.

    A class counts where it differs from the step before, is not the blank (0) and
    is in the list; the score is the mean probability of those, 0 without any. One
    fold that carries the class before, so the work grows with the steps alone.
    """
    zero = F.struct(F.lit(-1).alias("before"), F.lit("").alias("text"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"))

    def add(acc: Column, s: Column) -> Column:
        counts = (s["c"] != acc["before"]) & (s["c"] > 0) & (s["c"] < F.size(listed))
        return F.struct(
            s["c"].alias("before"),
            F.when(counts, F.concat(acc["text"], F.element_at(listed, s["c"] + 1))).otherwise(acc["text"]).alias("text"),
            (acc["sum"] + F.when(counts, s["p"]).otherwise(0.0)).alias("sum"),
            (acc["n"] + F.when(counts, 1).otherwise(0)).alias("n"),
        )

    done = lambda a: F.struct(a["text"].alias("text"), F.when(a["n"] > 0, a["sum"] / a["n"]).otherwise(0.0).alias("score"))
    return F.aggregate(best, zero, add, done)


def decode_array(steps: Column, listed: Column) -> Column:
    """The same of an array of per-step class probabilities."""
    return decode_best(F.transform(steps, lambda row: F.struct(likeliest(row).alias("c"), F.array_max(row).cast("double").alias("p"))), listed)


def decode(logits: DataFrame, crop: str, listed: Column) -> DataFrame:
    """The same from long rows (crop, t, c, p): one row per crop with text and score.

    Classes shrink to one row a step before the first shuffle; the run filter and the
    crop's text share the second one. The character list is a literal: it is as long
    as a recogniser has classes.
    """
    steps = logits.groupBy(crop, "t").agg(F.max(F.struct(F.col("p"), (-F.col("c")).alias("c"))).alias("best"))
    steps = steps.select(crop, "t", (-F.col("best.c")).alias("idx"), F.col("best.p").alias("p"))
    before = F.lag("idx").over(Window.partitionBy(crop).orderBy("t"))
    steps = steps.withColumn("kept", F.coalesce(before != F.col("idx"), F.lit(True)) & (F.col("idx") > 0) & (F.col("idx") < F.size(listed)))
    said = F.transform(F.array_sort(F.collect_list(F.when(F.col("kept"), F.struct("t", "idx")))), lambda s: F.element_at(listed, s["idx"] + 1))
    return steps.groupBy(crop).agg(F.array_join(said, "").alias("text"), F.coalesce(F.avg(F.when(F.col("kept"), F.col("p"))), F.lit(0.0)).alias("score"))
