"""Sinks: the tables that a run hands on, and their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import confidence, corners, fixed, score_text


def results(readings: DataFrame) -> DataFrame:
    """Readings (text, score, pieces) as results: confidence in percent, the number
    of pieces, and each piece's box as eight numbers."""
    flat = F.transform("pieces", lambda p: F.struct(p["text"].alias("text"), p["score"].cast("float").alias("score"), F.flatten(F.transform(p["box"], lambda c: F.array(c["x"], c["y"]))).cast("array<float>").alias("box")))
    others = [c for c in readings.columns if c not in ("text", "score", "pieces")]
    return readings.select(*others, "text", confidence(F.col("score")).alias("confidence"), F.size("pieces").alias("count"), flat.alias("pieces"))


def piece_lines(pieces: DataFrame) -> DataFrame:
    """Report lines: index, score, text and corners of each piece."""
    line: Column = F.format_string('    [%2d] score=%s text="%s"  box=%s', F.col("seq"), fixed(F.col("score"), 3), F.col("text"), corners(F.col("box")))
    return pieces.withColumn("line", line)


def reads_table(scored: DataFrame) -> DataFrame:
    """Scored reads as printed rows: milliseconds with one digit, yes or no, rate
    with two."""
    yes = F.when(F.col("match"), "yes").otherwise("no")
    shown = {"ms": fixed(F.col("ms"), 1), "match": yes, "cer": fixed(F.col("cer"), 2)}
    return scored.withColumns({k: v for k, v in shown.items() if k in scored.columns})


def pieces_table(pieces: DataFrame) -> DataFrame:
    """Pieces of compared engines: score as five characters, corners as text."""
    return pieces.select("screen", "id", "engine", score_text(F.col("score")).alias("score"), corners(F.col("box")).alias("corners"), "text")


def summary_table(tallies: DataFrame, keys: list[str]) -> DataFrame:
    """Tallies as printed: matched of all, mean rate and mean time, by key."""
    shown = tallies.select(*keys, F.concat_ws("/", F.col("matched").cast("string"), F.col("n").cast("string")).alias("matched"), fixed(F.col("mean_cer"), 3).alias("mean_cer"), fixed(F.col("mean_ms"), 1).alias("mean_ms"))
    return shown.orderBy(*keys)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.option("sep", "\t").option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)
