"""Region files and character lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import _leading_int

FIELDS = ("id", "category", "x", "y", "width", "height", "expected")


def parse_regions(lines: DataFrame, column: str = "value") -> DataFrame:
    """Tab-separated lines as regions, other columns kept. A carriage return at the
    end goes; empty lines and those that begin with # are skipped, as are those
    without exactly seven fields. An empty field at the very end is none. Numbers
    are read as C reads them, 0 for anything else."""
    line = F.regexp_replace(column, "\r$", "")
    fields = F.split(line, "\t")
    fields = F.when(F.element_at(fields, -1) == "", F.slice(fields, 1, F.greatest(F.size(fields) - 1, F.lit(0)))).otherwise(fields)
    others = [c for c in lines.columns if c != column]
    kept = lines.filter((line != "") & ~line.startswith("#")).withColumn("_fields", fields).filter(F.size("_fields") == len(FIELDS))
    pick = lambda k, name: (_leading_int(F.col("_fields")[k]) if name in ("x", "y", "width", "height") else F.col("_fields")[k]).alias(name)
    return kept.select(*others, *[pick(k, n) for k, n in enumerate(FIELDS)])


def load_regions(spark: SparkSession, path: str) -> DataFrame:
    """The regions of every file under path, with the `screen` of its name."""
    from ..functions.text import screen_name

    lines = spark.read.text(path).withColumn("screen", screen_name(F.col("_metadata.file_path")))
    return parse_regions(lines)


def character_list(spark: SparkSession, path: str) -> list[str]:
    """Characters by class: "blank", one line of the file each, a space. The list is
    as long as a recogniser has classes, a few thousand, whatever the data. A file
    that cannot be read raises."""
    lines = spark.read.text(path, wholetext=True).first()["value"]
    rows = lines.split("\n")
    if rows[-1] == "":
        rows.pop()
    return ["blank", *(r.removesuffix("\r") for r in rows), " "]


def characters(spark: SparkSession, listed: list[str]) -> DataFrame:
    """The character list as rows (idx, ch), for joins."""
    return spark.createDataFrame(list(enumerate(listed)), "idx int, ch string")


def literal(listed: list[str]) -> Column:
    """The character list as an array literal."""
    return F.array(*[F.lit(c) for c in listed])
