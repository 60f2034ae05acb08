"""Evaluation: scoring reads, tallies, timings and parameter sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import error_rate, normalise

#: The engines compared, in order: the own models on the compressed and on the raw
#: frame, then another engine as it is, enlarged, and enlarged and filtered.
ENGINES = ("own", "own_raw", "other", "other_x2", "other_x3", "other_x2_filters")
OWN_ENGINES = ("own", "own_raw")
BEST = "other_best"


def engines(spark: SparkSession) -> DataFrame:
    """The engines as a dimension table with what each does to its input."""
    rows = [(n, k, n.startswith("own"), n == "own_raw", 3 if "x3" in n else 2 if "x2" in n else 1, n.endswith("filters")) for k, n in enumerate(ENGINES)]
    return spark.createDataFrame(rows, "engine string, engine_ord int, own boolean, raw boolean, resize int, filters boolean")


def score_reads(reads: DataFrame, text: str = "text", expected: str = "expected") -> DataFrame:
    """Add `match` and `cer` to reads that carry their expected text."""
    got, want = normalise(F.col(text)), normalise(F.col(expected))
    return reads.withColumns({"_got": got, "_want": want}).withColumns({"match": F.col("_got") == F.col("_want"), "cer": error_rate(F.col("_got"), F.col("_want"))}).drop("_got", "_want")


def _tally() -> list[Column]:
    return [F.count("*").alias("n"), F.count_if("match").alias("matched"), F.avg("cer").alias("mean_cer"), F.avg("ms").alias("mean_ms")]


def tally_by_mode(scored: DataFrame) -> DataFrame:
    """Each mode's tallies by category and over all ("all")."""
    sets = scored.groupingSets([[F.col("mode"), F.col("category")], [F.col("mode")]], F.col("mode"), F.col("category"))
    t = sets.agg(F.grouping_id().alias("_g"), *_tally())
    return t.select("mode", F.when(F.col("_g") == 1, "all").otherwise(F.col("category")).alias("category"), "n", "matched", "mean_cer", "mean_ms")


def best_reads(scored: DataFrame, order: str = "engine_ord") -> DataFrame:
    """Of each region of a screen the best read of the other engines: the least
    error, the first engine of equal ones. Its time counts as zero."""
    w = Window.partitionBy("screen", "region_id").orderBy("cer", order)
    other = scored.filter(~F.col("engine").isin(*OWN_ENGINES)).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    return other.withColumns({"engine": F.lit(BEST), "ms": F.lit(0.0)})


def tally_by_engine(scored: DataFrame) -> DataFrame:
    """Each engine's tallies over all, by screen and by category, the best of the
    other engines among them."""
    t = scored.select("engine", "screen", "category", "match", "cer", "ms")
    e, s, c = F.col("engine"), F.col("screen"), F.col("category")
    sets = t.groupingSets([[e], [e, s], [e, c]], e, s, c).agg(F.grouping_id().alias("_g"), *_tally())
    # Of the grouping bits, 2 says that screen is rolled up and 1 that category is.
    group = F.when(F.col("_g") == 3, "all").when(F.col("_g") == 1, F.concat(F.lit("screen "), s)).otherwise(F.concat(F.lit("category "), c))
    return sets.select("engine", group.alias("group"), "n", "matched", "mean_cer", "mean_ms")


def overall(scored: DataFrame) -> DataFrame:
    """Matches of all and the mean time of a region."""
    return scored.agg(F.count_if("match").alias("matched"), F.count("*").alias("total"), F.coalesce(F.avg("ms"), F.lit(0.0)).alias("ms_per_region"))


def timing_summary(cycles: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and population deviation of long samples (metric, value), 0 without any."""
    return cycles.groupBy(*keys).agg(F.coalesce(F.avg("value"), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_pop("value"), F.lit(0.0)).alias("std"), F.count("value").alias("n"))


def timed_mean(cycles: DataFrame, keys: list[str]) -> DataFrame:
    """The mean over timed cycles; cycle 0 is the warm-up."""
    return cycles.filter("cycle > 0").groupBy(*keys).agg(F.avg("value").alias("ms"))


def last_cycle(cycles: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """What the last cycle of each group left."""
    return cycles.groupBy(*keys).agg(F.max("cycle").alias("cycle"), *[F.max_by(v, "cycle").alias(v) for v in values])


def usage(proc_delta: Column, sys_delta: Column, cores: Column) -> Column:
    """CPU percent of a process, 0 where the system's clock did not move."""
    return F.when(sys_delta > 0, proc_delta / sys_delta * 100 * cores).otherwise(0.0)


def sweep_grid(spark: SparkSession, images: list[str], det: list[float], box: list[float], unclip: list[float]) -> DataFrame:
    """Every combination of an image and the swept values, numbered in run order."""
    grid = spark.range(1)
    for name, values in (("image", images), ("det_thresh", det), ("box_thresh", box), ("unclip_ratio", unclip)):
        grid = grid.select("*", F.posexplode(F.array(*[F.lit(v) for v in values])).alias(f"_{name}", name))
    place = ((F.col("_image") * len(det) + F.col("_det_thresh")) * len(box) + F.col("_box_thresh")) * len(unclip) + F.col("_unclip_ratio")
    return grid.select((place + 1).cast("long").alias("run"), "image", "det_thresh", "box_thresh", "unclip_ratio")


def sweep_report(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Each run's number of pieces and their texts, in order, joined by ";"."""
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda p: p["text"]), ";")
    return pieces.groupBy(*keys).agg(F.count("*").alias("n_pieces"), texts.alias("recognized_text"))
