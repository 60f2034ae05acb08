from pathlib import Path

import pytest
from pyspark.sql import functions as F

from framelake.functions import text as x
from framelake.operators import evaluate as E
from framelake.sources import sinks

RECORD = Path(__file__).with_name("recorded_reads.tsv")
READS = [line.split("\t") for line in RECORD.read_text(encoding="utf-8").split("\n") if line and not line.startswith("#")]
# The tallies recorded with the reads of recorded_reads.tsv.
TALLIES = {
    ("pad", "all"): ("23/31", "0.035", "46.5"),
    ("pad", "long"): ("3/4", "0.017", "74.1"),
    ("pad", "loose"): ("8/9", "0.074", "36.5"),
    ("pad", "multi"): ("1/6", "0.046", "59.9"),
    ("pad", "tight"): ("11/12", "0.006", "38.0"),
    ("rec", "all"): ("17/31", "0.250", "7.4"),
    ("rec", "long"): ("1/4", "0.377", "7.8"),
    ("rec", "loose"): ("5/9", "0.226", "6.6"),
    ("rec", "multi"): ("0/6", "0.690", "7.8"),
    ("rec", "tight"): ("11/12", "0.006", "7.7"),
    ("stretch", "all"): ("19/31", "0.164", "39.3"),
    ("stretch", "long"): ("1/4", "0.309", "60.0"),
    ("stretch", "loose"): ("6/9", "0.078", "34.5"),
    ("stretch", "multi"): ("1/6", "0.515", "39.0"),
    ("stretch", "tight"): ("11/12", "0.006", "36.2"),
}


@pytest.fixture(scope="module")
def scored(spark):
    reads = spark.createDataFrame([(c, mode, e, t, float(ms), m, r) for c, mode, e, t, ms, m, r in READS], "category string, mode string, expected string, text string, ms double, seen_match string, seen_cer string")
    return E.score_reads(reads)


def test_recorded_reads(scored):
    for r in sinks.reads_table(scored).collect():
        assert (r.match, r.cer) == (r.seen_match, r.seen_cer)


def test_recorded_tallies(scored):
    got = {(r["mode"], r.category): (r.matched, r.mean_cer, r.mean_ms) for r in sinks.summary_table(E.tally_by_mode(scored), ["mode", "category"]).collect()}
    assert {k: g[:2] for k, g in got.items()} == {k: t[:2] for k, t in TALLIES.items()}
    # The recorded times are means of unrounded ones.
    assert all(abs(float(got[k][2]) - float(t[2])) < 0.11 for k, t in TALLIES.items())


def test_distance_counts_code_points(spark):
    d = spark.createDataFrame([("é", "e"), ("漢字", "漢"), ("", "abc"), (None, "a"), ("a b|\tc", "abc"), ("a\nb", "ab"), ("　", "")], "g string, w string")
    got = d.select(x.error_rate(x.normalise(F.col("g")), x.normalise(F.col("w"))).alias("r")).collect()
    assert [r.r for r in got] == [1, 1, 1, 1, 0, 0.5, 1]


def test_tidy_and_names(spark):
    d = spark.createDataFrame([(" \n\ta\r\nb\f\v c \n",), ("   ",), (None,)], "t string")
    assert [r[0] for r in d.select(x.tidy(F.col("t"))).collect()] == ["a  | b   c", "", ""]
    p = spark.createDataFrame([("/a.b/c_1x2.bgr888",), ("x.y.z",), ("plain",)], "p string")
    assert [r[0] for r in p.select(x.screen_name(F.col("p"))).collect()] == ["c_1x2", "x.y", "plain"]
    s = spark.createDataFrame([(0.005,), (0.994999,), (0.995,), (0.0,)], "s double")
    assert [r[0] for r in s.select(x.confidence(F.col("s"))).collect()] == [1, 99, 100, 0]
    assert [r[0] for r in s.select(x.score_text(F.col("s"))).collect()] == ["0.005", "0.994", "0.995", "0.000"]


def test_best_engine_takes_the_first_of_equals(spark):
    rows = [("s", 1, "other_x2", 3, 0.2, True), ("s", 1, "other", 2, 0.2, False), ("s", 1, "own", 0, 0.0, True), ("s", 2, "other_x3", 4, 0.1, True)]
    d = spark.createDataFrame([(*r, 5.0, "c") for r in rows], "screen string, region_id int, engine string, engine_ord int, cer double, match boolean, ms double, category string")
    best = {r.region_id: (r.engine, r.engine_ord, r.match, r.ms) for r in E.best_reads(d).collect()}
    assert best == {1: ("other_best", 2, False, 0.0), 2: ("other_best", 4, True, 0.0)}
    groups = {(r.engine, r.group): r.n for r in E.tally_by_engine(d.unionByName(E.best_reads(d))).collect()}
    assert groups["other_best", "all"] == 2 and groups["own", "screen s"] == 1 and groups["other", "category c"] == 1
    assert E.engines(spark).count() == 6


def test_report_fields(spark):
    report = '  Det      : 12.5 ms  (std 0.0)\n    [ 0] score=0.5 text="a b"  box=\n    [ 1] score=0.9 text="c"\nx [no]'
    r = spark.createDataFrame([(report,), ("nothing",)], "r string").select(x.report_det_ms(F.col("r")), x.report_texts(F.col("r")), x.report_pieces(F.col("r"))).collect()
    assert tuple(r[0]) == ("12.5", ["a b", "c"], 2) and tuple(r[1]) == ("NA", [], 0)


def test_empty_timings(spark):
    none = spark.createDataFrame([], "cycle int, metric string, value double")
    assert E.timing_summary(none, ["metric"]).count() == 0
    one = spark.createDataFrame([(0, "det", None), (1, "det", None)], "cycle int, metric string, value double")
    assert tuple(E.timing_summary(one, ["metric"]).first()) == ("det", 0.0, 0.0, 0)
    assert E.overall(spark.createDataFrame([], "match boolean, ms double")).first().ms_per_region == 0


def test_sinks_write(spark, scored, tmp_path):
    sinks.write_tsv(sinks.reads_table(scored).select("category", "match", "text"), str(tmp_path / "reads"))
    back = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "reads"))
    assert back.count() == len(READS) and back.columns == ["category", "match", "text"]
    sinks.write_csv(E.sweep_grid(spark, ["a"], [0.2], [0.3, 0.4], [1.0]), str(tmp_path / "grid"))
    assert spark.read.option("header", True).csv(str(tmp_path / "grid")).count() == 2


def test_printed_digits_follow_the_binary_value(spark):
    values = [0.475, 0.125, 0.375, 0.005, 1.005, 2.5, 0.0, 12.345, 487.5, 0.9995, 0.999, 1e-9, 3.0, 99999.95]
    d = spark.createDataFrame([(v,) for v in values], "v double")
    for places in (1, 2, 3):
        assert [r[0] for r in d.select(x.fixed(F.col("v"), places)).collect()] == [f"{v:.{places}f}" for v in values]
