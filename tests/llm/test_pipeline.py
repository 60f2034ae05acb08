import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from framelake.llm import quality
from framelake.llm.queries import queries
from framelake.llm.shared import table

from .helpers import components, docs, rows
from .test_dedup import _brute_print
from .test_mix_and_pack import _size, _targets


@pytest.fixture(scope="module", params=["driver", "awkward"])
def inputs(request, spark, tmp_path_factory, small):
    if request.param == "driver":
        return small
    folder = tmp_path_factory.mktemp("tables")
    docs(spark, rows(9, 80)).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 7 > 0, None) for i in range(0, 80, 2)], "doc_id long, q boolean, toxic int").select("doc_id", F.col("q").cast("int").alias("quality"), "toxic").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def stages(spark, inputs, tmp_path_factory):
    """The documents, then each stage's rows, written and read as the driver does."""
    folder = tmp_path_factory.mktemp("stages")
    out = [table(spark, inputs, "documents")]
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, out[-1], inputs).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return out


def _rows(df):
    return [r.asDict() for r in df.collect()]


def test_stages_are_named_in_order():
    assert [n for n, _ in P.STAGES] == ["quality", "exact_dedup", "near_dedup", "source_mix", "packing"]
    assert P.ORACLE_SQL is None


def test_all_but_the_last_keep_the_columns(stages):
    for s in stages[1:-1]:
        assert s.dtypes == stages[0].dtypes


def test_quality_drops_what_the_classifier_rejects(spark, stages, inputs):
    before = stages[0]
    w = quality.fit(before, table(spark, inputs, "labels"))
    kept = before.filter(quality.score_column(before, w, F.col("text")) >= quality.THRESHOLD)
    assert sorted(map(str, kept.collect())) == sorted(map(str, stages[1].collect()))


def test_exact_stage_keeps_one_of_each_group(stages):
    groups = defaultdict(list)
    for r in _rows(stages[1]):
        groups[re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")].append((-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0))
    want = sorted(min(m)[1:] for m in groups.values())
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in _rows(stages[2])) == want


def test_near_stage_keeps_one_of_each_component(stages):
    data = _rows(stages[2])
    prints = [_brute_print(r["text"]) for r in data]
    roots = components(len(data), [(i, j) for i in range(len(data)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= P.NEAR_RADIUS])
    best = defaultdict(list)
    for r, root in zip(data, roots, strict=True):
        best[root].append((r["doc_id"] is None, r["doc_id"] or 0))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in _rows(stages[3])) == sorted(min(m) for m in best.values())


def test_mix_stage_meets_its_targets(stages):
    sizes, own, taken, by_doc = Counter(), Counter(), Counter(), Counter()
    for r in _rows(stages[3]):
        sizes[r["source"]] += _size(r["text"])
        own[r["doc_id"]] += _size(r["text"])
    for r in _rows(stages[4]):
        taken[r["source"]] += _size(r["text"])
        by_doc[r["doc_id"]] += _size(r["text"])
    for s, t in _targets(dict(sizes)).items():
        assert abs(taken[s] - t) <= max(64, 0.01 * t)
    assert all(by_doc[k] <= 3 * own[k] for k in by_doc)


def test_packing_stage_holds_every_row(stages):
    pieces = _rows(stages[5])
    bins = defaultdict(list)
    for p in pieces:
        bins[p["sequence_id"]].append((p["offset"], p["length"]))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(p["piece"] == 0 for p in pieces) == stages[4].count()
    assert len(bins) <= 1.1 * sum(p["length"] for p in pieces) / 1024 + 1


def test_run_gives_the_last_stage(spark, inputs, stages):
    key = lambda df: sorted(map(str, df.select("doc_id", "piece", "start", "length", "ids_crc32").collect()))
    assert key(P.run(spark, inputs)) == key(stages[-1])


def test_empty_documents(spark, inputs):
    none = table(spark, inputs, "documents").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, none, inputs).count() == 0


@pytest.mark.parametrize("name", sorted(queries()))
def test_registered_queries_run(spark, small, name):
    assert queries()[name](spark, small).count() > 0
