"""Every operator and stage on awkward, crowded and empty tables."""

import pytest
from conftest import ROWS

import corpus_pipeline
from turnledger.llm import (
    exact_dedup,
    language_id,
    license_scan,
    lm_scoring,
    mixing,
    ngram_jaccard,
    packing,
    quality,
    sharding,
    topk_search,
)

BY_ROW = {
    "mix": mixing.mix_sources,
    "licenses": license_scan.scan_licenses,
    "quality": quality.classify,
    "jaccard": ngram_jaccard.ngram_jaccard,
    "dedup": exact_dedup.exact_dedup,
    "lm": lm_scoring.score_texts,
    "shards": sharding.shard_documents,
    "language": language_id.identify,
}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def ids(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in df.select("doc_id").collect())


ALL_IDS = sorted((r[0] is None, r[0] or 0) for r in ROWS)


@pytest.mark.parametrize("name", BY_ROW)
def test_one_row_per_document(name, awkward):
    assert ids(BY_ROW[name](awkward)) == ALL_IDS


@pytest.mark.parametrize("name", BY_ROW)
def test_extra_columns_change_nothing(name, awkward, crowded):
    plain, other = BY_ROW[name](awkward), BY_ROW[name](crowded)
    assert plain.columns == other.columns
    if name not in ("lm", "quality"):  # their floating sums depend on the order of rows
        assert rows(plain) == rows(other)
    else:
        assert ids(other) == ALL_IDS


@pytest.mark.parametrize("name", [*BY_ROW, "pack"])
def test_empty_table(name, nothing):
    operator = packing.pack_documents if name == "pack" else BY_ROW[name]
    out = operator(nothing)
    assert out.columns and out.count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, name, stage, awkward, crowded, nothing):
    out = stage(spark, crowded, "")
    if name != "pack":
        assert out.columns == crowded.columns
        assert {r["shard"] for r in out.collect()} <= {"extra"}
    assert stage(spark, nothing, "").count() == 0
    kept = ids(out)
    if name == "language_id":
        assert (False, 3) not in kept and (False, 9) not in kept and (False, 6) in kept
    if name == "exact_dedup":
        # 3, 4, 5 and the row of nulls are empty; 1 and 2 and the two French rows are equal.
        assert [k for k in kept if k[1] in (1, 2)] == [(False, 2)]
        assert len(kept) == len(ROWS) - 3 - 2 - 1
        assert (False, 13) in kept
    if name == "ngram_jaccard":
        assert (False, 7) not in kept and (False, 8) not in kept and (False, 6) in kept
        assert kept.count((False, 1)) == 1 and {(False, 3), (False, 4), (False, 5)} <= set(kept)


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and "sequence_id" in out.columns


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [
        (0, [1.0, 2.0], "a"), (1, [1.0, 2.0], "b"), (2, [1.0, 2.0], "b"), (2, [1.0, 2.0], "b"),
        (3, None, None), (4, [nan, 1.0], None), (5, [inf, 1.0], None), (6, [None, 1.0], None),
        (None, [0.5, 0.5], "c"), (7, [], "c"), (8, [3.0], "c"), (9, [1e30, 1e30], "c"), (100, [-1.0, 0.25], "c"),
    ]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<double>, score string")
    got = [tuple(r) for r in topk_search.search(vectors).orderBy("query_id", "rank").collect()]
    first = [r for r in got if r[0] == 0]
    assert [r[2] for r in first] == [9, 1, 2, 2, 8, None, 7, 100]
    assert first[0][3] == 2**63 - 1 and first[1][3] == 1024 * 1024 * 5
    assert len([r for r in got if r[0] == 100]) == 8
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert topk_search.search(none).count() == 0
