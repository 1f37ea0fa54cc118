"""Every operator and stage on awkward rows and on an empty table."""
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corridor.llm import (embedding_dedup, license_scan, line_dedup, maxent_lm, minhash, mixing, packing,
                          quality_classifier, quality_rules, secret_scan)


def _labels(df):
    return df.select("doc_id", F.lit(1).alias("quality")).union(df.select("doc_id", F.lit(None).cast("int")))


def _lm(df):
    m = maxent_lm.LanguageModel(df, F.lit(True))
    m.train()
    return m.docs.join(m.scores(), "k")


ROWWISE = {
    "quality_classifier": lambda d: quality_classifier.classify(d, _labels(d), F.lit(True), n_features=16),
    "line_dedup": line_dedup.line_dedup,
    "license_scan": license_scan.scan,
    "minhash": lambda d: minhash.NearDuplicates(d).result(),
    "quality_rules": quality_rules.quality_rules,
    "maxent_lm": _lm,
    "mixing": lambda d: mixing.Mix(d).taken(),
    "secret_scan": lambda d: secret_scan.scan(d, secret_scan.fit(d)),
}


@pytest.mark.parametrize("name", ROWWISE)
def test_one_row_for_each(name, edge, empty):
    got = ROWWISE[name](edge)
    rows = got.collect()
    assert len(rows) == edge.count()
    assert ROWWISE[name](empty).collect() == []


def test_extra_columns_pass_through(edge):
    for f in (quality_rules.quality_rules, line_dedup.line_dedup):
        own = set(f(edge.select("doc_id", "text")).columns)
        got = f(edge)
        assert set(edge.columns) <= set(got.columns)
        keep = [c for c in edge.columns if c not in own]
        assert sorted(map(str, got.select(keep).collect())) == sorted(map(str, edge.select(keep).collect()))


def test_pack_edges(edge, empty):
    got = packing.pack(edge).collect()
    assert len({(r["doc_id"]) for r in got}) == edge.select("doc_id").distinct().count()
    assert packing.pack(empty).collect() == []
    assert sorted(r["length"] for r in got if r["doc_id"] in (1, 2, 9)) == [1, 1, 1]


def test_stages(spark, edge, empty):
    for docs in (edge, empty):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, docs, "")
            got.collect()
            if name != "packing":
                assert got.columns == list(corpus_pipeline.COLUMNS)


def test_embedding_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [inf, 0.0], 1),
            (7, [nan, 0.0], 1), (8, [None, 1.0], 1), (9, [1.0, 0.0], 1), (9, [1.0, 0.0], 1), (10, [1.0, 0.0, 0.0], 1),
            (11, [], 1), (12, [1.0, 0.0], 2), (None, [0.0, 1.0], 1)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<float>, label int, node int")
    got = sorted(((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0) for r in embedding_dedup.links(df).collect()))
    alone = [(i, 0, i) for i in (0, 3, 4, 5, 6, 7, 8, 10, 11, 12)]
    assert got == sorted(alone + [(1, 3, 1), (2, 3, 1), (9, 3, 1), (9, 3, 1)])
    assert embedding_dedup.links(df.limit(0)).collect() == []
