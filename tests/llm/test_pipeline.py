from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.cases import SF, documents, near_groups, texts_of
from tests.llm.test_decontamination import brute as contaminated
from tests.llm.test_templates import brute as repeated
from wrenchline.llm.quality import quality_scores, train_quality


def test_stages_in_turn(spark, tmp_path):
    """Each stage against its own yardstick, on what its predecessor kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = train_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r["doc_id"]: r["score"] for r in quality_scores(docs, model).collect()}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_dedup", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = texts_of(docs)
        columns = docs.columns
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "packing":
            lengths = docs.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
            assert {r["doc_id"] for r in lengths} == set(before)
            continue
        assert docs.columns == columns
        after = texts_of(docs)
        if name == "quality":
            assert set(after) == {i for i, s in scores.items() if s >= 0.3}
            assert all(before[i] == t for i, t in after.items())
        elif name == "line_dedup":
            gone = repeated(before)
            for i, text in before.items():
                left = "\n".join(x for x in (text or "").split("\n") if x not in gone[i]).rstrip("\n") if gone[i] else text
                assert after.get(i, "").rstrip("\n") == (left or "").rstrip("\n")
        elif name == "near_dedup":
            _, groups = near_groups(before)
            assert after == {i: t for i, t in before.items() if groups[i] == i}
        else:
            hits = contaminated(before, items)
            assert all((before[i] == after[i]) == (hits[i][1] == 0) for i in before)
            assert not any(n for _, n, _ in contaminated(after, items).values())


def test_run_gives_the_packed_pieces(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.count() > 0


def test_stages_take_empty_tables(spark):
    docs = documents(spark, ["x"]).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
