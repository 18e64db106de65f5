"""What Spark may broadcast by a wrong guess of its size."""

import corpus_pipeline
from cinderpath.llm import near_dedup

BASE = " ".join(f"word{i} and more{i % 7}" for i in range(60))


def test_exploded_keys_are_not_broadcast(spark, monkeypatch):
    """Spark counts the array of a class' 91 keys as one element, so that it would build the exploded table at the driver."""
    plans = {}

    def recorded(df, label, **options):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return written(df, label, **options)

    written = near_dedup.written
    monkeypatch.setattr(near_dedup, "written", recorded)
    docs = spark.createDataFrame([(1, BASE), (2, BASE.replace("word5 ", "changed ")), (3, "something else")], "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(docs).collect()}
    assert found == {1: 1, 2: 1, 3: 3}
    assert "Generate explode" in plans["buckets"] and "SortMergeJoin" in plans["buckets"] and "Broadcast" not in plans["buckets"]


def test_stage_of_near_copies_broadcasts_no_exploded_keys(spark, monkeypatch, tmp_path):
    """The same in the pipeline: with its shingles of five words and the columns of ``documents``."""
    plans = []
    written = near_dedup.written
    monkeypatch.setattr(near_dedup, "written", lambda df, label, **options: (label == "buckets" and plans.append(df._jdf.queryExecution().executedPlan().toString()), written(df, label, **options))[1])
    docs = spark.createDataFrame([(1, BASE, "en"), (2, BASE, "en"), (3, "something else", "en")], "doc_id long, text string, lang string")
    left = dict(corpus_pipeline.STAGES)["near_copies"](spark, docs, str(tmp_path))
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 3]
    assert len(plans) == 1 and "Generate explode" in plans[0] and "Broadcast" not in plans[0]
