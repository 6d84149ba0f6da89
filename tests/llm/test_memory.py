"""What queries leave in the driver's and the workers' memory."""

import random

from pyspark.sql import functions as F

from scorecast.llm import minhash, packing
from scorecast.llm.components import connected_components
from scorecast.llm.queries import tokenizer_path


def _tasks(spark, group: str) -> int:
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return sum(info.numCompletedTasks for s in stages if (info := tracker.getStageInfo(s)))


def test_rounds_of_few_edges_are_few_tasks_at_many_shuffle_partitions(spark):
    """A chain and a hub; the driver keeps a record of every task."""
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 200)]
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("few-edges", "few-edges")
        got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
        tasks = _tasks(spark, "few-edges")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {k: 0 for k in range(1, 41)} | {k: 100 for k in range(101, 200)}
    assert tasks < 64 * 20, tasks


def test_packing_reads_no_merge_rules_and_keeps_few_words(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(10 ** 9)}" for _ in range(300)) for _ in range(20)]
    path = tokenizer_path()
    packing._encoder.cache_clear()
    packing.bpe.vocabulary.cache_clear()
    whole = [x.tolist() for x in packing.document_ids(texts, path)]
    _, vocab, cache = packing._encoder(path)
    assert "ranks" not in vars(vocab) and "made" not in vars(vocab)
    assert packing.KEEP_WORDS <= 100_000
    cache.clear()
    monkeypatch.setattr(packing, "KEEP_WORDS", 500)
    assert [x.tolist() for x in packing.document_ids(texts[:1], path)] == whole[:1]
    assert [x.tolist() for x in packing.document_ids(texts[1:2], path)] == whole[1:2]
    assert len(cache) <= 500
    cache.clear()


def test_large_copies_groups_are_still_one_component(spark):
    words = [f"word{k}" for k in range(60)]
    rows = [(k, " ".join(words)) for k in range(30)] + [(100 + k, " ".join([*words, f"tail{k}"])) for k in range(30)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.select(F.min("component_id"), F.max("component_id"), F.sum(F.col("kept").cast("int"))).first()[:] == (0, 0, 1)
