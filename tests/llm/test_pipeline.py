import hashlib
import random
from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lorekeel.llm import quality_rules

from .helpers import DOCS, components, normal, rows, shingles, tokenizer
from .test_rules_and_mix import brute_scores, spark_hash


def test_stages_against_brute_force(spark, smoke_dir, tmp_path):
    docs = spark.read.parquet(f"{smoke_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, smoke_dir).write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        kept[name] = docs.collect()
        assert number == 4 or docs.columns == columns
    first = [normal(r["text"]) for r in kept["quality rules"]]
    assert Counter(normal(r["text"]) for r in kept["exact dedup"]) == Counter(set(first))
    before = sorted(kept["exact dedup"], key=lambda r: r["doc_id"])
    roots = components([shingles(r["text"]) for r in before])
    assert {r["doc_id"] for r in kept["near dedup"]} == {before[i]["doc_id"] for i in set(roots)}
    assert {r["doc_id"] for r in kept["mixing"]} <= {r["doc_id"] for r in kept["near dedup"]}
    assert max(Counter(r["doc_id"] for r in kept["mixing"]).values()) <= 3
    library = Tokenizer.from_file(tokenizer())
    texts = {r["doc_id"]: r["text"] for r in kept["mixing"]}
    assert len(kept["bpe codec"]) == len(kept["mixing"])
    for r in kept["bpe codec"]:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_run_over_awkward_rows_and_empty_tables(spark, tmp_path):
    """Nulls in every column, ties, repeated rows, clashing names: the run equals its stages, and an empty table gives nothing."""
    labels = "doc_id long, quality int, toxic int"
    for name, data, known in (("some", rows(), [(i, 1, 0) for i in range(20)] + [(None, None, None)]), ("none", [], [])):
        spark.createDataFrame(data, DOCS).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(known, labels).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        docs = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, f"{tmp_path}/{name}").write.parquet(f"{tmp_path}/{name}-{number}")
            docs = spark.read.parquet(f"{tmp_path}/{name}-{number}")
        assert sorted(map(str, got)) == sorted(map(str, docs.collect()))
        assert bool(got) == bool(data)


def test_threshold_of_the_quality_stage_is_of_all_trusted_documents(spark, tmp_path, monkeypatch):
    """The stage is given no bound: its threshold is that of all 4500 labels, and its verdicts follow it."""
    rng = random.Random(23)
    names = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(names[: rng.randint(40, 400)], k=rng.randint(50, 56))) for _ in range(4600)]
    trusted = list(range(4500))
    scores, want = brute_scores(texts, trusted, {i: spark_hash(i, spark_hash("fold")) % quality_rules.FOLDS for i in trusted})
    spark.createDataFrame([(i, t, *[None] * 7) for i, t in enumerate(texts)], DOCS).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in trusted], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found, made = [], quality_rules.held_out_threshold
    monkeypatch.setattr(quality_rules, "held_out_threshold", lambda *given: found.append(made(*given)) or found[-1])
    kept = {r["doc_id"] for r in corpus_pipeline.quality(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()}
    assert found == [pytest.approx(want, abs=1e-6)]
    for i, score in enumerate(scores):  # a ratio that lies between two whole numbers may be rounded either way
        assert (i in kept) == (score >= want) or abs(score - want) < 1e-4


def test_small_tables_take_few_tasks(spark, tmp_path):
    """The driver keeps metrics of every task: small results are not exchanged once more to be written, nor sorted to be collected."""
    spark.createDataFrame(rows(), DOCS).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    held = {"spark.sql.shuffle.partitions": "20", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, sc, took = {k: spark.conf.get(k) for k in held}, spark.sparkContext, {}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        for stage in (corpus_pipeline.quality, corpus_pipeline.near, corpus_pipeline.mixture):
            sc.setJobGroup(f"few-{stage.__name__}", "")
            stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).write.parquet(f"{tmp_path}/{stage.__name__}")
            sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
            seen = sc.statusTracker()
            ids = {i for job in seen.getJobIdsForGroup(f"few-{stage.__name__}") for i in seen.getJobInfo(job).stageIds}
            took[stage.__name__] = sum(info.numCompletedTasks for i in ids if (info := seen.getStageInfo(i)))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert took["quality"] <= 300 and took["near"] <= 600 and took["mixture"] <= 360, took  # 418, 735 and 420 with those exchanges
