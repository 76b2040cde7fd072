from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridsignal.llm import mixing, sharding


def plain_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_buckets_match_the_definition():
    keys = np.random.default_rng(0).integers(0, 1 << 64, 500, dtype=np.uint64)
    for n in (1, 2, 8, 9, 100):
        assert sharding.jump_buckets(keys, n).tolist() == [plain_jump(int(k), n) for k in keys]


def test_op8(spark, docs, corpus, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sharding.op8_jump_hash_sharding(spark, str(tmp_path)).collect()
    assert len(got) == docs.count()
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 8)
        text = None if r["doc_id"] is None else corpus[r["doc_id"]]
        if r["doc_id"] is not None:
            assert r["size"] == len((text or "").encode()) + 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_keep_extra_columns(spark, docs, no_docs):
    assert sharding.shard_rows(docs, ["doc_id"], 5, "to").columns == [*docs.columns, "to"]
    assert sharding.shard_rows(no_docs, ["doc_id"], 5, "to").isEmpty()
    with pytest.raises(ValueError):
        sharding.jump_hash(F.col("doc_id"), 0)


def plain_targets(size, weight, share, cap):
    left, target, free = share * sum(size.values()), {}, set(size)
    while True:
        total = sum(weight[s] for s in free)
        level = {s: left * weight[s] / total for s in free}
        over = {s for s in free if level[s] > cap * size[s]}
        if not over:
            return target | level
        for s in over:
            target[s] = cap * size[s]
            left -= target[s]
        free -= over


def test_op7(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.op7_source_mixing(spark, str(tmp_path)).collect()
    again = mixing.op7_source_mixing(spark, str(tmp_path)).collect()
    assert sorted(got, key=str) == sorted(again, key=str) and len(got) == docs.count()
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    names = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    expected = plain_targets(size, weight, 1.5, 2)
    for s in names:
        assert target[s] == pytest.approx(expected[s])
        assert abs(taken[s] - target[s]) <= 64


def test_shard_quotas_add_up_and_draws_are_disjoint(spark):
    sizes = spark.range(500).select(F.col("id").alias("row_key"), F.concat(F.lit("s"), (F.col("id") % 4).cast("string")).alias("source"), (F.col("id") % 50 + 100).alias("size"))
    quotas, pieces = mixing.mix(sizes, [3.0, 1.0], 1.2, n_shards=5)
    drawn = mixing.draws(quotas, mixing.split_quotas(quotas, 5, 7), 7).collect()
    quota = {r["source"]: r["quota"] for r in quotas.collect()}
    assert Counter(r["source"] for r in drawn) == quota
    assert len({(r["source"], r["block"], r["epoch"]) for r in drawn}) == len(drawn)
    by_shard = Counter(r["shard"] for r in drawn)
    assert max(by_shard.values()) - min(by_shard.values()) <= 3
    assert pieces.groupBy("row_key", "epoch", "start").count().filter("count > 1").isEmpty()


def test_empty_table_and_documents(spark, docs, no_docs):
    sizes = no_docs.selectExpr("doc_id AS row_key", "source", "n_chars AS size")
    assert mixing.mix(sizes, [1.0], 1.5)[1].isEmpty()
    few = docs
    out = mixing.mixed_documents(few, [3.0, 1.0, 2.0], 1.5)
    assert out.columns == few.columns and mixing.mixed_documents(no_docs, [1.0], 1.5).isEmpty()
    words = out.select(F.sum(mixing.word_count(F.col("text")))).first()[0]
    total = few.select(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert words == pytest.approx(1.5 * total, rel=0.02)
    assert out.filter("n_chars <> length(text)").isEmpty()
