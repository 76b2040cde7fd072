from pyspark.sql import functions as F

from gridsignal.llm import mixing


def test_quotas_of_many_sources_are_split_whole(spark):
    """20,000 sources: a node's list stands once, not beside each of its sources."""
    quotas = spark.range(20_000).select(F.format_string("s%06d", "id").alias("source"), (F.col("id") % 7).alias("quota"))
    got = mixing.split_quotas(quotas, 4, 11)
    per = got.groupBy("source").agg(F.sum("n_draws").alias("n")).join(quotas, "source")
    assert per.filter("n <> quota").isEmpty() and per.count() == 20_000
    shards = {r["shard"]: r["n"] for r in got.groupBy("shard").agg(F.sum("n_draws").alias("n")).collect()}
    total = quotas.agg(F.sum("quota")).first()[0]
    assert sum(shards.values()) == total and max(shards.values()) - min(shards.values()) <= 2
    again = mixing.split_quotas(quotas.repartition(7), 4, 11)
    assert got.exceptAll(again).isEmpty()
