"""Maximum-weight matching of two sides by an auction, in rounds of joins.

Every node without partner bids for the partner that is worth most to it after prices; a partner goes to its highest bid and
its price rises to it. That both sides may stay alone is expressed by a second copy of the table with its sides swapped, and a
link of weight 0 between a node and its own copy: then a perfect matching exists, and its weight is twice the best matching's.
Weights are whole numbers and are multiplied by the number of nodes plus one, so an auction whose last increment is 1 is
exact; earlier ones with larger increments only bring the prices near (epsilon scaling).

A round is two groupings and a join of the links with the prices; nothing is collected but counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridsignal.session import written

#: The increment falls by this factor from one auction to the next.
FALL = 8


def doubled(links: DataFrame) -> DataFrame:
    """bidder, item, w of the table, of its copy with sides swapped, and of the links between nodes and their copies."""
    named = links.select(F.struct(F.lit(0).alias("side"), F.col("i").cast("long").alias("id")).alias("a"), F.struct(F.lit(1).alias("side"), F.col("j").cast("long").alias("id")).alias("b"), F.col("n").cast("long").alias("w"))
    # bidders are all nodes, items are all nodes' copies; an item (1, j) is j itself, (0, i) the copy of i
    there = named.select(F.col("a").alias("bidder"), F.col("b").alias("item"), "w")
    back = named.select(F.col("b").alias("bidder"), F.col("a").alias("item"), "w")
    alone = there.select("bidder").union(back.select("bidder")).distinct().select("bidder", F.col("bidder").alias("item"), F.lit(0).cast("long").alias("w"))
    return there.unionByName(back).unionByName(alone)


def auction(links: DataFrame, prices: DataFrame, step: int, most: int) -> DataFrame:
    """item, price, bidder: a perfect matching whose weight is within ``step`` a node of the best."""
    bidders = links.select("bidder").distinct()
    now = written(prices.select("item", "price", F.lit(None).cast("struct<side:int,id:long>").alias("bidder")))
    ranks = Window.partitionBy("bidder").orderBy(F.desc("value"), "item")
    while True:
        free = bidders.join(now.select("bidder").filter("bidder IS NOT NULL"), "bidder", "left_anti")
        values = links.join(free, "bidder").join(now.select("item", "price"), "item").select("bidder", "item", "price", (F.col("w") - F.col("price")).alias("value"))
        two = values.withColumn("rank", F.row_number().over(ranks)).filter("rank <= 2").groupBy("bidder").agg(*[F.max(F.when(F.col("rank") == r, F.col(c))).alias(f"{c}{r}") for r, c in ((1, "value"), (2, "value"))], F.max(F.when(F.col("rank") == 1, F.struct("item", "price"))).alias("best"))
        bids = two.select("best.item", "bidder", (F.col("best.price") + F.col("value1") - F.coalesce("value2", F.col("value1") - most) + step).alias("bid"))
        won = written(bids.groupBy("item").agg(F.max("bid").alias("bid"), F.max_by("bidder", F.struct("bid", "bidder")).alias("by")))
        if won.isEmpty():
            return now
        now = written(now.join(won, "item", "left").select("item", F.coalesce("bid", "price").alias("price"), F.coalesce("by", "bidder").alias("bidder")))


def best_matching(links: DataFrame) -> DataFrame:
    """(i, j, n): links of a matching of largest total weight among ``links`` (i, j, n: one row a pair, whole n > 0)."""
    links = written(links.filter("n > 0 AND i IS NOT NULL AND j IS NOT NULL").select("i", "j", "n"))
    table = doubled(links)
    size = table.agg(F.count_distinct("bidder").alias("nodes"), F.max("w").alias("most")).first()
    if not size["nodes"]:
        return links
    scale = size["nodes"] + 1
    table = written(table.withColumn("w", F.col("w") * scale))
    most = 2 * size["most"] * scale + 1
    step = max(1, size["most"] * scale // FALL)
    now = table.select("item").distinct().withColumn("price", F.lit(0).cast("long"))
    while True:
        now = auction(table, now, step, most)
        if step == 1:
            break
        step = max(1, step // FALL)
    pairs = now.filter("bidder.side = 0 AND item.side = 1").select(F.col("bidder.id").alias("_i"), F.col("item.id").alias("_j"))
    return links.join(pairs, (F.col("i").cast("long") == F.col("_i")) & (F.col("j").cast("long") == F.col("_j"))).select("i", "j", "n")
