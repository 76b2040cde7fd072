"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree. DataFrame functions only.

A source's words, taken in a hashed order of its documents, are cut into blocks of equal length. The targets give each
source a quota of block draws. The quotas are split among the output shards by a binary tree: at each node the left
half receives a multivariate-hypergeometric draw of the node's quotas, the right half the rest, so the shards' quotas
add up exactly. A shard's draws of a source are a range of that source's permuted draws; ranges are disjoint, and a
block is drawn a second time only after every block has been drawn once. Rows are shuffled within a shard only.

All numbers come from hashes of the seed, so reruns agree. One source may hold most rows: positions inside a source
are summed in hashed groups, and draws meet documents on (source, block).

Defined results: a null text has no words and is never taken; null is a source of its own, last in order; a source
without words has target 0; repeated rows are separate documents; an empty table gives no rows; extra columns are
carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridsignal.session import ensure_checkpoint_dir

#: Words between these: space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
#: A source has at most so many blocks, and blocks have at least so many words.
MAX_BLOCKS, MIN_BLOCK_WORDS = 4096, 64
#: Documents of a source are placed in so many groups at once.
PLACE_GROUPS = 256


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) that depends on the parts only."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights: list[float], share: float, max_epochs: float) -> DataFrame:
    """One row for each source: source, source_size, target.

    ``weights`` repeat over the sources in code-point order, null last. The budget is ``share`` of all words. No
    target exceeds ``max_epochs`` times its source; what stands above is shared again by weight. The final targets are
    min(cap, level x weight); the level follows from one pass over the sources by cap / weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    # one row for each source from here on, not for each document
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), F.col("source"))
    at = F.row_number().over(order) - 1
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at % len(weights) + 1).cast("int"))
    per = per.withColumn("_w", pick).withColumn("_cap", F.col("source_size") * float(max_epochs))
    whole = Window.partitionBy(F.lit(0))
    rising = whole.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), F.col("source"))
    upto = rising.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_budget", F.sum("source_size").over(whole) * float(share))
    per = per.withColumn("_level", (F.col("_budget") - F.coalesce(F.sum("_cap").over(upto), F.lit(0.0))) / (F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(upto), F.lit(0.0))))
    # the first source whose cap is not reached at its level sets the level of all later ones
    per = per.withColumn("_rank", F.row_number().over(rising))
    free = F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct("_rank", "_level"))).over(whole)["_level"]
    return per.select("source", "source_size", F.least(F.col("_cap"), F.coalesce(free, F.lit(float("inf"))) * F.col("_w")).alias("target"))


def block_quotas(targets: DataFrame) -> DataFrame:
    """Add block_words, n_blocks and quota (draws, at most max_epochs x n_blocks)."""
    words = F.greatest(F.lit(MIN_BLOCK_WORDS), F.ceil(F.col("source_size") / MAX_BLOCKS)).cast("long")
    out = targets.withColumn("block_words", words).withColumn("n_blocks", F.ceil(F.col("source_size") / F.col("block_words")).cast("long"))
    mean_words = F.col("source_size") / F.col("n_blocks")
    return out.withColumn("quota", F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") / mean_words), F.ceil(F.col("target") / F.col("source_size")) * F.col("n_blocks"))).otherwise(0).cast("long"))


def hypergeometric(quota: Column, left: Column, total: Column, *seed: Column) -> Column:
    """How many of ``quota`` draws fall on the left ``left`` of ``total`` places: one urn trial for each draw.

    A quota has at most MAX_BLOCKS times the epochs, so the loop is bounded whatever the data hold.
    """
    start = F.struct(left.cast("double").alias("l"), total.cast("double").alias("t"), F.lit(0).cast("long").alias("x"))

    def trial(acc: Column, i: Column) -> Column:
        hit = F.when(uniform(*seed, i) * acc["t"] < acc["l"], 1).otherwise(0)
        return F.struct((acc["l"] - hit).alias("l"), (acc["t"] - 1).alias("t"), (acc["x"] + hit).cast("long").alias("x"))

    steps = F.when(quota > 0, F.sequence(F.lit(1).cast("long"), quota)).otherwise(F.array().cast("array<long>"))
    return F.aggregate(steps, start, trial, lambda acc: acc["x"])


def split_quotas(quotas: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """Rows (source, shard, n_draws, first_draw): the quotas of each source, split by the tree.

    Each level halves every node's shards. The node's left size is its share of the node's draws; sources are drawn one
    after the other, each from what the earlier ones left, which is the multivariate-hypergeometric law.
    """
    depth = max(0, (n_shards - 1).bit_length())
    node = quotas.select("source", F.col("quota").alias("n"), F.lit(0).alias("lo"), F.lit(n_shards).alias("hi"))
    for _ in range(depth):
        split = F.floor((F.col("lo") + F.col("hi") + 1) / 2).cast("int")
        node = node.withColumn("mid", F.when(F.col("hi") - F.col("lo") > 1, split).otherwise(F.col("hi")))
        # one array of all sources a node, one row a source in it
        items = F.sort_array(F.collect_list(F.struct(F.col("source").isNull().alias("z"), F.col("source").alias("source"), F.col("n").alias("n"))))
        per_node = node.groupBy("lo", "hi", "mid").agg(items.alias("items"))
        total = F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + x["n"])
        left = F.round(total * (F.col("mid") - F.col("lo")) / (F.col("hi") - F.col("lo"))).cast("long")
        per_node = per_node.withColumn("total", total).withColumn("left", left)
        first = F.struct(F.col("left").alias("l"), F.col("total").alias("t"), F.array().cast("array<bigint>").alias("xs"))

        def draw(acc: Column, item: Column) -> Column:
            # all of a node with one half only stays left
            x = F.when(acc["l"] >= acc["t"], item["n"]).otherwise(hypergeometric(item["n"], acc["l"], acc["t"], F.lit(seed), F.col("lo"), F.col("hi"), F.coalesce(item["source"], F.lit("\x00null"))))
            return F.struct((acc["l"] - x).cast("long").alias("l"), (acc["t"] - item["n"]).cast("long").alias("t"), F.concat(acc["xs"], F.array(x.cast("long"))).alias("xs"))

        per_node = per_node.withColumn("xs", F.aggregate("items", first, draw, lambda acc: acc["xs"]))
        rows = per_node.select("lo", "hi", "mid", F.explode(F.arrays_zip("items", "xs")).alias("r"))
        rows = rows.select("lo", "hi", "mid", F.col("r.items.source").alias("source"), F.col("r.items.n").alias("n"), F.col("r.xs").alias("x"))
        halves = F.filter(
            F.array(F.struct(F.col("x").alias("n"), F.col("lo").alias("lo"), F.col("mid").alias("hi")), F.struct((F.col("n") - F.col("x")).alias("n"), F.col("mid").alias("lo"), F.col("hi").alias("hi"))),
            lambda h: h["hi"] > h["lo"],
        )
        node = rows.select("source", F.explode(halves).alias("h")).select("source", "h.n", "h.lo", "h.hi")
    before = Window.partitionBy("source").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    return node.select("source", F.col("lo").alias("shard"), F.col("n").alias("n_draws"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_draw"))


def draws(quotas: DataFrame, shards: DataFrame, seed: int) -> DataFrame:
    """Rows (source, block, epoch, shard, place): each draw of a block, its shard and its place in the shard's order.

    Draw number epoch x n_blocks + rank takes the block of that rank in the epoch's own permutation.
    """
    live = quotas.filter(F.col("quota") > 0)
    epochs = live.withColumn("epoch", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("quota") / F.col("n_blocks")) - 1).cast("int"))))
    blocks = epochs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    order = Window.partitionBy("source", "epoch").orderBy(F.xxhash64(F.lit(seed), F.col("source"), F.col("epoch"), F.col("block")), "block")
    blocks = blocks.withColumn("draw", F.col("epoch") * F.col("n_blocks") + F.row_number().over(order) - 1).filter(F.col("draw") < F.col("quota"))
    ranges = F.sort_array(F.collect_list(F.struct("first_draw", "n_draws", "shard")))
    table = shards.filter(F.col("n_draws") > 0).groupBy("source").agg(ranges.alias("ranges")).withColumnRenamed("source", "_source")
    placed = blocks.join(table, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    own = F.filter("ranges", lambda r: (r["first_draw"] <= F.col("draw")) & (F.col("draw") < r["first_draw"] + r["n_draws"]))
    return placed.select("source", "block", "epoch", own[0]["shard"].alias("shard"), F.xxhash64(F.lit(seed + 1), F.col("source"), F.col("draw")).alias("place"))


def place_documents(sizes: DataFrame, seed: int, groups: int = PLACE_GROUPS) -> DataFrame:
    """Add ``first_word``: where each document begins in its source's hashed order."""
    h = F.xxhash64(F.lit(seed + 2), F.col("row_key"))
    docs = sizes.withColumn("_h", h).withColumn("_group", F.pmod(h, F.lit(groups)).cast("int"))
    sums = docs.groupBy("source", "_group").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("source").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("_source"), F.col("_group").alias("_g"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("source", "_group").orderBy("_h", "row_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("_at", F.coalesce(F.sum("size").over(within), F.lit(0)))
    out = docs.join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_group") == F.col("_g")))
    return out.withColumn("first_word", F.col("_start") + F.col("_at")).drop("_h", "_group", "_source", "_g", "_start", "_at")


def mix(sizes: DataFrame, weights: list[float], share: float, max_epochs: float = 2.0, n_shards: int = 8, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The sources' table and the mix's pieces.

    ``sizes`` has row_key (any long that names a row), source and size. A piece is the part of a document that lies in
    one drawn block: row_key, source, epoch, shard, place, start (its first word in the document), length.
    """
    # one row for each source; written once, as several branches below read it
    quotas = block_quotas(source_targets(sizes, weights, share, max_epochs)).checkpoint()
    drawn = draws(quotas, split_quotas(quotas, n_shards, seed), seed)
    docs = place_documents(sizes.filter(F.col("size") > 0), seed)
    per = quotas.select(F.col("source").alias("_s"), "block_words")
    docs = docs.join(per, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    last = F.floor((F.col("first_word") + F.col("size") - 1) / F.col("block_words"))
    docs = docs.withColumn("block", F.explode(F.sequence(F.floor(F.col("first_word") / F.col("block_words")), last)))
    drawn = drawn.select(F.col("source").alias("_s"), F.col("block").alias("_b"), "epoch", "shard", "place")
    hit = docs.join(drawn, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b"))).drop("_s", "_b")
    lo = F.greatest(F.col("first_word"), F.col("block") * F.col("block_words"))
    hi = F.least(F.col("first_word") + F.col("size"), (F.col("block") + 1) * F.col("block_words"))
    pieces = hit.select("row_key", "source", "epoch", "shard", "place", (lo - F.col("first_word")).alias("start"), (hi - lo).alias("length"))
    return quotas, pieces


def measured(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """row_key, source and size of each row; written once, so that the texts are read once."""
    ensure_checkpoint_dir(docs.sparkSession)
    key = F.xxhash64(F.col(id_col), F.col("text"), F.col("source"))
    sizes = docs.select(F.col(id_col), F.col("source"), word_count(F.col("text")).alias("size"), key.alias("_k"))
    # repeated rows are told apart by their number among equals
    again = Window.partitionBy("_k", id_col).orderBy("size")
    sizes = sizes.withColumn("row_key", F.xxhash64(F.col("_k"), F.row_number().over(again))).drop("_k")
    return sizes.checkpoint()


def mixed_documents(docs: DataFrame, weights: list[float], share: float, max_epochs: float = 2.0, n_shards: int = 8, seed: int = 7) -> DataFrame:
    """The mix as documents: the columns of ``docs`` for each document and epoch in which words of it are taken.

    A row's shard is that of its first taken words. A document taken whole keeps its text; else its text is the taken words, in order, joined by one space. n_chars, if
    there, is that text's length. Within a task rows lie in the shards' shuffled order.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    key = F.xxhash64("doc_id", "text", "source").alias("row_key")
    # the documents' own columns travel in one, so that their names can't clash
    rows = docs.select(key, F.struct(*docs.columns).alias("doc"))
    sizes = docs.select(key, "source", word_count(F.col("text")).alias("size")).checkpoint()
    if not sizes.groupBy("row_key").count().filter("count > 1").isEmpty():
        # rows repeated in full are told apart by their number among equals
        again = Window.partitionBy("row_key").orderBy(F.lit(0))
        number = lambda df: df.withColumn("row_key", F.xxhash64("row_key", F.row_number().over(again)))
        rows, sizes = number(rows), number(sizes).checkpoint()
    pieces = mix(sizes, weights, share, max_epochs, n_shards, seed)[1]
    first = [F.min_by(c, "start").alias(c) for c in ("shard", "place")]
    spans = pieces.groupBy("row_key", "epoch").agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("spans"), F.sum("length").alias("taken"), *first)
    spans = spans.join(sizes.select("row_key", "size"), "row_key")
    words = F.regexp_extract_all("doc.text", F.lit(f"({WORD})"), F.lit(1))
    some = F.array_join(F.flatten(F.transform("spans", lambda s: F.slice(words, s["start"].cast("int") + 1, s["length"].cast("int")))), " ")
    out = rows.join(spans, "row_key").withColumn("new_text", F.when(F.col("taken") == F.col("size"), F.col("doc.text")).otherwise(some))
    changed = {"text": F.col("new_text"), "n_chars": F.length("new_text").cast("long")}
    out = out.sortWithinPartitions("shard", "place")
    return out.select(*[changed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed with weights 3, 1, 2 to 150 % of all words, no source beyond twice its words."""
    sizes = measured(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    quotas, pieces = mix(sizes, [3.0, 1.0, 2.0], 1.5)
    taken = pieces.groupBy("row_key").agg(F.sum("length").alias("taken"))
    per = quotas.select(F.col("source").alias("_s"), "source_size", "target")
    out = sizes.join(taken, "row_key", "left").join(per, F.col("source").eqNullSafe(F.col("_s")), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")


QUERIES = {"op7_source_mixing": op7_source_mixing}
