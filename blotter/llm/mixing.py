"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

DataFrame functions only; no Python runs on the rows.

1. A row's key is hashed to one of 2**20 cells; the top 9 bits name one of 512 permuted blocks of
   its source. One aggregation gives the words of every (source, block).
2. A source's target is its weight's share of all words, held to ``ceiling`` times what it has;
   the excess is shared out again by weight until no source is above. The target becomes a
   quota: whole passes over the source plus a fraction of one pass. The fraction ends in one
   block, which is cut at a cell, so a source is met to within about one cell of words.
3. The quota's blocks (source, pass, block) are split among the output shards down a binary tree: at
   each node a random half of the node's blocks goes left. How many blocks of each source go left
   is then a multivariate-hypergeometric draw from the node's exact quotas, and the blocks of
   different shards are disjoint. The table of blocks has at most sources * 512 * (ceiling + 1)
   rows and does not grow with the documents.
4. Rows join their block's places. They are dealt to tasks by shard and a seeded hash, and put in the order of that
   hash inside their task.

All draws are hashes of the seed, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import stage

BLOCK_BITS, CELL_BITS = 9, 20
SUB = 1 << (CELL_BITS - BLOCK_BITS)
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text as a long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_cell(seed: int, key: Column) -> Column:
    """The first 20 bits of md5(seed:key); a null key hashes as an empty one."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, CELL_BITS // 4), 16, 10).cast("int")


def _skey(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def repeating_weights(docs: DataFrame, source: str, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, weight): weights repeat ``cycle`` over the sources in code-point order, null last."""
    names = docs.select(F.col(source).alias("source")).distinct()
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # a row for each source
    return names.select("source", F.element_at(F.array(*map(F.lit, cycle)), (place % len(cycle) + 1).cast("int")).cast("double").alias("weight"))


def _targets(sources: DataFrame, ceiling: int) -> DataFrame:
    """Adds ``target``: shares of all words by weight, none above ceiling * source_size."""
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    cap = (F.lit(ceiling) * F.col("source_size")).cast("double")
    rate = None  # words for each unit of weight, over the sources below their ceiling
    while True:
        held = F.lit(False) if rate is None else F.col("weight") * F.lit(rate) > cap
        row = sources.agg(F.sum(F.when(held, cap).otherwise(0.0)), F.sum(F.when(held, 0.0).otherwise(F.col("weight")))).first()
        if not row[1]:
            break
        new = (float(total) - row[0]) / row[1]
        if rate is not None and new <= rate:
            break
        rate = new
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(rate or 0.0)))


def plan_mixture(rows: DataFrame, weights: DataFrame, shards: int, ceiling: int, seed: int) -> DataFrame:
    """(skey, block, source_size, target, passes, cut, places): where the blocks of each source go.

    ``rows`` has __skey, __cell and __size. ``cut`` is the first cell that the last, partial pass
    leaves out.
    """
    block = F.shiftright("__cell", CELL_BITS - BLOCK_BITS)
    blocks = stage(rows.groupBy("__skey", block.alias("block")).agg(F.sum("__size").alias("words")), "mix-blocks")
    sources = blocks.groupBy("__skey").agg(F.sum("words").alias("source_size")).join(
        weights.groupBy(_skey(F.col("source")).alias("__skey")).agg(F.max("weight").alias("weight")), "__skey")
    sources = _targets(stage(sources, "mix-sources"), ceiling)
    size = F.greatest(F.col("source_size"), F.lit(1))
    sources = sources.withColumn("passes", F.floor(F.col("target") / size).cast("int")).withColumn(
        "rest", F.col("target") - F.col("passes") * F.col("source_size"))

    before = F.coalesce(F.sum("words").over(
        Window.partitionBy("__skey").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = blocks.withColumn("before", before).join(sources, "__skey").where(
        (F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))
    reached = stage(reached.select("__skey", "block", (F.col("rest") - F.col("before")).alias("room")), "mix-cut")
    cells = (
        rows.withColumn("block", block).join(reached, ["__skey", "block"])
        .groupBy("__skey", "block", "room", "__cell").agg(F.sum("__size").alias("words"))
    )
    upto = F.sum("words").over(Window.partitionBy("__skey").orderBy("__cell"))
    cuts = (
        cells.withColumn("middle", upto - F.col("words") / 2)
        .groupBy("__skey").agg(
            F.max(F.when(F.col("middle") <= F.col("room"), F.col("__cell") + 1)).alias("last"), F.max("block").alias("block"))
        .select("__skey", F.coalesce("last", F.col("block") * SUB).alias("cut"))
    )
    sources = stage(sources.join(cuts, "__skey", "left").select(
        "__skey", "source_size", "target", "passes", F.coalesce("cut", F.lit(0)).alias("cut")), "mix-plan")

    units = blocks.join(sources, "__skey").select(
        "__skey", "block", F.explode(F.sequence(F.lit(1), F.col("passes") + 1)).alias("pass"), "passes", "cut")
    units = units.where((F.col("pass") <= F.col("passes")) | (F.col("block") * SUB < F.col("cut")))
    placed = _split(units, shards, seed).groupBy("__skey", "block").agg(
        F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("places"))  # at most ceiling + 1 of them
    return blocks.select("__skey", "block").join(sources, "__skey").join(placed, ["__skey", "block"], "left")


def _split(units: DataFrame, shards: int, seed: int) -> DataFrame:
    """Halve the units at each node of a binary tree whose leaves are the shards."""
    units = units.withColumn("first", F.lit(0)).withColumn("leaves", F.lit(shards))
    level = 0
    while (1 << level) < shards:
        order = F.md5(F.concat_ws(":", F.lit(f"{seed}/{level}"), "__skey", "pass", "block"))
        node = Window.partitionBy("first", "leaves")
        left = F.floor(F.col("leaves") / 2)
        units = (
            units.withColumn("n", F.count(F.lit(1)).over(node)).withColumn("rank", F.row_number().over(node.orderBy(order)))
            .withColumn("goes_left", (F.col("rank") * F.col("leaves") <= F.col("n") * left))
            .withColumn("first", F.when(F.col("goes_left"), F.col("first")).otherwise(F.col("first") + left).cast("int"))
            .withColumn("leaves", F.when(F.col("goes_left"), left).otherwise(F.col("leaves") - left).cast("int"))
        )
        level += 1
    return units.withColumn("shard", F.col("first"))


def mix(docs: DataFrame, weights: DataFrame, size: Column, key: str = "doc_id", source: str = "source",
        shards: int = 8, ceiling: int = 3, seed: int = 7) -> DataFrame:
    """``docs`` with size, source_size, target, taken (longs; target a double) and places.

    ``places`` lists (pass, shard) of each time the mixture takes the row: at most ``ceiling`` of
    them; empty if it is left out. ``weights`` has (source, weight), one row for each source, null
    included; a source without a weight takes no part and its rows are left out of the result.
    Input columns with the names of the results are replaced. Null texts have size 0. Repeated
    rows share a cell and are taken alike. An empty table gives an empty result.
    """
    keep = [c for c in docs.columns if c not in {"size", "source_size", "target", "taken", "places"}]
    rows = docs.select(
        *(F.col(c).alias(f"__in_{c}") for c in keep), size.alias("__size"), _skey(F.col(source)).alias("__skey"),
        hash_cell(seed, F.col(key)).alias("__cell"))
    plan = stage(plan_mixture(rows.select("__skey", "__cell", "__size"), weights, shards, ceiling, seed), "mix-places")
    out = rows.withColumn("block", F.shiftright("__cell", CELL_BITS - BLOCK_BITS)).join(plan, ["__skey", "block"])
    taken = F.filter("places", lambda p: (p["pass"] <= F.col("passes")) | (F.col("__cell") < F.col("cut")))
    return out.withColumn("__taken", F.coalesce(taken, F.array().cast(plan.schema["places"].dataType))).select(
        *(F.col(f"__in_{c}").alias(c) for c in keep), F.col("__size").alias("size"), "source_size", "target",
        (F.col("__size") * F.size("__taken")).alias("taken"), F.col("__taken").alias("places"))


def mixture(mixed: DataFrame, key: str = "doc_id", seed: int = 7, shards: int = 8, parts: int | None = None) -> DataFrame:
    """One row for each time a document is taken, with its shard: dealt by shard, then shuffled inside each task.

    A shard is dealt to as many tasks as its share of the shuffle partitions (``parts`` of them), by the
    seeded hash of the key and the pass, so that no shard is one task and every task holds all sources of its
    shard, however the input lies.
    """
    parts = parts or max(1, -(-int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards))
    rows = mixed.withColumn("__place", F.explode("places")).withColumn("shard", F.col("__place")["shard"])
    order = F.md5(F.concat_ws(":", F.lit(f"{seed}"), F.col(key).cast("string"), F.col("__place")["pass"]))
    rows = rows.withColumn("__order", order)
    task = F.col("shard") * parts + F.pmod(F.xxhash64("__order"), F.lit(parts)).cast("int")
    return rows.withColumn("__task", task).repartitionById(shards * parts, F.col("__task")).sortWithinPartitions(
        "shard", "__order").drop("__place", "__order", "__task")
