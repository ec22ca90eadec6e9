"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Everything runs as DataFrame expressions. Per source a target in words is found by water filling.
Highest quotients (weight / 1, 3, 5, ...) allocate the blocks to sources, then each source's blocks
to groups of 4096 shards and a group's to its shards, so windows hardly grow with a source's rows. A
shard's documents, in seeded order, form one stream of words that is cut into blocks; a shard takes whole passes over its stream and then the blocks with the smallest seeded
hashes. Shards are sized by words and by rows, so a source of any size splits into bounded windows.

Defined cases: null text has size 0 and nothing taken; null source is a source of its own, last in
order; an empty table gives an empty result; repeated rows are separate documents; columns other
than doc_id, text and source are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def highest_quotients(items: DataFrame, group: list[str], key: list[str], weight: str, seats: str) -> DataFrame:
    """items plus `won`: the Sainte-Lague seats of each item among those of its group.

    A divisor d with sum(round(w/d)) = K lies so near W/K that an item's seats differ from
    K*w/W by less than m*w/(2W) + 1/2, m items being in the group: only quotients in that range are
    ranked, about two for each item, whatever K is. Ties go to the smaller key.
    """
    g = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    x = items.withColumn("_w", F.sum(weight).over(g)).withColumn("_m", F.count(F.lit(1)).over(g))
    share = F.when(F.col("_w") > 0, F.col(seats) * F.col(weight) / F.col("_w")).otherwise(F.lit(0.0))
    slack = F.when(F.col("_w") > 0, F.col("_m") * F.col(weight) / (2 * F.col("_w")) + 0.5).otherwise(F.lit(0.0))
    x = x.withColumn("_low", F.greatest(F.lit(0), F.floor(share - slack)).cast("long"))
    x = x.withColumn("_high", (F.ceil(share + slack) + 1).cast("long"))
    x = x.withColumn("_left", F.col(seats) - F.sum("_low").over(g))
    q = x.withColumn("_seat", F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))))
    order = g.orderBy((F.col(weight) / (2 * F.col("_seat") - 1)).desc(), *key, "_seat")
    q = q.withColumn("_won", ((F.row_number().over(order) <= F.col("_left")) & (F.col(weight) > 0)).cast("long"))
    won = q.groupBy(*group, *key).agg((F.max("_low") + F.sum("_won")).alias("won"))
    return items.join(won, [*group, *key])


def source_targets(sizes: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sizes(skey, source, source_size, n) plus weight and target: one row for each source, whose
    number is taken to be that of a catalogue, so the order by code point is one small window."""
    one = Window.partitionBy(F.lit(0))
    x = sizes.withColumn("_i", (F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights))
    x = x.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("_i").cast("int") + 1))
    x = x.withColumn("_cap", cap * F.col("source_size")).withColumn("_r", F.col("_cap") / F.col("weight"))
    by = one.orderBy("_r", "skey")
    total = share * F.sum("source_size").over(one)
    x = x.withColumn("_before", F.coalesce(F.sum("_cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    x = x.withColumn("_rest", F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)))
    x = x.withColumn("_level", (total - F.col("_before")) / F.col("_rest"))
    level = F.min(F.when(F.col("_level") <= F.col("_r"), F.struct("_r", "skey", "_level"))).over(one)["_level"]
    x = x.withColumn("target", F.least(F.col("_cap"), F.coalesce(level * F.col("weight"), F.col("_cap"))).cast("double"))
    return x.select("skey", "source_size", "n", "target")


def mix(docs: DataFrame, *, weights: tuple = (5, 2, 1), share: float = 1.5, cap: int = 2, block: int = 32, shard_words: int = 1 << 16, shard_rows: int = 1 << 13, seed: int = 7, keep: bool = False) -> DataFrame:
    """docs(doc_id, text, source) as rows (doc_id, size, source_size, target, taken[, row]).

    taken: words of the document in the mix, repeats counted, at most cap times its size. With keep,
    row holds all columns of the input."""
    skey = F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source")))
    cols = ["doc_id", "source", n_words(F.col("text")).alias("size"), skey.alias("skey"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("h")]
    base = docs.select(*cols)
    narrow = cut(base)  # sizes are counted once
    sizes = narrow.groupBy("skey", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    src = source_targets(sizes, weights, share, float(cap))
    src = src.withColumn("_seats", F.round(F.sum("target").over(Window.partitionBy(F.lit(0))) / block).cast("long"))
    src = highest_quotients(src, [], ["skey"], "target", "_seats")
    src = src.withColumn("shards", F.greatest(F.ceil(F.col("source_size") / shard_words), F.ceil(F.col("n") / shard_rows), F.lit(1)))
    src = src.select("skey", "source_size", "target", F.col("won").alias("blocks"), "shards")
    src = cut(src)
    side = F.broadcast(src) if src.count() * 256 <= 16 << 20 else src  # by its size; otherwise a join that adaptive execution splits where one source is hot
    shard = F.pmod(F.col("h"), F.col("shards")).alias("shard")
    at = narrow.join(side, "skey").select("skey", shard, "size", "blocks")
    quota = at.groupBy("skey", "shard").agg(F.sum("size").alias("words"), F.max("blocks").alias("blocks"))
    quota = quota.withColumn("part", F.floor(F.col("shard") / 4096))
    parts = quota.groupBy("skey", "part").agg(F.sum("words").alias("words"), F.max("blocks").alias("blocks"))
    parts = highest_quotients(parts, ["skey"], ["part"], "words", "blocks").select("skey", "part", F.col("won").alias("blocks"))
    quota = quota.drop("blocks").join(parts, ["skey", "part"])
    quota = highest_quotients(quota, ["skey", "part"], ["shard"], "words", "blocks").where("words > 0")
    quota = quota.withColumn("nb", F.ceil(F.col("words") / block)).withColumn("k", F.least(F.col("won"), cap * F.col("nb")))
    quota = quota.withColumn("passes", F.floor(F.col("k") / F.col("nb"))).withColumn("extra", F.col("k") % F.col("nb"))
    draw = lambda b: F.xxhash64(F.lit(seed), "skey", "shard", b)
    ranked = F.sort_array(F.transform(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1), draw))
    quota = quota.withColumn("limit", F.when(F.col("extra") > 0, F.element_at(ranked, F.col("extra").cast("int"))))
    quota = quota.select("skey", "shard", "passes", "limit")
    rows = docs.select(*cols, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")) if keep else narrow
    rows = rows.join(side.select("skey", "source_size", "target", "shards"), "skey").withColumn("shard", F.pmod(F.col("h"), F.col("shards")))
    stream = Window.partitionBy("skey", "shard").orderBy("h", "size", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum("size").over(stream), F.lit(0)))
    rows = rows.join(quota, ["skey", "shard"], "left")
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    overlap = lambda b: F.least(F.col("start") + F.col("size"), (b + 1) * block) - F.greatest(F.col("start"), b * block)
    chosen = F.filter(F.sequence(first, last), lambda b: draw(b) <= F.col("limit"))
    some = F.aggregate(chosen, F.lit(0).cast("long"), lambda a, b: a + overlap(b))
    taken = F.when((F.col("size") == 0) | F.col("passes").isNull(), F.lit(0)).otherwise(F.col("passes") * F.col("size") + F.when(F.col("limit").isNull(), F.lit(0)).otherwise(some))
    return rows.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), *(["row"] if keep else []))
