"""Mixing sources to target weights by Sainte-Laguë apportionment.

Method. The mix is a number of equal-token blocks. Sources get blocks by
highest quotients (target divided by 1, 3, 5, ...), then each source's
blocks go to its shards the same way, which gives every shard an integer
quota. A shard lays its documents end to end in a seeded order, repeats
that order where the quota exceeds it, and takes its first quota blocks.

The highest quotients are found without listing them: rounding each exact
share gives the quotients of one divisor, and only the few seats by which
the sum misses the total are then won or lost by rank.

A source is dealt over shards by a seeded hash of the document, the more
the larger it is, so a source with a third of all rows makes no large task.
All of it is DataFrame functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .quality_rules import words_of
from .scratch import written

#: Weights of the sources in order, repeating.
WEIGHTS = (3, 1, 2)
#: Tokens of the mix for each token of the input, and the most copies of a source.
SHARE, MOST = 1.5, 2
#: Tokens in a block.
BLOCK = 8
#: Tokens that a shard aims at; for very large sources the root of their size, so neither a shard nor the list of shards grows in step.
SHARD = 1 << 17
SEED = 42


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target: shares by weight, stopped at ``most`` times the size, the excess reshared.

    In the order of size by weight, sources that stop come first; the rest
    share what those leave. One row for each source enters the one task here.
    """
    cap = F.col("source_size") * F.lit(float(most))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    df = sources.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    by = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before, every = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    df = df.withColumn("cap", cap).withColumn("all", F.sum("source_size").over(every) * F.lit(share))
    left = F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    heavy = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    df = df.withColumn("level", left / heavy).withColumn("stops", F.col("w") * F.col("level") > F.col("cap"))
    level = F.min(F.when(~F.col("stops"), F.struct(F.col("source_size") / F.col("w"), F.col("source").isNull(), "source", "level"))).over(every)["level"]
    return df.select("source", "source_size", F.when(F.col("stops"), F.col("cap")).otherwise(F.col("w") * level).alias("target"))


def apportion(df: DataFrame, group: list[str], item: str, votes: str, seats: Column) -> DataFrame:
    """``df`` with quota: ``seats`` of each group by highest quotients votes / (2k + 1).

    ``seats`` is the same throughout a group. Equal quotients go by ``item``.
    """
    every = Window.partitionBy(*group)
    exact = F.col(votes) * F.col("_seats") / F.col("_votes")
    df = df.withColumn("_seats", seats.cast("long")).withColumn("_votes", F.sum(votes).over(every))
    df = df.withColumn("_near", F.when(F.col("_votes") > 0, F.floor(exact + 0.5)).otherwise(0).cast("long"))
    df = df.withColumn("_miss", F.when(F.col("_votes") > 0, F.col("_seats") - F.sum("_near").over(every)).otherwise(0))
    # To win or lose the seats that n roundings miss, the divisor moves by a share of n / (2 * seats) at most, so each item has few claims.
    few = F.least(F.abs("_miss"), F.floor(exact * F.count("*").over(every) / (2 * F.col("_seats"))) + 2).cast("int")
    claims = df.where("_miss != 0").withColumn("_few", few).select(*group, item, "_miss", F.col(votes).alias("_v"), F.explode(F.expr("if(_miss > 0, sequence(_near, _near + _few - 1), sequence(_near - 1, _near - _few, -1))")).alias("_k")).where("_k >= 0")
    quotient = F.col("_v") / (2 * F.col("_k") + 1)
    up = F.row_number().over(Window.partitionBy(*group).orderBy(quotient.desc(), F.col(item).asc_nulls_last()))
    down = F.row_number().over(Window.partitionBy(*group).orderBy(quotient.asc(), F.col(item).desc_nulls_first()))
    claims = claims.withColumn("_won", (F.col("_miss") > 0) & (up <= F.col("_miss"))).withColumn("_lost", (F.col("_miss") < 0) & (down <= -F.col("_miss")))
    change = claims.groupBy(*group, item).agg(F.sum(F.col("_won").cast("long") - F.col("_lost").cast("long")).alias("_change"))
    change = change.withColumnsRenamed({c: f"_c_{c}" for c in (*group, item)})
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_c_{c}")) for c in (*group, item)))
    return df.join(change, same, "left").withColumn("quota", F.col("_near") + F.coalesce("_change", F.lit(0))).drop("_seats", "_votes", "_near", "_miss", "_change", *(f"_c_{c}" for c in (*group, item)))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK, seed: int = SEED, with_text: bool = False) -> DataFrame:
    """How many words of each document the mix takes.

    doc_id, size, source_size, target, taken, source, shard. ``taken`` is at
    most ``most`` times ``size``; a source's sum of it is within a block a
    shard of its target. The same rows give the same mix in any order.
    ``with_text`` adds text, the mix itself: the words taken of the document,
    whole copies one below another, then the first words of a last part.

    Defined cases: a null text has size 0 and nothing is taken of it; a null
    source is a source of its own, the last in order; repeated rows count
    each; a very long text counts with all its words; quotients that tie go to the first source or
    shard; a source without words gets nothing; an empty table gives none;
    columns other than those named are ignored.
    """
    text = F.col(text_col).cast("string")
    place = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit(""))))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.size(words_of(text)).cast("long").alias("size"), place.alias("place"), text.alias("text"))
    sizes = written(docs.drop("text"), "sizes")
    goal = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    goal = apportion(goal.withColumn("one", F.lit(0)), ["one"], "source", "target", F.round(F.sum("target").over(Window.partitionBy("one")) / block))
    aim = F.greatest(F.lit(float(SHARD)), F.sqrt("source_size"))
    goal = written(goal.select("source", "source_size", "target", "quota", F.greatest(F.ceil(F.col("source_size") / aim), F.lit(1)).cast("int").alias("shards")), "goals")
    held = goal.withColumnsRenamed({c: f"g_{c}" for c in goal.columns})

    def sharded(rows: DataFrame) -> DataFrame:
        shard = F.pmod(F.conv(F.substring("place", 25, 8), 16, 10).cast("long"), F.col("g_shards")).cast("int")
        return rows.join(held, F.expr("source <=> g_source")).withColumn("shard", shard)

    shards = sharded(sizes).groupBy("source", "shard").agg(F.sum("size").alias("length"), F.max("g_quota").alias("seats"))
    shards = apportion(shards, ["source"], "shard", "length", F.col("seats"))
    shards = written(shards.select("source", "shard", "length", "quota"), "quotas")
    shards = shards.withColumnsRenamed({c: f"s_{c}" for c in shards.columns})
    dealt = sharded(docs if with_text else sizes).join(shards, F.expr("source <=> s_source and shard = s_shard"))
    laid = Window.partitionBy("source", "shard").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("begin", F.coalesce(F.sum("size").over(laid), F.lit(0)))
    # A quota's last block may be cut short, where a shard gives all its copies.
    take = F.least(F.col("s_quota") * block, F.col("s_length") * most)
    rounds = F.when(F.col("s_length") > 0, F.floor(take / F.col("s_length"))).otherwise(0)
    rest = take - rounds * F.col("s_length")
    taken = rounds * F.col("size") + F.least(F.greatest(rest - F.col("begin"), F.lit(0)), F.col("size"))
    out = dealt.withColumn("taken", taken.cast("long"))
    columns = ["doc_id", "size", F.col("g_source_size").alias("source_size"), F.col("g_target").alias("target"), "taken", "source", "shard"]
    return out.select(*columns, _words_taken().alias("text")) if with_text else out.select(*columns)


def _words_taken() -> Column:
    """``taken`` words of ``text``: all of it so many times, then its first words."""
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    rest = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0).cast("int")
    part = F.when(rest > 0, F.array(F.array_join(F.slice(words_of(F.col("text")), F.lit(1), rest), " "))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.array_repeat("text", whole), part), "\n")
