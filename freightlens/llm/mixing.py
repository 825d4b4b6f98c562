"""Mixing sources to target weights: blocks of equal size, apportioned by Sainte-Laguë.

Targets. The mix has ``share`` times the words of the table. A source's target is its
weight's part of that, but at most ``most`` times its own words; what is cut off is shared
again by weight among the others until none is above. In closed form (``_level``) every
target is the lesser of the source's limit and its weight times one level.

Blocks. Documents are dealt by a seeded hash into shards of their source, laid end to end
there in seeded order, and each shard is cut into round(words / block) blocks of equal
size (to one word), at least one. A source's target in blocks is its vote, and the seats,
as many as the votes add up to, go to the highest quotients vote / (2 k + 1), where no source
gets more than ``most`` times its blocks. Each source's seats are apportioned to its
shards in the same way: integer quotas per shard. A shard takes its blocks in full rounds
and the rest by a seeded hash of the block. What a document gives is the words of its
parts in the chosen blocks, repeats counted, so never more than ``most`` times its size.

Spread. Sizes are the only thing kept of a text. Equal rows are counted first and dealt
copy by copy, so neither a hot source nor a repeated row meets in one task; a shard has
about ``shard_words`` words, and more only where a source fills ``MAX_SHARDS`` of them.
Apportioning ranks a few quotients for each source or shard (see ``sainte_lague``), so one
task holds the sources, or the at most MAX_SHARDS shards of one source. Everything is
DataFrame operations; hashes are MD5, so that the statement for the check can use them.

Defined cases: a null text has no words; a null source is a source, the last one; a null
id is hashed as an empty one; rows of equal id, source and size are told apart by their
number only; a table without words takes nothing; an empty table gives an empty result.
The result has columns of its own only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from freightlens.sources import stored

#: Words of a block and of a shard, and shards of a source.
BLOCK, SHARD_WORDS, MAX_SHARDS = 32, 1 << 16, 1 << 16
_START = Window.unboundedPreceding
#: Copies of one row that one row stands for at a time.
CHUNK = 10_000


def word_count(text: Column) -> Column:
    """Number of runs of characters other than blanks; no list of words is made."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.translate(marked, " \t\n\x0b\x0c\r", "")).cast("long")


def seeded(seed: int, *parts: Column) -> Column:
    """60 bits of the MD5 of "seed:part:part..." as a long; a null part is empty."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *texts).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _level(total: Column, limit: str, weight: str, own: WindowSpec, order: str) -> Column:
    """For each row a candidate of the level at which sum(min(limit, weight * level)) is total.

    The greatest candidate of a group is its level: with rows sorted by limit over weight,
    what the rows before a row leave at their limits, over the weights from the row on.
    """
    ratio = F.try_divide(F.col(limit), F.col(weight))
    before = own.orderBy(ratio.asc_nulls_last(), F.asc(order)).rowsBetween(_START, -1)
    # the rows from this one on, summed from the end
    rest = own.orderBy(ratio.desc_nulls_first(), F.desc(order)).rowsBetween(_START, 0)
    left = total - F.coalesce(F.sum(limit).over(before), F.lit(0))
    return F.try_divide(left, F.sum(weight).over(rest))


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, most: int) -> DataFrame:
    """``sizes`` (source, source_size), one row for each source, with ``place`` and ``target``.

    Weights repeat over the sources in code point order, null last. One task, as there is
    one row for each source.
    """
    own = Window.partitionBy(F.lit(0))
    cycle = F.array(*(F.lit(int(w)) for w in weights))
    placed = (
        sizes.withColumn("place", F.row_number().over(own.orderBy(F.asc_nulls_last("source"))) - 1)
        .withColumn("weight", F.get(cycle, F.pmod("place", F.lit(len(weights)))))
        .withColumn("limit", F.col("source_size") * most)
    )
    mix = F.sum("source_size").over(own) * F.lit(float(share))
    level = F.max("level").over(own) * F.col("weight")
    return (
        placed.withColumn("level", _level(mix, "limit", "weight", own, "place"))
        .withColumn("target", F.least(F.col("limit").cast("double"), level))
        .drop("weight", "limit", "level")
    )


def sainte_lague(df: DataFrame, group: Sequence[str], order: str) -> DataFrame:
    """Apportion each group's ``seats`` to its rows by the highest quotients votes / (2 k + 1).

    A row gets ``limit`` seats at most (its votes, or more), and equal quotients go to the
    least ``order``, a number. Seats must be the sum of the group's votes, rounded. Replaces the
    three columns by ``quota``.

    Only about four quotients for each row are ranked, whatever the seats are. With S rows and
    V votes, a divisor of 1 / (1 - (S + 1) / 2V) gives no more seats than there are, so a
    row has at least votes * (1 - (S + 1) / 2V) - 1. A divisor of 1 / (1 + e) gives no
    fewer if the sum of min(limit - votes, votes * e) is (S + 1) / 2, so no row has more than
    that and one above its votes.
    """
    own = Window.partitionBy(*(group or [F.lit(0)]))
    margin = (F.count(F.lit(1)).over(own) + 1) / 2
    votes = F.col("votes")
    shrunk = F.coalesce(F.try_divide(margin, F.sum("votes").over(own)), F.lit(0.0))
    grown = F.least("__slack", F.coalesce(votes * F.max("__level").over(own), F.lit(0.0)))
    bounded = (
        df.withColumn("__slack", F.col("limit") - votes)
        .withColumn("__level", _level(margin, "__slack", "votes", own, order))
        .withColumn("__least", F.greatest(F.floor(votes * (1 - shrunk)) - 1, F.lit(0)))
        .withColumn("__most", F.least(F.ceil(votes + grown) + 1, F.col("limit")))
        .withColumn("__left", F.col("seats") - F.sum("__least").over(own))
    )
    some = F.col("__most") > F.col("__least")
    ranked = bounded.withColumn(
        "__k", F.explode_outer(F.when(some, F.sequence("__least", F.col("__most") - 1)))
    ).withColumn("__quotient", votes / (2 * F.col("__k") + 1))
    rank = F.row_number().over(own.orderBy(F.desc_nulls_last("__quotient"), order))
    won = (rank <= F.col("__left")) & F.col("__k").isNotNull()
    kept = [c for c in df.columns if c not in ("votes", "limit", "seats")]
    return (
        ranked.withColumn("__won", F.when(won, 1).otherwise(0))
        .groupBy(*kept)
        .agg((F.max("__least") + F.sum("__won")).alias("quota"))
    )


def _dealt(counted: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """One row for each copy, with its source's place and its shard."""
    chunk = F.explode(F.expr(f"sequence(0L, copies - 1, {CHUNK}L)"))
    copy = F.explode(F.expr(f"sequence(chunk, least(copies, chunk + {CHUNK}) - 1)"))
    copies = counted.withColumn("chunk", chunk).withColumn("copy", copy)
    own = targets.select(F.col("source").alias("own"), "place", "shards")
    return (
        copies.join(own, F.col("source").eqNullSafe(F.col("own")))
        .withColumn("draw", seeded(seed, F.col("doc_id"), F.col("size"), F.col("copy")))
        .withColumn("shard", F.pmod("draw", "shards"))
        .select("place", "shard", "draw", "doc_id", "size", "copy")
    )


def _quotas(dealt: DataFrame, targets: DataFrame, block: int, most: int) -> DataFrame:
    """(place, shard, words, blocks, quota) of each shard that has words."""
    blocks = F.greatest(F.round(F.col("words") / block), F.lit(1)).cast("long")
    shards = (
        dealt.groupBy("place", "shard")
        .agg(F.sum("size").alias("words"))
        .where("words > 0")
        .withColumn("blocks", blocks)
    )
    own = shards.groupBy("place").agg(F.sum("blocks").alias("limit"))
    votes = F.col("target") * F.col("limit") / F.col("source_size")
    whole = Window.partitionBy(F.lit(0))
    sources = (
        targets.join(own, "place")
        .select("place", F.col("limit").alias("all_blocks"), votes.alias("votes"), F.col("limit") * most)
        .toDF("place", "all_blocks", "votes", "limit")
        .withColumn("votes", F.least("votes", F.col("limit").cast("double")))
        # decimals, so that the sum does not depend on the order of rows
        .withColumn("seats", F.round(F.sum(F.col("votes").cast("decimal(28,6)")).over(whole)).cast("long"))
    )
    quotas = sainte_lague(sources, [], "place").withColumnRenamed("quota", "seats")
    split = (
        shards.join(quotas, "place")
        .withColumn("votes", F.col("seats").cast("double") * F.col("blocks") / F.col("all_blocks"))
        .withColumn("limit", F.col("blocks") * most)
        .withColumn("votes", F.least("votes", F.col("limit").cast("double")))
        .drop("all_blocks")
    )
    return sainte_lague(split, ["place"], "shard")


def _taken(dealt: DataFrame, quotas: DataFrame, seed: int) -> DataFrame:
    """(place, doc_id, size, taken) of each copy; one shuffle, by shard."""
    own = Window.partitionBy("place", "shard")
    before = own.orderBy("draw", "doc_id", "size", "copy").rowsBetween(_START, -1)
    first = F.expr("((start + 1) * blocks - 1) div words")
    last = F.expr("((start + size) * blocks - 1) div words")
    cut = F.expr("least(start + size, (block + 1) * words div blocks) - greatest(start, block * words div blocks)")
    chosen = F.dense_rank().over(own.orderBy("lot", "block")) <= F.col("quota") % F.col("blocks")
    times = F.expr("quota div blocks") + F.when(chosen, 1).otherwise(0)
    return (
        dealt.join(quotas, ["place", "shard"], "left")
        .withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
        .withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
        .withColumn("lot", seeded(seed, F.col("place"), F.col("shard"), F.col("block")))
        .withColumn("taken", F.when(F.col("size") > 0, cut * times).otherwise(0))
        .groupBy("place", "shard", "doc_id", "size", "copy")
        .agg(F.sum("taken").alias("taken"))
    )


def mix_sources(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    most: int = 2,
    block: int = BLOCK,
    shard_words: int = SHARD_WORDS,
    seed: int = 42,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of each document.

    ``share`` may be at most ``most``. Stores the counted sizes, the sources and the shards
    when called.
    """
    if not weights or min(weights) <= 0 or share > most:
        raise ValueError("weights must be positive and the share at most the limit")
    sized = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.col(f"`{source}`").alias("source"),
        word_count(F.col(f"`{text}`")).alias("size"),
    )
    counted = stored(
        sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("copies")), "sizes"
    )
    sizes = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    shards = F.least(F.ceil(F.col("source_size") / shard_words), F.lit(MAX_SHARDS))
    targets = source_targets(sizes, weights, share, most)
    targets = stored(targets.withColumn("shards", F.greatest(shards, F.lit(1)).cast("long")), "targets")
    dealt = _dealt(counted, targets, seed)
    quotas = stored(_quotas(dealt, targets, block, most), "quotas")
    taken = _taken(dealt, quotas, seed).join(targets, "place")
    return taken.select("doc_id", "source", "size", "source_size", "target", "taken")
