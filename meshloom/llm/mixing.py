"""Mixing sources to target weights by Sainte-Laguë apportionment.

The mix is blocks of equally many words: a hundredth of the smallest target each, but a word
at least and a 2^18th of all words at most, or as many as ``blocks`` says. Each goes to the source with the
highest quotient target / (2k + 1), k being the blocks it has so far; shard after shard
takes an equal run of that sequence, which gives integer quotas per shard. A source's
documents lie in a seeded order as one stream of words, which starts over when it ends;
each shard takes its quota of consecutive blocks from it. A document counts as often as
blocks cover its words, so a source's words meet its target within a block.

Weights repeat over sources in order of code point, null last. Targets start as weight
shares of all words; a target stops at ``cap`` times its source's words and the excess is
shared again by weight. This fixed point is min(level * weight, cap * words), the level
being that at which targets sum to all words.

Nulls: a null text has no words; a null source is a source. Documents without words are
returned with ``taken`` 0. Repeated rows are separate documents. An empty table, or one
without words, takes nothing. Added columns replace columns of the same names.

The order is cut in bins by hash, so a source of any size spreads over all tasks. The divisor of
each shard's end is bracketed by sums over sources and only blocks within the bracket are ranked, so what is
sorted in one task has a few rows a source, never a row a document or a block of the mix.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshloom.llm.common import WORD, row_hash, set_aside, table
from meshloom.session import store_once

ADDED = ("size", "source_size", "target", "taken", "shard_words")
#: Blocks of a mix at least, and of the smallest target; a block is never less than a word.
BLOCKS, BLOCKS_A_TARGET = 1 << 18, 100


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def with_targets(sizes: DataFrame, weights: tuple[int, ...], cap: float) -> DataFrame:
    """Add ``weight``, ``total`` and ``target`` to a table with a row a source and its ``source_size``."""
    by_name = Window.orderBy(F.col("_null"), F.col("_source"))
    everything = Window.partitionBy()
    ranked = sizes.withColumns(
        {
            "weight": F.element_at(
                F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")
            ).cast("double"),
            "total": F.sum("source_size").over(everything),
        }
    )
    # Sources reach their cap in order of cap per weight. The level falls once all capped ones are passed,
    # so the highest level that its own source can still take is the right one.
    by_cap = Window.orderBy(F.col("source_size") / F.col("weight"), "_null", "_source")
    level = ranked.withColumns(
        {
            "_capped": F.coalesce(F.sum("source_size").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * cap,
            "_weights": F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)),
        }
    ).withColumn("_level", (F.col("total") - F.col("_capped")) / F.col("_weights"))
    open_ = F.col("_level") * F.col("weight") <= F.col("source_size") * cap
    return (
        level.withColumn("_level", F.max(F.when(open_, F.col("_level"))).over(everything))
        .withColumn("target", F.least(F.coalesce(F.col("_level") * F.col("weight"), F.lit(0.0)), F.col("source_size") * cap))
        .drop("_capped", "_weights", "_level")
    )


def quotas(targets: DataFrame, blocks: int | None, shards: int, cap: float) -> DataFrame:
    """Blocks of each source by shard: ``block_words`` and ``bounds``, the running number after each shard.

    Without ``blocks`` a block is a small share of the smallest target. Ties go by code point; a target of 0 gets none.
    """
    coarse = F.greatest(F.ceil(F.col("total") / (blocks or BLOCKS)), F.lit(1))
    smallest = F.min(F.when(F.col("target") > 0, F.col("target"))).over(Window.partitionBy())
    fine = F.greatest(F.floor(smallest / BLOCKS_A_TARGET), F.lit(1))
    sized = store_once(
        targets.withColumn("block_words", (coarse if blocks else F.least(coarse, fine)).cast("long")).withColumn(
            "_most",
            F.when(F.col("target") > 0, F.floor(F.col("source_size") * cap / F.col("block_words"))).otherwise(0).cast("long"),
        ),
        "mix-sources",
    )
    n, words_, wanted, most, block = sized.agg(
        F.count(F.lit(1)), F.first("total"), F.sum("target"), F.sum("_most"), F.first("block_words")
    ).first()
    seats = math.floor(words_ / block + 0.5) if wanted else 0
    ends = [min(-(-(s + 1) * seats // shards), most or 0) for s in range(shards)]

    def held(rate: float) -> Column:
        """Blocks of a source whose quotients reach a divisor, the divisor being 1 / ``rate``."""
        return F.least(F.col("_most"), F.floor(F.col("target") * rate + 0.5)).cast("long")

    # A source's blocks are within a half of target * rate, so some n blocks to either side of an end decide it.
    # Sources that are full leave their blocks to others, for which the rate rises until all blocks are given.
    low = [max(0.0, end - n - 1) / wanted if wanted else 0.0 for end in ends]
    slack = [n + 1] * shards
    while True:
        high = [(end + more) / wanted if wanted else 0.0 for end, more in zip(ends, slack, strict=True)]
        given = [x or 0 for x in sized.agg(*[F.sum(held(rate)) for rate in (*low, *high)]).first()]
        short = [s for s in range(shards) if given[shards + s] < ends[s]]
        if not short:
            break
        slack = [more * 2 if s in short else more for s, more in enumerate(slack)]
    margin = F.array(
        *[F.struct(F.lit(s).alias("_shard"), held(low[s]).alias("_from"), held(high[s]).alias("_to")) for s in range(shards)]
    )
    claims = (
        sized.select("_null", "_source", "target", F.inline(margin))
        .filter("_to > _from")
        .select("_null", "_source", "target", "_shard", F.explode(F.expr("sequence(_from, _to - 1)")).alias("_k"))
    )
    order = Window.partitionBy("_shard").orderBy(F.desc(F.col("target") / (2 * F.col("_k") + 1)), "_null", "_source", "_k")
    left = F.array(*[F.lit(ends[s] - given[s]).cast("long") for s in range(shards)])
    won = (
        claims.withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= F.get(left, F.col("_shard")))
        .groupBy("_null", "_source")
        .agg(*[F.count(F.when(F.col("_shard") == s, 1)).alias(f"_q{s}") for s in range(shards)])
    )
    bounds = F.array(*[held(low[s]) + F.coalesce(F.col(f"_q{s}"), F.lit(0).cast("long")) for s in range(shards)])
    return sized.join(won, ["_null", "_source"], "left").select(
        "_null", "_source", "source_size", "target", "block_words", bounds.alias("bounds")
    )


def mix(
    df: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    cap: float = 3.0,
    blocks: int | None = None,
    shards: int = 16,
    seed: int = 23,
    text: str = "text",
    source: str = "source",
    size: str | None = None,
    bin_rows: int = 4096,
) -> DataFrame:
    """Add to every document its words (``size``), its source's words and target, ``taken`` and ``shard_words``.

    ``size`` may name a column of sizes to take instead.
    """
    df = df.drop(*ADDED)
    plain, column, original = set_aside(df)
    rows = plain.withColumns(
        {
            "size": words(column(text)) if size is None else column(size),
            "_null": column(source).isNull(),
            "_source": F.coalesce(column(source).cast("string"), F.lit("")),
            "_hash": row_hash(plain, seed),
        }
    )
    bins = max(1, math.ceil(df.count() / bin_rows))
    rows = rows.withColumn("_bin", F.pmod("_hash", F.lit(bins)))
    sums = rows.groupBy("_null", "_source", "_bin").agg(F.sum("size").alias("_bin_size"))
    sizes = sums.groupBy("_null", "_source").agg(F.sum("_bin_size").alias("source_size"))
    plan = quotas(with_targets(sizes, weights, cap), blocks, shards, cap)
    earlier = Window.partitionBy("_null", "_source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_offset", F.coalesce(F.sum("_bin_size").over(earlier), F.lit(0))).drop("_bin_size")
    within = (
        Window.partitionBy("_null", "_source", "_bin").orderBy("_hash", "size").rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = rows.withColumn("_start", F.coalesce(F.sum("size").over(within), F.lit(0))).join(
        starts.join(plan, ["_null", "_source"]), ["_null", "_source", "_bin"]
    )
    first, length = F.col("_offset") + F.col("_start"), F.col("source_size")

    def covered(until: Column) -> Column:
        """Words of the document that the stream passes up to the word ``until``."""
        rounds = F.floor(until / F.greatest(length, F.lit(1))).cast("long")
        into = F.least(F.greatest(until - rounds * length - first, F.lit(0)), F.col("size"))
        return rounds * F.col("size") + into

    marks = [covered(F.col("bounds")[s] * F.col("block_words")) for s in range(shards)]
    return (
        placed.withColumn("_marks", F.array(*marks))
        .withColumn("taken", F.col("_marks")[shards - 1])
        .withColumn("shard_words", F.array(*[F.col("_marks")[s] - (F.col("_marks")[s - 1] if s else 0) for s in range(shards)]))
        .select(*original, *ADDED)
    )


def mixed_documents(df: DataFrame, **settings) -> DataFrame:
    """The mix as documents: each row repeated as often as ``taken`` holds its words, rounded."""
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    plain, _, original = set_aside(df)
    names = dict(zip(df.columns, plain.columns, strict=True))
    settings = {"text": names["text"], "source": names["source"]} | settings
    mixed = mix(plain, **settings).withColumn("_copy", F.explode(F.array_repeat(F.lit(1), copies)))
    return mixed.select(*original)


def op9_sainte_lague(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", *ADDED)
