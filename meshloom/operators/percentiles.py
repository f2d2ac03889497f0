"""Exact linear-interpolated percentiles by range refinement.

The rank wanted lies in some range of values. Rows are counted by (key, range), which combines map-side; the
range that holds the rank is kept, with the number of rows below it, and refined in turn
until what is left of it is small. Only then are values ordered. The first ranges are parts of an octave, later ones
equal parts of what the range before really spans. A key of any size has at most ``RANGES`` counts a round. The ranges
wanted are joined to the rows by key and range: few ones (counted) go to every task, so that rows of one key stay where
they lie; many ones are joined by shuffle, where a range that holds too many rows is split as a skewed join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshloom.session import store_once

#: Ranges of a key, or of a range, in a round.
RANGES = 1 << 16
#: First ranges an octave: 2^11 binary exponents of either sign stay below ``RANGES``.
PER_OCTAVE = 8
#: Ranges wanted go to every task up to this many (checked), beyond it rows are joined by shuffle.
BROADCAST_RANGES = 50_000
#: A range is refined until it holds at most this many rows.
REST = 10_000


def percentiles_by(
    df: DataFrame, keys: Sequence[str], value: str | Column, named: dict[str, float], rest: int = REST
) -> DataFrame:
    """One row per key with one column per entry of ``named`` (name -> probability).

    Null values are ignored; NaN is the greatest value. Null keys are keys. With no keys the result is a single row, of
    nulls if there are no values. The rows are stored once (keys and value), so ``df`` is computed once.
    """
    keys = list(keys)
    value = F.col(value) if isinstance(value, str) else value
    key = F.col(keys[0]) if len(keys) == 1 else F.struct(*[F.col(k) for k in keys]) if keys else F.lit(1)
    # Adding zero turns -0.0 into 0.0, which it equals.
    rows = store_once(
        df.select(key.alias("_k"), (value.cast("double") + 0.0).alias("_v")).where(F.col("_v").isNotNull()), "values"
    ).withColumn("_in", F.lit(0.0))
    part, found, wanted = octave(F.col("_v")), None, None
    while True:
        wanted = store_once(_narrowed(rows, part, wanted, list(named.values())), "ranks")
        # The least and the greatest value of a range are known by their place in it.
        inner = (F.col("_lo") != F.col("_hi")) & (F.col("_left") > 0) & (F.col("_left") < F.col("_c") - 1)
        edge = F.when(F.col("_left") == 0, F.col("_lo")).otherwise(F.col("_hi"))
        exact = wanted.where(~inner).select("_k", "_n", "_rank", edge.alias("_at"))
        found = exact if found is None else found.unionByName(exact)
        open_ = wanted.where(inner)
        most, many = open_.select(F.max("_c"), F.count(F.lit(1))).first()
        if most is None:
            break
        kept = store_once(_rows_within(rows, part, open_, many), "values")
        if most <= rest:
            found = found.unionByName(_picked(kept, open_))
            break
        rows, wanted = kept, open_
        share = (F.col("_v") - F.col("_in")) / (F.col("_hi") - F.col("_in"))
        part = F.least(F.floor(share * RANGES), F.lit(RANGES - 1)).cast("long")
    result = _interpolated(found, named)
    if len(keys) == 1:
        return result.withColumnRenamed("_k", keys[0])
    if keys:
        return result.select(*[F.col(f"_k.{k}").alias(k) for k in keys], *named)
    return result.agg(*[F.max(n).alias(n) for n in named])


def octave(v: Column) -> Column:
    """A range number that never falls as ``v`` grows: sign, binary exponent and a share of the octave."""
    size = (F.floor(F.log2(F.abs(v)) * PER_OCTAVE) + 1100 * PER_OCTAVE).cast("long")
    above, below = F.lit(RANGES // 2 - 1), F.lit(-(RANGES // 2))
    return (
        F.when(F.isnan(v), above + 1)
        .when(v == float("inf"), above)
        .when(v == float("-inf"), below)
        .when(v > 0, size)
        .when(v < 0, -size)
        .otherwise(0)
        .cast("long")
    )


def _narrowed(rows: DataFrame, part: Column, wanted: DataFrame | None, probs: list[float]) -> DataFrame:
    """The range of each rank wanted: _k, _in, _part, _n, _rank, _left (rank within it), _c, _lo and _hi.

    ``rows`` has _k, _v and _in: the least value, which names it, of the range that was narrowed so far.
    """
    counts = rows.groupBy("_k", "_in", part.alias("_part")).agg(
        F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    # At most RANGES counts from here on, never the rows of a key.
    ranges = Window.partitionBy("_k", "_in")
    before = F.coalesce(F.sum("_c").over(ranges.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if wanted is None:
        placed = counts.select("*", before.alias("_before"), F.sum("_c").over(ranges).alias("_n"))
        spots = [f(F.lit(p) * (F.col("_n") - 1)).cast("long") for p in probs for f in (F.floor, F.ceil)]
        here = F.filter(F.array_distinct(F.array(*spots)), lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_c")))
        placed = placed.select("*", F.explode(here).alias("_rank")).withColumn("_left", F.col("_rank") - F.col("_before"))
    else:
        asked = wanted.select("_k", F.col("_lo").alias("_in"), "_n", "_rank", "_left")
        placed = _met(counts.withColumn("_before", before), asked, "_in")
        placed = placed.where("_left >= _before and _left < _before + _c").withColumn("_left", F.col("_left") - F.col("_before"))
    return placed.select("_k", "_in", "_part", "_n", "_rank", "_left", "_c", "_lo", "_hi")


def _met(left: DataFrame, right: DataFrame, *names: str) -> DataFrame:
    """Inner join on the key, of which null is one, and ``names``."""
    other = right.withColumnsRenamed({c: f"_r{c}" for c in ("_k", *names)})
    same = F.col("_k").eqNullSafe(F.col("_r_k"))
    for c in names:
        same &= F.col(c) == F.col(f"_r{c}")
    return left.join(other, same).drop(*[f"_r{c}" for c in ("_k", *names)])


def _rows_within(rows: DataFrame, part: Column, open_: DataFrame, many: int) -> DataFrame:
    """The rows of the open ranges, with the bounds of their range."""
    keys = ["_k", "_in", "_part"]
    ranges = open_.select(*keys, "_lo", "_hi").dropDuplicates(keys)
    ranges = F.broadcast(ranges) if many <= BROADCAST_RANGES else ranges
    placed = rows.select("_k", "_in", part.alias("_part"), "_v")
    return _met(placed, ranges, "_in", "_part").select("_k", F.col("_lo").alias("_in"), "_hi", "_v")


def _picked(kept: DataFrame, open_: DataFrame) -> DataFrame:
    """The values at the ranks of ranges that are small by now."""
    ordered = kept.groupBy("_k", "_in").agg(F.sort_array(F.collect_list("_v")).alias("_values"))
    at = F.element_at("_values", (F.col("_left") + 1).cast("int")).alias("_at")
    named = open_.select("_k", F.col("_lo").alias("_in"), "_n", "_rank", "_left")
    return _met(ordered, named, "_in").select("_k", "_n", "_rank", at)


def _interpolated(found: DataFrame, named: dict[str, float]) -> DataFrame:
    def at(rank: Column) -> Column:
        return F.max(F.when(F.col("_rank") == rank.cast("long"), F.col("_at")))

    def mark(p: float) -> Column:
        spot = F.lit(p) * (F.col("_n") - 1)
        low, high, weight = at(F.floor(spot)), at(F.ceil(spot)), F.lit(p) * (F.max("_n") - 1)
        weight = weight - F.floor(weight)
        return F.when(low == high, low).otherwise(low * (F.lit(1.0) - weight) + high * weight)

    return found.groupBy("_k").agg(*[mark(p).alias(n) for n, p in named.items()])
