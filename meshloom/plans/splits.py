"""Leakage-safe, stratified train/val/test assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.config import Splitting
from meshloom.functions.uniform import shuffle_key
from meshloom.operators.ranking import shuffle_rank
from meshloom.session import store_once


class SplitLeakage(Exception):
    """Variants of one base ended up in several splits."""


class TooFewMultihot(Exception):
    """Fewer samples with fixed and loaded nodes than required."""


def one_row_per_base(manifest: DataFrame) -> DataFrame:
    """The first variant (by sample_id) of each base."""
    keep = [c for c in ("geometry_family", "scale_bucket", "radius_ratio") if c in manifest.columns]
    first = F.min_by(F.struct(*keep), F.col("sample_id"))
    return manifest.groupBy("base_sample_id").agg(first.alias("_first")).select(
        "base_sample_id", "_first.*"
    )


def large_holdout(bases: DataFrame, rules: Splitting) -> DataFrame:
    """Mark a seeded fraction (at least one) of the large-bucket bases. Only these are ranked."""
    large = F.coalesce(F.col("scale_bucket") == "large", F.lit(False))
    keyed = bases.where(large).withColumn("_digest", shuffle_key(rules.seed, "base_sample_id", "large"))
    ranked = shuffle_rank(keyed.withColumn("_all", F.lit(True)), ["_all"], "_digest", "base_sample_id", "_rank", "_n")
    quota = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(rules.large_holdout)))
    marked = ranked.withColumn("held_large", F.col("_rank") <= quota).drop("_all", "_digest", "_rank", "_n")
    return marked.unionByName(bases.where(~large).withColumn("held_large", F.lit(False)))


def ratio_holdout(bases: DataFrame, rules: Splitting) -> DataFrame:
    """Mark brackets inside the held-out r/d range (both ends included)."""
    if "radius_ratio" not in bases.columns:
        return bases.withColumn("held_ratio", F.lit(False))
    inside = (F.col("geometry_family") == "l_bracket") & F.col("radius_ratio").between(
        *rules.radius_ratio_holdout
    )
    return bases.withColumn("held_ratio", F.coalesce(inside, F.lit(False)))


def stratified(bases: DataFrame, rules: Splitting) -> DataFrame:
    """Fill ``split``: held-out bases to test, the rest by ratio within their stratum.

    A base without family or bucket belongs to no stratum and goes to train.
    """
    held = F.col("held_large") | F.col("held_ratio")
    homeless = F.col("geometry_family").isNull() | F.col("scale_bucket").isNull()
    # Only bases of a stratum need a rank.
    settled = bases.where(held | homeless).withColumn("split", F.when(held, "test").otherwise("train"))
    keyed = bases.where(~held & ~homeless).withColumn("_digest", shuffle_key(rules.seed, "base_sample_id", "stratum"))
    ranked = shuffle_rank(keyed, ["geometry_family", "scale_bucket"], "_digest", "base_sample_id", "_rank", "_n")
    n_train = F.floor(F.col("_n") * F.lit(rules.ratios[0]))
    n_val = F.floor(F.col("_n") * F.lit(rules.ratios[1]))
    split = F.when(F.col("_rank") <= n_train, "train").when(F.col("_rank") <= n_train + n_val, "val").otherwise("test")
    return ranked.withColumn("split", split).drop("_digest", "_rank", "_n").unionByName(settled)


def base_splits(manifest: DataFrame, rules: Splitting) -> DataFrame:
    """One row per base with its split and what held it out.

    The base table is stored once: both ranking passes count it and then join it.
    """
    bases = store_once(one_row_per_base(manifest), "bases")
    return stratified(ratio_holdout(large_holdout(bases, rules), rules), rules)


def assign_splits(manifest: DataFrame, rules: Splitting, min_multihot: int = 0) -> DataFrame:
    """The manifest with ``split``; every variant follows its base.

    The result is stored and checked: raises if a base leaks, or if fewer than ``min_multihot``
    samples have nodes both fixed and loaded.
    """
    chosen = base_splits(manifest, rules).select("base_sample_id", "split")
    assigned = store_once(manifest.drop("split").join(chosen, "base_sample_id", "left"), "splits")
    check_leakage(assigned)
    if min_multihot:
        check_multihot(assigned, min_multihot)
    return assigned


def leaked_bases(manifest: DataFrame) -> DataFrame:
    """Bases found in more than one split."""
    return (
        manifest.groupBy("base_sample_id")
        .agg(F.min("split").alias("_a"), F.max("split").alias("_b"))
        .where(F.col("_a") != F.col("_b"))
        .select("base_sample_id")
    )


def check_leakage(manifest: DataFrame) -> None:
    """Raise, naming up to ten bases, if any base leaks."""
    named = [r[0] for r in leaked_bases(manifest).orderBy("base_sample_id").take(10)]
    if named:
        raise SplitLeakage(f"bases in several splits: {named}")


def multihot_count(manifest: DataFrame) -> DataFrame:
    if "has_multihot_nodes" in manifest.columns:
        flag = F.col("has_multihot_nodes")
    else:
        flag = (F.col("is_fixed") == 1) & (F.col("is_loaded") == 1)
    return manifest.agg(F.count_if(flag).alias("multihot_samples"))


def check_multihot(manifest: DataFrame, minimum: int) -> None:
    found = multihot_count(manifest).first()[0]
    if found < minimum:
        raise TooFewMultihot(f"{found} samples with fixed and loaded nodes, {minimum} required")
