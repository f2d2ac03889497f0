"""Splitting, leakage, multi-hot and batching (O-72…O-73)."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshloom.catalog.registry import query
from meshloom.catalog.sqltext import digest, with_parts
from meshloom.config import DEFAULTS
from meshloom.operators import batching, topology
from meshloom.plans import splits
from meshloom.sources import derived as d

RULES = DEFAULTS.splitting


#: What a split is decided by, next to the sample: only these columns and those a query asks for are stored.
SPLIT_COLUMNS = ("sample_id", "base_sample_id", "geometry_family", "scale_bucket", "radius_ratio")


def split_manifest(spark, sf, *more):
    return splits.assign_splits(d.stored_variants(spark, sf, *SPLIT_COLUMNS, *more), RULES)


@query("assign_splits", with_parts("splitmani", """
SELECT sample_id, base_sample_id, geometry_family, scale_bucket, split FROM splitmani"""))
def assign_splits(spark, sf):
    return split_manifest(spark, sf).select(
        "sample_id", "base_sample_id", "geometry_family", "scale_bucket", "split"
    )


@query("one_row_per_base", with_parts("sfirst", """
SELECT base_sample_id, geometry_family, scale_bucket FROM sfirst"""))
def one_row_per_base(spark, sf):
    return splits.one_row_per_base(d.variants(spark, sf)).select(
        "base_sample_id", "geometry_family", "scale_bucket"
    )


@query("large_bucket_holdout", with_parts("slarge", "SELECT base_sample_id FROM slarge"))
def large_bucket_holdout(spark, sf):
    held = splits.large_holdout(splits.one_row_per_base(d.variants(spark, sf)), RULES)
    return held.where("held_large").select("base_sample_id")


@query("radius_ratio_holdout", with_parts("sheld", """
SELECT base_sample_id FROM sheld WHERE held_ratio AND NOT held_large"""))
def radius_ratio_holdout(spark, sf):
    """Brackets in the held-out range that the large holdout had not taken already."""
    bases = splits.base_splits(d.variants(spark, sf), RULES)
    return bases.where(F.col("held_ratio") & ~F.col("held_large")).select("base_sample_id")


@query("stratified_split", with_parts("ssplit", """
SELECT geometry_family, scale_bucket, split, count(*) AS bases FROM ssplit
WHERE NOT (held_large OR held_ratio) GROUP BY ALL"""))
def stratified_split(spark, sf):
    bases = splits.base_splits(d.variants(spark, sf), RULES)
    return bases.where(~F.col("held_large") & ~F.col("held_ratio")).groupBy(
        "geometry_family", "scale_bucket", "split"
    ).agg(F.count(F.lit(1)).alias("bases"))


_NULLED = """(SELECT * REPLACE (CASE WHEN tag % 19 = 0 THEN NULL ELSE geometry_family END AS geometry_family) FROM base)"""


@query("null_stratum_to_train", with_parts("base", f"""
WITH src AS {_NULLED},
large AS (SELECT base_sample_id FROM (SELECT base_sample_id, count(*) OVER () AS n,
            row_number() OVER (ORDER BY {digest(42, 'base_sample_id', "'large'")}, base_sample_id) AS rk
          FROM src WHERE scale_bucket = 'large') WHERE rk <= greatest(1, floor(n * 0.5::DOUBLE)))
SELECT base_sample_id, 'train' AS split FROM src WHERE geometry_family IS NULL AND base_sample_id NOT IN (SELECT base_sample_id FROM large)"""))
def null_stratum_to_train(spark, sf):
    """A base without a family belongs to no stratum and falls to train."""
    family = F.when(F.col("tag") % 19 != 0, F.col("geometry_family"))
    bases = d.bases(spark, sf).withColumn("geometry_family", family).withColumn(
        "sample_id", F.col("base_sample_id")
    )
    out = splits.base_splits(bases, RULES)
    return out.where(F.col("geometry_family").isNull() & ~F.col("held_large")).select(
        "base_sample_id", "split"
    )


@query("leakage_check", with_parts("splitmani", """
WITH m AS (SELECT base_sample_id, CASE WHEN tag % 50 = 0 AND target_safety_factor = 5.0 THEN 'leaked' ELSE split END AS split FROM splitmani)
SELECT base_sample_id FROM m GROUP BY base_sample_id HAVING count(DISTINCT split) > 1"""))
def leakage_check(spark, sf):
    """One variant of some bases is moved to another split on purpose."""
    moved = (F.col("tag") % 50 == 0) & (F.col("target_safety_factor") == 5.0)
    manifest = split_manifest(spark, sf, "tag", "target_safety_factor").withColumn(
        "split", F.when(moved, "leaked").otherwise(F.col("split"))
    )
    return splits.leaked_bases(manifest)


@query("multihot_assertion", with_parts("variants", """
SELECT count(*) FILTER (WHERE has_multihot_nodes) AS multihot_samples FROM variants"""))
def multihot_assertion(spark, sf):
    return splits.multihot_count(d.variants(spark, sf))


_BATCH_SQL = f"""
ordered AS (SELECT sample_id, split, node_count, CASE WHEN split = 'train' THEN {digest(42, 'sample_id', "'epoch3'")} ELSE sample_id END AS ord
            FROM splitmani WHERE linearity_gate_pass),
batched AS (SELECT *, (position - 1) // 32 AS batch_id FROM (
  SELECT *, row_number() OVER (PARTITION BY split ORDER BY ord, sample_id) AS position FROM ordered)),
placed AS (SELECT *, coalesce(sum(node_count) OVER (PARTITION BY split, batch_id ORDER BY position
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS node_offset FROM batched)"""


@query("batch_assignment", with_parts("splitmani", f"""
WITH {_BATCH_SQL} SELECT sample_id, split, position, batch_id, node_offset FROM placed"""))
def batch_assignment(spark, sf):
    """Batches of 32 graphs: train in a seeded order of epoch 3, the rest by id."""
    usable = split_manifest(spark, sf, "node_count", "linearity_gate_pass").where("linearity_gate_pass")
    samples = usable.select("sample_id", "split", "node_count")
    placed = batching.assign_batches(samples, 32, epoch=3, stage=False)
    return placed.select("sample_id", "split", "position", "batch_id", "node_offset")


@query("batched_edges", with_parts("edges4 nodes mesh", f"""
WITH ranked AS (SELECT sample_id, node_id, row_number() OVER (PARTITION BY sample_id ORDER BY node_id) - 1 AS pos FROM nodes),
sizes AS (SELECT sample_id, count(*) AS n FROM nodes GROUP BY 1),
batched AS (SELECT *, (position - 1) // 16 AS batch_id FROM (SELECT sample_id, n, row_number() OVER (ORDER BY
   {digest(42, 'sample_id', "'epoch0'")}, sample_id) AS position FROM sizes)),
placed AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY batch_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM batched)
SELECT batch_id, count(*) AS edges, sum(p.pos + off)::BIGINT AS src_sum, max(q.pos + off)::BIGINT AS last_node
FROM edges4 e JOIN ranked p ON p.sample_id = e.sample_id AND p.node_id = e.src
     JOIN ranked q ON q.sample_id = e.sample_id AND q.node_id = e.dst JOIN placed b ON b.sample_id = e.sample_id GROUP BY batch_id"""))
def batched_edges(spark, sf):
    """Block-diagonal edges: each mesh's node positions shifted by its batch offset."""
    nodes = d.mesh_nodes(spark, sf)
    positions = topology.node_positions(nodes)
    edges = topology.undirected_edges(topology.graph_nodes(d.mesh_elements(spark, sf), "tet4"), 4)
    sizes = nodes.groupBy("sample_id").agg(F.count(F.lit(1)).alias("node_count"))
    placed = batching.assign_batches(sizes.withColumn("split", F.lit("train")), 16)
    shifted = batching.batch_edges(topology.positional_edges(edges, positions), placed)
    return shifted.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("edges"),
        F.sum("src").cast("bigint").alias("src_sum"),
        F.max("dst").cast("bigint").alias("last_node"),
    )
