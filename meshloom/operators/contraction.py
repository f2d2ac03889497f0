"""Connected components of many graphs by contraction.

In a round every node points to the neighbour that draws the least seeded digest (itself, if none draws less), pointers are
followed twice, and nodes with the same end become one node. Edges within a node vanish, so a graph
shrinks by a constant factor in expectation and leaves once it has no edge: rounds grow with the logarithm of the largest
component, whatever its shape, and all rounds together read few times the edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.session import store_once


def components(nodes: DataFrame, edges: DataFrame, seed: int = 42) -> DataFrame:
    """(sample_id, node_id, component): the smallest node id of its component in the sample, for all ``nodes``.

    ``edges`` has (sample_id, src, dst); each may stand in one or both directions. Nodes without edges are components.
    Ends of edges that are not among ``nodes`` connect them, but aren't returned.
    """
    moves = rounds(edges, seed)
    # From the last round back: where a node ends is where the node it became ends.
    ends = None
    for move in reversed(moves):
        if ends is None:
            ends = move
            continue
        later = ends.select("sample_id", F.col("a").alias("end"), F.col("end").alias("_last")).hint("shuffle_hash")
        ends = move.join(later, ["sample_id", "end"], "left").select("sample_id", "a", F.coalesce("_last", "end").alias("end"))
    listed = nodes.select("sample_id", "node_id")
    if ends is None:
        return listed.withColumn("component", F.col("node_id"))
    least = ends.groupBy("sample_id", "end").agg(F.least(F.min("a"), F.min("end")).alias("component"))
    named = ends.join(least.hint("shuffle_hash"), ["sample_id", "end"]).select("sample_id", F.col("a").alias("node_id"), "component")
    return listed.join(named.hint("shuffle_hash"), ["sample_id", "node_id"], "left").withColumn("component", F.coalesce("component", "node_id"))


def rounds(edges: DataFrame, seed: int) -> list[DataFrame]:
    """The moves of each round, until no edge is left.

    The given edges are read twice instead of being stored: where they lie by sample, they are never moved.
    """
    moves: list[DataFrame] = []
    now = edges.select("sample_id", F.col("src").alias("a"), F.col("dst").alias("b")).where("a <> b")
    while True:
        move = store_once(pointers(now, seed + len(moves)), "moves")
        if move.isEmpty():
            return moves
        moves.append(move)
        now = store_once(contracted(now, move), "edges")


def pointers(edges: DataFrame, seed: int) -> DataFrame:
    """(sample_id, a, end): where each node of ``edges`` ends after two pointers."""

    def draw(c: str):
        return F.xxhash64(F.lit(seed), F.col("sample_id"), F.col(c))

    ways = F.array(F.struct(F.col("a"), F.col("b").alias("to")), F.struct(F.col("b").alias("a"), F.col("a").alias("to")))
    each = edges.select("sample_id", F.explode(ways).alias("w")).select("sample_id", "w.*")
    # Longs, which are aggregated by hash. Of neighbours with one draw any will do: (draw, node) falls along every pointer.
    least = each.groupBy("sample_id", "a").agg(F.min_by("to", draw("to")).alias("to"))
    drawn = [F.struct(draw(c).alias("draw"), F.col(c).alias("node")) for c in ("a", "to")]
    first = least.select("sample_id", "a", F.least(*drawn)["node"].alias("to"))
    second = first.select("sample_id", F.col("a").alias("to"), F.col("to").alias("end"))
    return first.join(second.hint("shuffle_hash"), ["sample_id", "to"]).select("sample_id", "a", "end")


def contracted(edges: DataFrame, moves: DataFrame) -> DataFrame:
    """The edges between what their nodes became, each once."""
    for end in ("a", "b"):
        named = moves.select("sample_id", F.col("a").alias(end), F.col("end").alias(f"_{end}")).hint("shuffle_hash")
        edges = edges.join(named, ["sample_id", end])
    lower, upper = F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")
    return edges.where("_a <> _b").select("sample_id", lower, upper).distinct()


def component_sizes(found: DataFrame) -> DataFrame:
    """(sample_id, component, nodes): how many nodes each component has."""
    return found.groupBy("sample_id", "component").agg(F.count(F.lit(1)).alias("nodes"))
