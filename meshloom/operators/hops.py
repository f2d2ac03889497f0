"""Hop distances, eccentricities and diameters by bit-parallel frontier joins.

All samples and all starts advance together, one join per hop; up to 64 starts of a sample share a row of
a node, one bit of a long each, and meet in ``bit_or``, which combines map-side. The mesh graph is undirected, so the
neighbours of hop k lie on hops k-1, k or k+1: a new frontier is checked against the last two only. Neighbour lists
are a bucketed table: a hop shuffles its frontier and reads, but never moves or sorts, the edges; every few hops
lists of samples that have no frontier left are dropped, in the same buckets. Every frontier is a table in the shared folder,
so losing executors repeats one hop at most.

Where sizes are given and every sample fits in a task, lists and levels are bucketed by sample. Nothing is moved then, and a task
takes all hops of its samples in one go, some thousand nodes' arrays at a time: jobs and tables don't grow with hops.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from meshloom.functions.uniform import shuffle_key
from meshloom.operators.contraction import components
from meshloom.operators.topology import Cliques
from meshloom.operators.whole import are_long, by_sample, mesh_places, placed_edges, stacked, whole_parts, whole_samples
from meshloom.session import sample_parts, scratch_path, store_once, store_placed

#: Starts of a sample that advance together: the bits of a long.
WORD = 64
#: Hops between two looks at which samples are unfinished.
COMPACT_EVERY = 4
#: Sample ids that may be broadcast to drop lists (16 bytes each); more are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Samples of up to so many nodes lie in one task each; with larger ones all lists are spread by node.
TASK_NODES = 200_000
#: Neighbour lists that a task holds at once, or those of one sample.
SWEPT_ROWS = 50_000


class Lists:
    """Neighbour lists (sample_id, node_id, dsts), bucketed by sample if ``sizes`` (sample_id, n) tell that no sample is too large
    for a task, else by (sample_id, node_id).

    A list is bounded by the degree of a mesh node. The bucketing is what keeps edges in place from hop to
    hop: a checkpoint would lose it.
    """

    def __init__(self, edges: DataFrame, sizes: DataFrame | None = None):
        self.spark = edges.sparkSession
        self.parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.keys = ["sample_id", "node_id"]
        if sizes is not None:
            samples, largest = sizes.agg(F.count(F.lit(1)), F.max("n")).first()
            if samples and largest <= TASK_NODES:
                self.parts, self.keys = sample_parts(self.spark, samples), ["sample_id"]
        self.by_sample = self.keys == ["sample_id"]
        self.names: list[str] = []
        lists = edges.groupBy("sample_id", F.col("src").alias("node_id")).agg(F.collect_set("dst").alias("dsts"))
        self.whole = self._stored(lists.repartition(self.parts, *self.keys))
        self.all_samples = samples if self.by_sample else self.whole.select("sample_id").distinct().count()
        self.reset()

    def reset(self) -> None:
        self.now, self.samples = self.whole, self.all_samples

    def _stored(self, rows: DataFrame, path: str | None = None) -> DataFrame:
        path = path or scratch_path(self.spark, "edges")
        name = f"meshloom_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.parts, *self.keys).option("path", path).saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def level(self, rows: DataFrame, path: str, hop: int) -> tuple[DataFrame, int]:
        """``rows`` of a hop stored as the lists are, in a folder of ``path``, and how many they are."""
        seen_rows = Observation()
        counted = rows.withColumn("hops", F.lit(hop)).repartition(self.parts, *self.keys)
        counted = counted.observe(seen_rows, F.count(F.lit(1)).alias("n"))
        return self._stored(counted, f"{path}/hop-{hop}"), seen_rows.get["n"]

    def levels(self, path: str, like: DataFrame) -> DataFrame:
        """All hops stored in ``path`` as one table, in the same buckets where they lie by sample."""
        if not self.by_sample:
            return self.spark.read.schema(like.schema).option("recursiveFileLookup", True).parquet(path)
        name, columns = f"meshloom_{uuid.uuid4().hex}", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in like.schema)
        self.spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet OPTIONS (recursiveFileLookup 'true') "
            f"CLUSTERED BY ({', '.join(self.keys)}) INTO {self.parts} BUCKETS LOCATION '{path}'"
        )
        self.names.append(name)
        return self.spark.table(name)

    def keep(self, unfinished: DataFrame) -> None:
        """Drop the lists of other samples once half of the samples have finished."""
        left = unfinished.count()
        if 2 * left > self.samples:
            return
        if left <= BROADCAST_IDS:  # a scan of buckets, filtered in place, writes the same buckets
            kept = self.now.join(F.broadcast(unfinished), "sample_id", "left_semi")
        else:
            kept = self.now.join(unfinished, "sample_id", "left_semi").repartition(self.parts, *self.keys)
        self.now, self.samples = self._stored(kept.select("sample_id", "node_id", "dsts")), left

    def members(self, nodes: DataFrame, universe: str) -> DataFrame:
        """:func:`node_universe`, of which the used nodes are those that have a list."""
        return (nodes if universe == "all" else self.whole).select("sample_id", "node_id")

    def close(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE {name}")


@contextmanager
def neighbour_lists(edges: DataFrame, sizes: DataFrame | None = None) -> Iterator[Lists]:
    """The lists of ``edges``, for the time of the block."""
    lists = Lists(edges, sizes)
    try:
        yield lists
    finally:
        lists.close()


def breadth_first(lists: Lists, sources: DataFrame) -> DataFrame:
    """(sample_id, node_id, bits, hops): which starts reach a node in so many hops, and in no fewer.

    ``sources``: (sample_id, node_id, bits); nodes with the same bit act as one set.
    """
    lists.reset()
    path = scratch_path(lists.spark, "hops")
    frontier, found = lists.level(sources.groupBy("sample_id", "node_id").agg(F.bit_or("bits").alias("bits")), path, 0)
    if lists.by_sample:
        # A task's rows are one bucket: they are written as they lie.
        lists._stored(swept(lists, frontier), f"{path}/swept")
        return lists.levels(path, frontier)
    before, hop = frontier, 0
    while found:
        hop += 1
        if hop % COMPACT_EVERY == 0:
            lists.keep(frontier.select("sample_id").distinct())
        new = next_nodes(frontier, lists.now).groupBy("sample_id", "node_id").agg(F.bit_or("bits").alias("bits"))
        # Joined, not united with what was seen: a join keeps rows where they lie.
        for seen in [frontier] if hop == 1 else [frontier, before]:
            old = seen.select("sample_id", "node_id", F.col("bits").alias("_old")).hint("shuffle_hash")
            fresh = F.expr("bits & ~coalesce(_old, 0L)").alias("bits")
            new = new.join(old, ["sample_id", "node_id"], "left").select("sample_id", "node_id", fresh)
        before, (frontier, found) = frontier, lists.level(new.where("bits <> 0"), path, hop)
    return lists.levels(path, frontier)


def swept(lists: Lists, starts: DataFrame) -> DataFrame:
    """The rows of hop 1 and later of :func:`breadth_first`, for lists that lie by sample: task by task, without a shuffle."""
    named = starts.select("sample_id", "node_id", "bits").hint("shuffle_hash")
    rows = lists.whole.join(named, ["sample_id", "node_id"], "left").withColumn("bits", F.coalesce("bits", F.lit(0).cast("long")))
    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("sample_id", "node_id")]
    placed = rows.repartition(lists.parts, "sample_id").sortWithinPartitions("sample_id")
    return placed.mapInArrow(sweep(), ", ".join([*kinds, "bits long, hops int"]))


def sweep() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function that takes all hops from the nodes with ``bits``, over rows in order of samples. It holds all it calls: workers
    need not import this module."""
    whole, advance = whole_samples(SWEPT_ROWS), hop_by_hop()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for samples in whole(batches):
            yield from reached(samples.combine_chunks()).to_batches()

    def reached(table: pa.Table) -> pa.Table:
        sample, own, lists = (table[c].combine_chunks() for c in ("sample_id", "node_id", "dsts"))
        sample, names = sample.dictionary_encode(), pa.concat_arrays([own, lists.flatten().cast(own.type)]).dictionary_encode()
        count = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        code = sample.indices.to_numpy().astype(np.int64)
        keys = np.concatenate([code, np.repeat(code, count)]) * len(names.dictionary) + names.indices.to_numpy()
        place = pa.array(keys).dictionary_encode()
        nodes, place = place.dictionary.to_numpy(), place.indices.to_numpy()
        own, target = place[: len(code)], place[len(code) :]
        begin, degree, seen = (np.zeros(len(nodes), np.int64) for _ in range(3))
        begin[own], degree[own], seen[own] = np.cumsum(count) - count, count, table["bits"].to_numpy()
        at, bits, hops = advance(begin, degree, target, seen)
        return pa.table(
            {
                "sample_id": sample.dictionary.take(pa.array(nodes[at] // len(names.dictionary))),
                "node_id": names.dictionary.take(pa.array(nodes[at] % len(names.dictionary))),
                "bits": bits,
                "hops": hops,
            }
        )

    return run


def hop_by_hop() -> Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple]:
    """A function that takes all hops: place p has ``degree[p]`` neighbours in ``target`` from ``begin[p]``, and the bits ``seen[p]`` at
    hop 0. It gives places, bits and hops of what is reached later."""

    def advance(begin: np.ndarray, degree: np.ndarray, target: np.ndarray, seen: np.ndarray) -> tuple:
        gained, last = np.zeros(len(seen), np.int64), np.zeros(len(seen), np.int64)
        at = np.flatnonzero(seen)
        bits, levels = seen[at], []
        while degree[at].sum():
            n = degree[at]
            met = target[np.arange(n.sum()) + np.repeat(begin[at] - (np.cumsum(n) - n), n)]
            np.bitwise_or.at(gained, met, np.repeat(bits, n))
            fresh = gained[met] & ~seen[met]
            gained[met] = 0
            met, fresh = met[fresh != 0], fresh[fresh != 0]
            # A node that several neighbours reach counts once.
            last[met] = np.arange(len(met))
            once = last[met] == np.arange(len(met))
            at, bits = met[once], fresh[once]
            seen[at] |= bits
            levels.append((at, bits))
        at, bits = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*levels)) if levels else (seen[:0], seen[:0])
        return at, bits, np.repeat(np.arange(1, len(levels) + 1, dtype=np.int32), [len(x) for x, _ in levels])

    return advance


def next_nodes(frontier: DataFrame, lists: DataFrame) -> DataFrame:
    """Neighbours of a frontier. It is hashed, so the lists need no sort either."""
    met = frontier.hint("shuffle_hash").join(lists, ["sample_id", "node_id"])
    return met.select("sample_id", "bits", F.explode("dsts").alias("node_id"))


def node_universe(nodes: DataFrame, edges: DataFrame, universe: str) -> DataFrame:
    """``all`` counts every node of the sample, ``used`` only those on an edge."""
    if universe == "all":
        return nodes.select("sample_id", "node_id")
    return edges.select("sample_id", F.col("src").alias("node_id")).distinct()


def sample_sizes(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))


def bit(i: int) -> Column:
    return F.shiftleft(F.lit(1).cast("long"), i)


def holds(i: int) -> Column:
    return F.col("bits").bitwiseAND(bit(i)) != 0


def mesh_sweep(elements: DataFrame, sources: DataFrame, sizes: DataFrame, width: int) -> DataFrame | None:
    """:func:`breadth_first` over the :func:`undirected_edges` of elements, which a task makes, keeps and forgets some thousand rows at a
    time: neither edges nor lists are stored. None if a sample is too large for that, or ids aren't longs."""
    if not are_long((elements, "nodes"), (sources, "node_id"), (sources, "bits")):
        return None
    elements = elements.select("sample_id", "nodes").where("nodes is not null")
    parts = whole_parts(elements, sizes)
    if not parts:
        return None
    rows = stacked(elements, sources.where("node_id is not null"))
    numbered, edges, advance = mesh_places(width), placed_edges(), hop_by_hop()

    def step(table: pa.Table) -> pa.Table:
        sample, _, own, first, matrix, held, names = numbered(table)
        src, dst = edges(matrix, len(names))
        degree = np.bincount(src, minlength=len(names))
        seen = np.zeros(len(names), np.int64)
        np.bitwise_or.at(seen, first, table["bits"].combine_chunks().filter(pa.array(own)).to_numpy())
        start = np.flatnonzero(seen)
        zero = seen[start]
        at, bits, hops = advance(np.cumsum(degree) - degree, degree, dst, seen)
        at, bits, hops = np.append(start, at), np.append(zero, bits), np.append(np.zeros(len(start), np.int32), hops)
        return pa.table(
            {"sample_id": sample.dictionary.take(pa.array(held[at])), "node_id": names[at], "bits": bits, "hops": hops}
        )

    kind = sources.schema["sample_id"].dataType.simpleString()
    found = by_sample(rows, parts, step, f"sample_id {kind}, node_id long, bits long, hops int")
    return store_placed(found, "hops", "sample_id", parts, lies=True)


def hops_to_sources(
    nodes: DataFrame, edges: DataFrame | Cliques, flags: dict[str, str]
) -> DataFrame:
    """Hop count from each node to the nearest flagged node.

    ``flags`` maps an output column to a boolean column of ``nodes``. Unreached
    nodes get the sample's node count. Edges that are :class:`Cliques` of elements are made where small samples lie.
    """
    tagged = sum((F.when(F.col(flag), bit(i)).otherwise(0) for i, flag in enumerate(flags.values())), F.lit(0).cast("long"))
    sources = nodes.select("sample_id", "node_id", tagged.alias("bits")).where("bits <> 0")
    sizes = store_once(sample_sizes(nodes), "sizes")
    found = mesh_sweep(edges.elements, sources, sizes, edges.width) if isinstance(edges, Cliques) else None
    if found is None:
        with neighbour_lists(edges.edges() if isinstance(edges, Cliques) else edges, sizes) as lists:
            found = breadth_first(lists, sources)
    wide = found.groupBy("sample_id", "node_id").agg(
        *[F.min(F.when(holds(i), F.col("hops"))).alias(n) for i, n in enumerate(flags)]
    )
    return (
        nodes.select("sample_id", "node_id")
        .join(wide.hint("shuffle_hash"), ["sample_id", "node_id"], "left")
        .join(sizes.withColumnRenamed("n", "_n"), "sample_id")
        .select(
            "sample_id",
            "node_id",
            *[F.coalesce(F.col(n), F.col("_n")).cast("int").alias(n) for n in flags],
        )
    )


def numbered(rows: DataFrame, order: list[Column], count: int) -> DataFrame:
    """The first ``count`` rows of each sample (``count`` a task, before the shuffle), each with its own bit."""
    place = Window.partitionBy("sample_id").orderBy(*order)
    first = rows.withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= count)
    return first.select("sample_id", "node_id", F.expr("shiftleft(1L, _place - 1)").alias("bits"))


def seeded_starts(universe: DataFrame, count: int, seed: int) -> DataFrame:
    """Up to ``count`` starts per sample, the smallest digests."""
    digest = shuffle_key(seed, F.concat_ws("|", "sample_id", "node_id"), "start")
    return numbered(universe.withColumn("_digest", digest), [F.col("_digest"), F.col("node_id")], count)


def graph_diameter(
    nodes: DataFrame,
    edges: DataFrame,
    universe: str = "used",
    starts: int = 5,
    seed: int = 42,
) -> DataFrame:
    """Double-sweep diameter per sample: a lower bound that is exact on trees.

    Each start (64 at most) sweeps to its farthest node (ties: smallest id), then from there;
    the largest eccentricity wins. A disconnected sample gives -1; a sample without
    edges gives 0 if it has one node, else -1.
    """
    counts = store_once(sample_sizes(nodes), "sizes")
    with neighbour_lists(edges, counts) as lists:
        members = lists.members(nodes, universe)
        first = breadth_first(lists, seeded_starts(members, starts, seed))
        spot = F.struct("hops", (-F.col("node_id")).alias("neg"))
        ends = first.groupBy("sample_id").agg(*[F.max(F.when(holds(i), spot)).alias(f"_{i}") for i in range(starts)])
        each = F.array(*[F.struct((-F.col(f"_{i}.neg")).alias("node_id"), bit(i).alias("bits")) for i in range(starts)])
        far = ends.select("sample_id", F.explode(each).alias("s")).select("sample_id", "s.*").where("node_id is not null")
        second = breadth_first(lists, far)
    reached = F.least(*[F.nullif(F.count_if(holds(i)), F.lit(0)) for i in range(starts)], F.count(F.lit(1)))
    sweeps = second.groupBy("sample_id").agg(F.max("hops").alias("ecc"), reached.alias("reached"))
    sizes = sample_sizes(members)
    counts = counts.withColumnRenamed("n", "nodes")
    found = counts.join(sizes.join(sweeps, "sample_id"), "sample_id", "left")
    return found.select(
        "sample_id",
        F.when(F.col("n").isNull(), without_edges())
        .when(F.col("reached") < F.col("n"), -1)
        .otherwise(F.col("ecc"))
        .alias("graph_diameter"),
    )


def without_edges() -> Column:
    return F.when(F.col("nodes") == 1, 0).otherwise(-1)


def exact_diameter(
    nodes: DataFrame, edges: DataFrame, universe: str = "used", most_starts: int = 4096, seed: int = 42
) -> DataFrame:
    """Diameter per sample, and whether it is ``exact``: always so for samples of up to ``most_starts`` nodes.

    Starts are swept 64 at a time. A start with eccentricity e at distance d from a node bounds that node's
    eccentricity by e + d, so only nodes whose bound is above the largest eccentricity found are candidates for the next
    starts, the highest bounds first. A sample without candidates is exact and leaves; above ``most_starts`` starts what is found is a
    lower bound, flagged as not exact. Disconnected samples and those without edges as in :func:`graph_diameter`.
    """
    counts = store_once(sample_sizes(nodes), "sizes")
    done, lower, swept = None, None, 0
    with neighbour_lists(edges, counts) as lists:
        members = lists.members(nodes, universe)
        bounds = members.withColumn("bound", F.lit(None).cast("int"))
        sources, sizes = store_once(seeded_starts(members, WORD, seed), "starts"), sample_sizes(members)
        while True:
            levels = breadth_first(lists, sources)
            ecc = eccentricities(levels)
            swept += WORD
            best = ecc.select("sample_id", F.array_max("classes.ecc").alias("lower"))
            if lower is None:
                spread = store_once(reached_by_all(levels).join(sizes, "sample_id"), "reached")
                done = spread.select("sample_id", (F.col("common") & (F.col("reached") == F.col("n"))).alias("connected"))
                best = best.join(done.where("connected"), "sample_id", "left_semi")
            else:
                best = lower.join(best.withColumnRenamed("lower", "_now"), "sample_id", "left").select(
                    "sample_id", F.greatest("lower", "_now").alias("lower")
                )
            lower = store_once(best, "lower")
            bounds = store_once(bounded(bounds, levels, ecc, sources, lower), "bounds")
            if bounds.isEmpty() or swept >= most_starts:
                break
            sources = store_once(numbered(bounds, [F.col("bound").desc(), F.col("node_id")], WORD), "starts")
    open_ = bounds.select("sample_id").distinct().withColumn("_open", F.lit(True))
    counts = counts.withColumnRenamed("n", "nodes")
    found = counts.join(done, "sample_id", "left").join(lower, "sample_id", "left").join(open_, "sample_id", "left")
    return found.select(
        "sample_id",
        F.when(F.col("connected").isNull(), without_edges())
        .when(~F.col("connected"), -1)
        .otherwise(F.col("lower"))
        .alias("diameter"),
        F.col("_open").isNull().alias("exact"),
    )


def eccentricities(levels: DataFrame) -> DataFrame:
    """sample_id and ``classes``: of each eccentricity among its starts, the bits of the starts that have it."""
    alive = levels.groupBy("sample_id", "hops").agg(F.bit_or("bits").alias("bits"))
    # A start alive at a hop was alive at every hop before: it ends where the next hop lacks it.
    ordered = alive.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("hops", "bits"))).alias("a"))
    ended = F.transform(
        "a", lambda x, i: F.struct(
            x["hops"].alias("ecc"),
            x["bits"].bitwiseAND(F.bitwise_not(F.coalesce(F.get(F.col("a"), i + 1)["bits"], F.lit(0).cast("long")))).alias("bits"),
        ),
    )
    return ordered.select("sample_id", F.filter(ended, lambda x: x["bits"] != 0).alias("classes"))


def reached_by_all(levels: DataFrame) -> DataFrame:
    """How many nodes are reached at all, and whether every start of the sample reaches each of them."""
    nodes = levels.groupBy("sample_id", "node_id").agg(F.bit_or("bits").alias("bits"))
    return nodes.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("reached"), (F.bit_and("bits") == F.bit_or("bits")).alias("common")
    )


def bounded(bounds: DataFrame, levels: DataFrame, ecc: DataFrame, sources: DataFrame, lower: DataFrame) -> DataFrame:
    """The nodes that may still have a larger eccentricity than the largest found in their sample, with their bounds."""
    least = F.array_min(F.transform(
        F.filter("classes", lambda c: c["bits"].bitwiseAND(F.col("bits")) != 0), lambda c: c["ecc"]
    ))
    none, no = F.lit(None).cast("int").alias("bound"), F.lit(False)
    told = levels.join(ecc, "sample_id").select(
        "sample_id", "node_id", (F.col("hops") + least).alias("bound"), no.alias("open"), no.alias("swept")
    )
    merged = (
        bounds.select("sample_id", "node_id", "bound", F.lit(True).alias("open"), no.alias("swept"))
        .unionByName(told)
        .unionByName(sources.select("sample_id", "node_id", none, no.alias("open"), F.lit(True).alias("swept")))
    )
    nodes = merged.groupBy("sample_id", "node_id").agg(
        F.min("bound").alias("bound"), F.bool_or("open").alias("open"), F.bool_or("swept").alias("swept")
    )
    left = nodes.where("open and not swept").join(lower, "sample_id")
    return left.where("bound > lower").select("sample_id", "node_id", "bound")


def connectivity(nodes: DataFrame, edges: DataFrame, universe: str = "all") -> DataFrame:
    """Whether all nodes of a sample are one component."""
    found = components(node_universe(nodes, edges, universe), edges)
    one = F.min("component") == F.max("component")
    return found.groupBy("sample_id").agg(one.alias("is_connected"))
