"""Near-duplicate documents by an n-gram Jaccard join with adaptive multi-match prefixes.

If two sets of shingles have a Jaccard similarity of at least t, then in any fixed order of shingles
their first |s| - ceil(t|s|) + l share at least l: the longer the prefix, the more matches it must show.

1. Documents with equal sets are one node.
2. In order of hash, each node counts which of its prefix shingles occur in other nodes. A node with too few
   links with nothing; l is a share of a set's size here. No pair is formed.
3. The others order their shingles by frequency, rarest first. Each chooses the l with the least estimated
   cost: the lists that its prefix reads, and a verification for each candidate these can yield with l matches.
4. Nodes sharing a shingle of their prefixes are candidates. Where many nodes share much (a family of
   near copies), pairs are not listed: in each round a node is compared with one pivot of its lists, and
   linked nodes become one component. Pairs within a component need no comparing, so the next round orders
   shingles anew: those of one component alone come first and match nothing. When a round links few
   nodes, the pairs left between components are found and verified:
   a. Each node has a centre, the pivot it meets most. Let p be the shingles that most nodes of the centre hold (a pivot
      has changes of its own, which would be common to all) and D(u) the shingles of just one of u and p. Sets u and v of one
      centre differ by |D(u)| + |D(v)| - 2 |D(u) & D(v)| shingles. Unless both link with the member nearest to p they
      can link only if D(u) and D(v) share enough: steps 2 and 3 again, on the sets D, by place in the order too. A family
      of near copies shares nearly all shingles but few changes, so its lists become short where they would hold every member.
   b. Nodes of different centres are listed by shared prefix shingles: within a list only centres meet first.
   Those with min(l, l') matches or more are verified.

All links between different texts count, so components are exact, up to equal 64-bit hashes. Null and
empty texts have no shingles and link with nothing; a text with fewer words than a shingle is one
shingle. Long texts are used whole. Rows with a null id take part, but a component is named by its smallest
id (null only if it has none). Repeated rows are equal sets. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import ExitStack
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshloom.llm.common import by_ids, free_name, small_batches, table, text_of
from meshloom.llm.components import components
from meshloom.session import store_once, stored_for_now

#: Texts are shingled in batches of about this many characters.
BATCH_CHARS = 2 << 20


@dataclass(frozen=True)
class Join:
    """Words a shingle, the similarity as a fraction, and how far prefixes may grow."""

    words: int = 3
    num: int = 9
    den: int = 10
    #: Matches asked for in step 2, as a share of the set.
    sieve: float = 0.1
    longest: int = 16
    #: Estimated cost of a verification, in list entries read.
    verification: float = 20.0
    #: Rounds go on while at least this share of the nodes in them finds its pivot similar.
    yielding: float = 0.05
    rounds: int = 12

    def prefix(self, n: int, matches: int) -> int:
        return min(n, n - self.least_overlap(n) + matches)

    def least_overlap(self, n: int) -> int:
        """Shingles that a set of n must share with one it links with; also the least size of that one."""
        return -((-self.num * n) // self.den)

    def excess(self, apart: int, n: int, m: int) -> int:
        """Above 0 where sets of n and m with ``apart`` shingles in just one of them don't link."""
        return apart * (self.den + self.num) - (n + m) * (self.den - self.num)

    def sieve_matches(self, n: int) -> int:
        return 1 + int(self.sieve * n)

    def links(self, shared: int, n: int, m: int) -> bool:
        return self.den * shared >= self.num * (n + m - shared)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Ascending distinct 64-bit hashes of the shingles of each text."""
    spaced = pc.replace_substring_regex(pc.ascii_lower(texts), r"[\x09-\x0D]", " ")
    split = pc.split_pattern(spaced, " ")
    ends = split.offsets.to_numpy() - split.offsets[0].as_py()
    coded = split.flatten().dictionary_encode()
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()] or [0], dtype=np.uint64)
    filled = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)
    code = coded.indices.to_numpy()
    out = []
    for i in range(len(texts)):
        c = code[ends[i] : ends[i + 1]]
        h = hashes[c[filled[c]]] if len(c) else hashes[:0]
        k = min(words, len(h))
        if not k:
            out.append(h)
            continue
        s = np.full(len(h) - k + 1, k, dtype=np.uint64)
        for j in range(k):
            s = _mixed((s ^ h[j : len(h) - k + 1 + j]) * np.uint64(0x9E3779B97F4A7C15))
        out.append(np.unique(s))
    return out


def set_key(s: np.ndarray) -> int:
    """The node of a set: a signed 64-bit hash of its shingles."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    part = np.cumsum(pc.utf8_length(batch["text"]).to_numpy()) // BATCH_CHARS
    bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(bounds, bounds[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def over_sets(docs: DataFrame, join: Join, make: Callable, schema: str) -> DataFrame:
    """Apply ``make(batch, sets)``, which gives a table of ``schema``, to the texts of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield from make(part, shingle_sets(part["text"], join.words)).to_batches()

    return docs.mapInArrow(run, schema)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def document_nodes(docs: DataFrame, join: Join) -> DataFrame:
    """doc_id, ref, text_hash, n_shingles and node (null for an empty set) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make(batch: pa.RecordBatch, sets: list[np.ndarray]) -> pa.Table:
        return pa.table(
            {
                "doc_id": batch["doc_id"],
                "ref": batch["ref"],
                "text_hash": batch["text_hash"],
                "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "node": pa.array([set_key(s) if len(s) else None for s in sets], pa.int64()),
            }
        )

    return over_sets(docs, join, make, f"doc_id {kind}, ref string, text_hash long, n_shingles long, node long")


def sieved(docs: DataFrame, nodes: DataFrame, join: Join) -> DataFrame:
    """ref and node of the nodes that may link at all: those with enough shared shingles in their prefix by hash."""

    def make(batch: pa.RecordBatch, sets: list[np.ndarray]) -> pa.Table:
        # A shingle in several nodes of the batch is shared: it is sent once, marked, and counted here.
        prefixes = {}
        for s in sets:
            if len(s):
                prefixes[set_key(s)] = s[: join.prefix(len(s), join.sieve_matches(len(s)))]
        keys = np.fromiter(prefixes, np.int64, len(prefixes))
        lengths = np.fromiter(map(len, prefixes.values()), np.int64, len(prefixes))
        shingles = np.concatenate([*prefixes.values(), np.zeros(0, np.uint64)])
        owner = np.repeat(keys, lengths)
        distinct, first, inverse, count = np.unique(shingles, return_index=True, return_inverse=True, return_counts=True)
        many = count > 1
        marks = many[inverse].astype(np.int64)
        here = np.add.reduceat(marks, np.cumsum(lengths) - lengths) if len(keys) else marks
        some = here > 0
        return pa.table(
            {
                "h": pa.concat_arrays([signed(distinct), pa.nulls(int(some.sum()), pa.int64())]),
                "node": pa.array(
                    np.concatenate([owner[first], keys[some]]), mask=np.concatenate([many, np.zeros(int(some.sum()), bool)])
                ),
                "here": pa.array(np.concatenate([np.zeros(len(distinct), np.int64), here[some]]), pa.int64()),
            }
        )

    with stored_for_now(over_sets(docs.select("text"), join, make, "h long, node long, here long"), "prefixes") as sent:
        return store_once(sharing(sent, nodes, join).select("ref", "node"), "wanted")


def sharing(sent: DataFrame, nodes: DataFrame, join: Join) -> DataFrame:
    """The nodes with enough shared shingles among those ``sent``."""
    # A batch sends a shingle once, so combining before the shuffle would save nothing, and a shingle that a third of
    # all documents hold has a row a batch here, not a row a document: one window is enough.
    among = Window.partitionBy("h")
    several = (F.min("node").over(among) < F.max("node").over(among)) | (
        F.count("node").over(among) < F.count(F.lit(1)).over(among)
    )
    held = sent.filter("h is not null").select("h", "node").withColumn("shared", several)
    found = held.filter("shared and node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("here"))
    # Batches that hold copies of a node may count a shingle twice, which keeps a node too many at worst.
    local = sent.filter("h is null").groupBy("node").agg(F.sum("here").alias("here"))
    total = found.unionByName(local).groupBy("node").agg(F.sum("here").alias("shared"))
    # Two sets share min(l, l') shingles of their prefixes, and the other set may be the smaller one.
    smallest = F.ceil(F.col("n") * join.num / join.den)
    return nodes.join(total, "node").filter(F.col("shared") >= 1 + F.floor(smallest * join.sieve))


def sets_of(docs: DataFrame, wanted: DataFrame, join: Join) -> DataFrame:
    """node, n and the shingles (bytes) of the ``wanted`` nodes (a stored table), from one document of each."""

    def make(batch: pa.RecordBatch, sets: list[np.ndarray]) -> pa.Table:
        # A repeated id may stand for other texts too: only the text of the node counts.
        own = [(k, len(s), s.tobytes()) for k, s in zip(batch["node"].to_pylist(), sets, strict=True) if len(s) and set_key(s) == k]
        return pa.table(
            {
                "node": pa.array([x[0] for x in own], pa.int64()),
                "n": pa.array([x[1] for x in own], pa.int64()),
                "shingles": pa.array([x[2] for x in own], pa.binary()),
            }
        )

    read = by_ids(docs.select("ref", "text"), wanted, "ref").select("node", "text")
    sets = store_once(over_sets(read, join, make, "node long, n long, shingles binary"), "sets")
    # Repeated rows give their set again.
    return sets if sets.count() <= wanted.count() else store_once(sets.dropDuplicates(["node"]), "sets")


def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, node, comp, n, size and need of every shingle (or change) in the binary column ``shingles``."""
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            sizes = part["size"].to_numpy()
            h = np.concatenate([np.frombuffer(d.as_buffer(), dtype=np.int64) for d in part["shingles"]])
            names = ["node", "comp", "n", "size", "need"]
            columns = [pa.array(np.repeat(part[c].to_numpy(), sizes)) for c in names]
            yield pa.RecordBatch.from_arrays([pa.array(h), *columns], names=["h", *names])


def prefix_entries(placed: DataFrame, join: Join) -> DataFrame:
    """h, node, n, size, matches, single (shingles that no other component has) and rest: the rest of each node's chosen prefix.

    ``rest``: how many shingles of the node that others have come later in the order than h.
    ``placed`` has node, comp, n, size, shingles and need, the least overlap with a set that links.
    """
    listed = placed.select("node", "comp", "n", "size", "need", "shingles").mapInArrow(
        tokens, "h long, node long, comp long, n long, size long, need long"
    )
    frequency = (
        listed.groupBy("h")
        .agg(F.count(F.lit(1)).alias("df"), F.min("comp").alias("a"), F.max("comp").alias("b"))
        .filter("a < b")
        .select("h", "df")
    )
    known = (
        listed.drop("comp")
        .join(frequency, "h")
        .groupBy("node", "n", "size", "need")
        .agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("shared"))
    )

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(7)]
            lists = batch["shared"]
            ends, fields = lists.offsets.to_numpy(), lists.values
            df_all, h_all = fields.field("df").to_numpy(), fields.field("h").to_numpy()
            rows = zip(*(batch[c].to_pylist() for c in ("node", "n", "size", "need")), strict=True)
            for i, (node, n, held, need) in enumerate(rows):
                df, h = df_all[ends[i] : ends[i + 1]], h_all[ends[i] : ends[i + 1]]
                single = held - len(df)  # these come first in the order and match nothing
                matches = np.arange(1, min(join.longest, need) + 1)
                sizes = np.clip(held - need + matches - single, 0, len(df))
                read = np.append(0, np.cumsum(df - 1))[sizes]
                best = int(np.argmin(read + join.verification * read / matches))
                size, k = int(sizes[best]), int(matches[best])
                if size < k:  # too few shared shingles for this many matches
                    continue
                rest = len(df) - 1 - np.arange(size)
                for column, x in zip(out, (h[:size], *(np.full(size, v) for v in (node, n, held, k, single)), rest), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([*c, np.zeros(0, np.int64)]).astype(np.int64)) for c in out],
                names=["h", "node", "n", "size", "matches", "single", "rest"],
            )

    return known.mapInArrow(choose, "h long, node long, n long, size long, matches long, single long, rest long")


def shingle_entries(sets: DataFrame, comp: DataFrame | None, join: Join) -> DataFrame:
    need = F.ceil(F.col("n") * join.num / join.den).cast("long")
    return prefix_entries(with_components(sets, comp).withColumn("size", F.col("n")).withColumn("need", need), join).drop("rest")


def verified(pairs: DataFrame, sets: DataFrame, join: Join) -> DataFrame:
    """The pairs (u, v) of nodes that link; ``pairs`` and ``sets`` are stored tables."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch["a"], batch["b"], strict=True)
            keep = []
            for a, b in rows:
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                keep.append(join.links(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["u"].filter(mask), batch["v"].filter(mask)], names=["u", "v"])

    left = by_ids(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), pairs, "u")
    ends = store_once(pairs.select("v").distinct(), "ends")
    right = by_ids(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), ends, "v")
    return left.join(right, "v").select("u", "v", "a", "b").mapInArrow(compare, "u long, v long")


def with_components(df: DataFrame, comp: DataFrame | None) -> DataFrame:
    """Add the component of each node, itself if it is in none."""
    if comp is None:
        return df.withColumn("comp", F.col("node"))
    return df.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def near_components(sets: DataFrame, join: Join) -> DataFrame:
    """node and comp (the least node of its component) of all nodes that link with another."""
    comp, open_sets, listing = None, sets, False
    for turn in range(join.rounds + 1):
        with ExitStack() as tables:
            with stored_for_now(shingle_entries(open_sets, comp, join), "entries") as entries:
                placed = with_components(entries, comp)
                shared = placed.groupBy("h").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a < b")
                live = tables.enter_context(stored_for_now(placed.join(shared.select("h"), "h"), "live"))
            # A node outside these lists has no link to another component.
            nodes = store_once(live.select("node").distinct(), "open")
            left = nodes.count()
            if not left:
                break
            if not listing and turn < join.rounds:
                links = linked(pivot_pairs(live, join, turn), sets, join)
                found = links.count()
                listing = found < join.yielding * left
                if found:
                    comp = merged(comp, links)
                    open_sets = by_ids(sets, nodes, "node")
                    continue
            links = linked(listed_pairs(live, sets, join), sets, join)
            if not links.isEmpty():
                comp = merged(comp, links)
            break
    return comp if comp is not None else sets.select("node", F.col("node").alias("comp")).limit(0)


def linked(pairs: DataFrame, sets: DataFrame, join: Join) -> DataFrame:
    with stored_for_now(pairs, "pairs") as stored:
        return store_once(verified(stored, sets, join), "linked")


def merged(comp: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after more links between nodes."""
    edges = links if comp is None else joined_components(links, comp)
    return store_once(moved(comp, components(edges)), "components")


def joined_components(links: DataFrame, comp: DataFrame) -> DataFrame:
    """Links between nodes as links between their components."""
    for end in ("u", "v"):
        named = comp.select(F.col("node").alias(end), "comp")
        links = links.join(named, end, "left").withColumn(end, F.coalesce("comp", end)).drop("comp")
    return links.select("u", "v")


def moved(comp: DataFrame | None, roots: DataFrame) -> DataFrame:
    """Components after ``roots`` (u: old component, v: new one)."""
    fresh = roots.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("comp"))
    )
    if comp is None:
        return fresh.distinct()
    known = comp.join(roots.select(F.col("u").alias("comp"), F.col("v").alias("root")), "comp", "left")
    return (
        known.select("node", F.coalesce("root", "comp").alias("comp"))
        .unionByName(fresh.join(comp.select("node"), "node", "left_anti"))
        .groupBy("node")
        .agg(F.min("comp").alias("comp"))
    )


def may_link(join: Join, n: str, m: str, single_n: str, single_m: str) -> Column:
    """Whether sets of n and m, of which so many shingles occur in no other component, can be similar enough."""
    most = F.least(F.col(n) - F.col(single_n), F.col(m) - F.col(single_m))
    return most * (join.num + join.den) >= (F.col(n) + F.col(m)) * join.num


def list_pivots(live: DataFrame, turn: int) -> DataFrame:
    """h and p: the pivot of each list, its node with the smallest share of single shingles.

    Near copies differ from one another by the changes of both, so the least changed one links with most of them.
    """
    changed = (F.col("single") / F.col("n")).alias("changed")
    member = F.struct(changed, F.xxhash64(F.lit(turn), "node").alias("draw"), "node", "comp", "n", "matches", "single")
    return live.groupBy("h").agg(F.min(member).alias("p"))


def pivot_pairs(live: DataFrame, join: Join, turn: int) -> DataFrame:
    """Each node with the one pivot of its lists that shares most of them, if it is of another component."""
    met = live.join(list_pivots(live, turn), "h").select(
        "node", "n", "single", "comp", F.least("matches", "p.matches").alias("asked"), F.col("p.node").alias("pivot"),
        F.col("p.n").alias("pn"), F.col("p.single").alias("psingle"), F.col("p.comp").alias("pcomp"),
    )
    shared = (
        met.filter("comp <> pcomp")
        .filter(may_link(join, "n", "pn", "single", "psingle"))
        .groupBy("node", "pivot", "asked")
        .agg(F.count(F.lit(1)).alias("shared"))
        .filter("shared >= asked")
    )
    best = shared.groupBy("node").agg(F.max(F.struct("shared", "pivot")).alias("b"))
    return best.select(F.col("node").alias("u"), F.col("b.pivot").alias("v"))


def centred(live: DataFrame) -> DataFrame:
    """node, comp and centre: of the pivots that a node meets in many of its lists, the first in the order of pivots.

    Any pivot is right. Pivots of a family follow one order, so its members mostly agree on one, whichever they meet most.
    """
    rank = F.struct("p.changed", "p.draw", F.col("p.node").alias("pivot"))
    met = live.join(list_pivots(live, 0), "h").groupBy("node", "comp", rank.alias("rank")).agg(F.count(F.lit(1)).alias("lists"))
    most = met.groupBy("node").agg(F.max("lists").alias("most"))
    often = met.join(most, "node").filter(4 * F.col("lists") >= F.col("most"))
    return often.groupBy("node", "comp").agg(F.min("rank").alias("r")).select("node", "comp", F.col("r.pivot").alias("centre"))


def middles(centres: DataFrame, sets: DataFrame) -> DataFrame:
    """centre and middle: the shingles that more than half of its nodes hold, for centres of two nodes or more."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                held = [np.frombuffer(d.as_buffer(), dtype=np.int64) for d in part["shingles"]]
                centre = np.repeat(part["centre"].to_numpy(), [len(x) for x in held])
                yield pa.RecordBatch.from_arrays([pa.array(centre), pa.array(np.concatenate(held))], names=["centre", "h"])

    members = centres.groupBy("centre").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    held = centres.select("node", "centre").join(sets.select("node", "shingles"), "node")
    counts = held.select("centre", "shingles").mapInArrow(spread, "centre long, h long").groupBy("centre", "h").count()
    most = counts.join(members, "centre").filter(2 * F.col("count") > F.col("members"))
    found = most.groupBy("centre").agg(F.collect_list("h").alias("middle"))
    return members.join(found, "centre", "left").select("centre", F.coalesce("middle", F.array().cast("array<long>")).alias("middle"))


def changes(centres: DataFrame, sets: DataFrame, join: Join) -> DataFrame:
    """node, comp, centre, n, size, slack, excess and shingles: the hashed changes of each node from the middle of its centre."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["node", "comp", "centre", "n", "size", "slack", "excess", "shingles"]
        kinds = [*[pa.int64()] * 7, pa.binary()]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            rows = zip(*(batch[c].to_pylist() for c in ("node", "comp", "centre")), batch["a"], batch["middle"], strict=True)
            for node, comp, centre, a, middle in rows:
                x, y = np.frombuffer(a.as_buffer(), np.uint64), middle.values.to_numpy().view(np.uint64)
                d = np.setxor1d(x, y, assume_unique=True)
                # A change counts for its centre only.
                keys = _mixed((d ^ np.uint64(centre % (1 << 64))) * np.uint64(0x9E3779B97F4A7C15))
                row = (node, comp, centre, len(x), len(d), -join.excess(len(d), len(x), 0), join.excess(len(d), len(x), len(y)))
                for column, value in zip(out, (*row, keys.tobytes()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    placed = centres.join(sets.select("node", F.col("shingles").alias("a")), "node").join(middles(centres, sets), "centre")
    schema = "node long, comp long, centre long, n long, size long, slack long, excess long, shingles binary"
    return placed.select("node", "comp", "centre", "a", "middle").mapInArrow(compare, schema)


def with_needs(changed: DataFrame, join: Join) -> DataFrame:
    """Add anchor, linked and need, and let all components of a centre with a linked node be one.

    Let sets u and v have the middle p, and c = (den - num) / (den + num). They link if |D(u)| + |D(v)| - 2 o is at most
    c (|u| + |v|), where o changes are common. With slack(u) = c |u| - |D(u)| that is 2 o >= -slack(u) - slack(v). So u
    links with the node of most slack, the anchor, whatever they share, or needs o >= -(slack(u) + slack(anchor)) / 2 > 0 with
    any node. As | |v| - |p| | <= |D(v)| and o <= |D(v)|, it also takes o >= (|D(u)| - c (|u| + |p|)) / (1 + c).
    Nodes of the anchor's component meet others only, so they need at least what the least of these does.
    """
    most = changed.groupBy("centre").agg(F.max(F.struct("slack", F.col("node").alias("anchor"), F.col("comp").alias("to"))).alias("m"))
    both = F.col("slack") + F.col("m.slack")
    placed = changed.join(most, "centre").select(
        "node", "comp", "centre", "n", "size", "shingles", "m.anchor", "m.to",
        ((F.col("node") == F.col("m.anchor")) | (both >= 0)).alias("linked"),
        F.greatest(F.lit(1), F.ceil(-both / (2 * (join.den + join.num))), F.ceil(F.col("excess") / (2 * join.den))).cast("long").alias("need"),
    )
    near = placed.filter("linked").select("centre", "comp", F.lit(True).alias("near")).distinct()
    marked = placed.join(near, ["centre", "comp"], "left").withColumn("near", F.col("near").isNotNull())
    least = marked.filter("not near").groupBy("centre").agg(F.min("need").alias("least"))
    own = F.when(F.col("linked"), 1).otherwise(F.col("need"))
    return marked.join(least, "centre", "left").select(
        "node", F.when(F.col("near"), F.col("to")).otherwise(F.col("comp")).alias("comp"), "centre", "n", "size", "shingles", "anchor",
        "linked", F.when(F.col("near"), F.greatest(own, "least")).otherwise(own).alias("need"), "least",
    )


def counted_pairs(met: DataFrame) -> DataFrame:
    return (
        met.groupBy(F.col("u_node").alias("u"), F.col("v_node").alias("v"), F.least("u_matches", "v_matches").alias("asked"))
        .agg(F.count(F.lit(1)).alias("shared"))
        .filter("shared >= asked")
        .select("u", "v")
    )


def sides(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tuple(df.select(*[F.col(c).alias(f"{side}_{c}") for c in df.columns]) for side in "uv")


def same_centre_pairs(changed: DataFrame, join: Join) -> DataFrame:
    """Pairs of one centre and different components that share enough changes in their prefixes."""
    # Without a component beside the anchor's there is nothing to compare.
    open_ = changed.filter("size > 0 and least is not null")
    entries = prefix_entries(open_, join).join(changed.select("node", "comp"), "node")
    u, v = sides(store_once(entries, "changes"))
    # Changes that no other component has can't be common, nor can those that come before the first matches.
    most = F.least(
        *[F.col(f"{s}_size") - F.col(f"{s}_single") for s in "uv"],
        F.least("u_matches", "v_matches") + F.least("u_rest", "v_rest"),
    )
    apart = F.col("u_size") + F.col("v_size") - 2 * most
    met = (
        (F.col("u_h") == F.col("v_h"))
        & (F.col("u_node") < F.col("v_node"))
        & (F.col("u_comp") != F.col("v_comp"))
        & (apart * (join.den + join.num) <= (F.col("u_n") + F.col("v_n")) * (join.den - join.num))
    )
    return counted_pairs(u.join(v, met))


def other_centre_pairs(live: DataFrame, centres: DataFrame, join: Join) -> DataFrame:
    """Pairs of different centres and components that share enough shingles in their prefixes."""
    placed = store_once(live.join(centres.select("node", "centre"), "node"), "placed")
    a, b = sides(placed.select("h", "centre").distinct())
    # The centres of a list meet before their nodes do, so nodes of one centre never do here.
    pairs = a.join(b, (F.col("u_h") == F.col("v_h")) & (F.col("u_centre") < F.col("v_centre"))).drop("v_h")
    u, v = sides(placed)
    v = v.withColumnRenamed("v_h", "u_h")
    met = pairs.join(u, ["u_h", "u_centre"]).join(v, ["u_h", "v_centre"])
    may = (F.col("u_comp") != F.col("v_comp")) & may_link(join, "u_n", "v_n", "u_single", "v_single")
    return counted_pairs(met.filter(may))


def listed_pairs(live: DataFrame, sets: DataFrame, join: Join) -> DataFrame:
    """All pairs of different components that may link, and the nodes that link with the anchor of their centre."""
    centres = store_once(centred(live), "centred")
    changed = store_once(with_needs(store_once(changes(centres, sets, join), "from-middles"), join), "changed")
    direct = changed.filter("linked and node <> anchor").select(F.col("node").alias("u"), F.col("anchor").alias("v"))
    return direct.unionByName(same_centre_pairs(changed, join)).unionByName(other_centre_pairs(live, centres, join))


def referred(df: DataFrame) -> DataFrame:
    """doc_id, ref, text_hash and text (a null being empty): ref and text_hash tell different rows apart."""
    # A row without an id is found again by its text.
    ref = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.hex("text_hash")))
    docs = df.select("doc_id", text_of().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    return docs.select("doc_id", ref.alias("ref"), "text_hash", "text")


def grouped(df: DataFrame, join: Join) -> DataFrame:
    """doc_id, ref, text_hash, n_shingles, root (a node of its group; null without shingles) and component_id of every row."""
    small_batches(df.sparkSession)
    docs = referred(df)
    rows = store_once(document_nodes(docs, join), "nodes")
    nodes = store_once(
        rows.filter("node is not null")
        .groupBy("node")
        .agg(F.max("n_shingles").alias("n"), F.min("doc_id").alias("first_doc"), F.min("ref").alias("ref")),
        "distinct",
    )
    sets = sets_of(docs, sieved(docs, nodes, join), join)
    comp = near_components(sets, join)
    named = nodes.select("node", "first_doc").join(comp, "node")
    first = named.groupBy("comp").agg(F.min("first_doc").alias("component"))
    linked = named.join(first, "comp").select("node", "comp", "component")
    groups = nodes.select("node", "first_doc").join(linked, "node", "left").select(
        "node", F.coalesce("comp", "node").alias("root"), F.coalesce("component", "first_doc").alias("component_id")
    )
    return rows.join(groups, "node", "left").select(
        "doc_id",
        "ref",
        "text_hash",
        "n_shingles",
        "root",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def near_duplicates(df: DataFrame, join: Join = Join()) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id of its group) of every row."""
    return grouped(df, join).select("doc_id", "n_shingles", "component_id")


def with_group(df: DataFrame, name: str, join: Join) -> DataFrame:
    """``df`` with a column ``name``, equal for texts of one group; texts without shingles are groups by their hash."""
    ref, text_hash = (free_name(df, x) for x in ("_ref", "_text_hash"))
    keys = [ref, text_hash]
    roots = store_once(
        grouped(df, join).filter("root is not null").select("ref", "text_hash", "root").distinct().toDF(*keys, name), "roots"
    )
    found = df.withColumn(text_hash, F.xxhash64(text_of())).withColumn(
        ref, F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.hex(text_hash)))
    )
    return found.join(roots, keys, "left").select(
        *[f"`{c}`" for c in df.columns], F.coalesce(name, F.col(text_hash)).alias(name)
    )


def one_of_each_group(df: DataFrame, join: Join = Join(words=5, num=4, den=5)) -> DataFrame:
    """``df`` with one row of each group: that of the smallest id. Rows without shingles all stay."""
    rows = store_once(grouped(df, join).filter("root is not null"), "groups")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "ref", "text_hash")
    chosen = rows.groupBy("root").agg(F.min(row).alias("c")).select("root", "c.ref", "c.text_hash")
    counts = rows.groupBy("root", "ref", "text_hash").agg(F.count(F.lit(1)).alias("repeats"))
    kept = chosen.withColumn("kept", F.lit(True))
    decided = store_once(counts.join(kept, ["root", "ref", "text_hash"], "left"), "decided")
    gone = decided.filter("kept is null").select("ref", "text_hash").distinct()
    again = decided.filter("kept and repeats > 1").select("ref", "text_hash")
    ref, text_hash = (free_name(df, x) for x in ("_ref", "_text_hash"))
    found = df.withColumn(text_hash, F.xxhash64(text_of())).withColumn(
        ref, F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.hex(text_hash)))
    )
    keys = [ref, text_hash]
    left = by_ids(found, store_once(gone.toDF(*keys), "gone"), keys, "left_anti")
    repeated = store_once(again.toDF(*keys), "repeated")
    if not repeated.isEmpty():
        once = left.join(repeated, keys, "left_semi").dropDuplicates(keys)
        left = by_ids(left, repeated, keys, "left_anti").unionByName(once)
    return left.select(*[f"`{c}`" for c in df.columns])


def op5_adaptive_prefix(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
