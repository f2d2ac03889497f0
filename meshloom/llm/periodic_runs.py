"""Periodic runs of words, by the longest common extensions of suffix trees.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends
keeping q, at least ``least`` words and ``times`` periods long. Of each text:

1. Stretches that can hold a run are found: every k words in a row (k of ``anchor``) inside a run stand in the text
   once more, so words between repeated k-grams only are left. Ordinary prose leaves nothing.
2. Ukkonen's trees of the stretch and of its reversal are built. Leaves in depth-first order with the least depth of
   the Euler tour between neighbours, in a sparse table, give the lowest common ancestor of two leaves, and so the
   longest common extension of two positions, in constant time.
3. The longest Lyndon word at a position, by the order of words or the reverse order, ends where the next smaller (or
   greater) suffix begins. Each such root is extended in both directions; every run has a root among them.

A null text has no words, as an empty or blank one. Long texts are used whole: memory for a text grows with its
words, some 500 bytes a word of the stretches. Texts of any id, repeated rows and ties are looked at one by one, so equal texts
have equal runs. An empty table gives no rows. All columns are kept; ``runs`` and ``collapsed`` replace columns of
these names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshloom.llm.common import WORD, set_aside, small_batches, table, text_of

RUN = "array<struct<start: bigint, length: bigint, period: bigint>>"
#: Texts are handed to Spark again in batches of about this many bytes.
BATCH_BYTES = 8 << 20


class SuffixTree:
    """Ukkonen's tree of ``codes`` (integers from 1), closed by an end mark smaller than all of them."""

    def __init__(self, codes: np.ndarray):
        self.text = codes.tolist() + [0]
        self.letters = int(codes.max(initial=0)) + 1
        self.start, self.end = [0], [0]
        self.leaf = [-1]
        self.child: dict[int, int] = {}
        self._grow()
        self._tour()

    def _node(self, start: int, end: int, leaf: int) -> int:
        self.start.append(start)
        self.end.append(end)
        self.leaf.append(leaf)
        return len(self.start) - 1

    def _grow(self) -> None:
        text, letters, child, start, end = self.text, self.letters, self.child, self.start, self.end
        size = len(text)
        link = {0: 0}
        node = edge = along = suffix = 0
        for i, letter in enumerate(text):
            unlinked = 0
            while suffix <= i:
                if not along:
                    edge = i
                key = node * letters + text[edge]
                below = child.get(key)
                if below is None:
                    child[key] = self._node(i, size, suffix)
                    if unlinked:
                        link[unlinked] = node
                        unlinked = 0
                else:
                    span = end[below] - start[below]
                    if along >= span:
                        node, edge, along = below, edge + span, along - span
                        continue
                    met = start[below] + along
                    if text[met] == letter:
                        along += 1
                        if unlinked:
                            link[unlinked] = node
                        break
                    fork = self._node(start[below], met, -1)
                    child[key] = fork
                    child[fork * letters + letter] = self._node(i, size, suffix)
                    start[below] = met
                    child[fork * letters + text[met]] = below
                    if unlinked:
                        link[unlinked] = fork
                    unlinked = fork
                suffix += 1
                if node:
                    node = link.get(node, 0)
                elif along:
                    along -= 1
                    edge = suffix

    def _tour(self) -> None:
        """Rank of every suffix, and the sparse table of least depths between neighbouring leaves."""
        keys = np.fromiter(self.child.keys(), np.int64, len(self.child))
        below = np.fromiter(self.child.values(), np.int64, len(self.child))
        above, letter = np.divmod(keys, self.letters)
        # Children of a node, greatest letter first: the least comes onto the stack last.
        order = np.lexsort((-letter, above))
        first = np.searchsorted(above[order], np.arange(len(self.start) + 1)).tolist()
        children = below[order].tolist()
        start, end, leaf = self.start, self.end, self.leaf
        ranks, least = [0] * len(self.text), []
        stack, lowest = [(0, 0)], 0
        while stack:
            node, depth = stack.pop()
            if node < 0:  # the tour is back at an inner node
                lowest = depth
                continue
            if leaf[node] >= 0:
                ranks[leaf[node]] = len(least)
                least.append(lowest)
                continue
            depth += end[node] - start[node]
            for k in range(first[node], first[node + 1]):
                if k > first[node]:
                    stack.append((-1, depth))
                stack.append((children[k], depth))
        self.rank = np.array(ranks, np.int64)
        self.table = [np.array(least, np.int32)]
        while 2 << len(self.table) <= 2 * len(least):
            row, step = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(row[:-step], row[step:]))

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at a and b (never equal)."""
        x, y = self.rank[a], self.rank[b]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y)
        level = np.frexp(high - low + 1)[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level).tolist():
            here = level == k
            row = self.table[k]
            out[here] = np.minimum(row[low[here]], row[high[here] - (1 << k) + 1])
        return out


def lyndon_roots(rank: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the longest Lyndon word at each position, in both orders, within ``size`` words."""
    r = rank.tolist()
    smaller, greater = [size] * (size + 1), [size] * (size + 1)
    for i in range(size - 1, -1, -1):
        j = i + 1
        while r[j] > r[i]:
            j = smaller[j]
        smaller[i] = j
        j = i + 1
        while j < size and r[j] < r[i]:
            j = greater[j]
        greater[i] = j
    at = np.arange(size)
    up, down = np.array(smaller[:size], np.int64), np.array(greater[:size], np.int64)
    inside = down < size  # in the reverse order the end mark is the greatest: a word that reaches it isn't one of the text
    return np.concatenate([at, at[inside]]), np.concatenate([up - at, (down - at)[inside]])


def runs_within(codes: np.ndarray, least: int, times: int) -> np.ndarray:
    """start, length and period of the runs of ``codes`` (integers from 1)."""
    size = len(codes)
    forward = SuffixTree(codes)
    start, period = lyndon_roots(forward.rank, size)
    fits = period * times <= size
    start, period = start[fits], period[fits]
    right = forward.extension(start, start + period)
    del forward
    left = SuffixTree(codes[::-1]).extension(size - start, size - start - period)
    length = left + period + right
    long = length >= np.maximum(least, times * period)
    return np.unique(np.stack([start - left, length, period], axis=1)[long], axis=0)


def anchor(least: int, times: int) -> int:
    """How many words in a row are sure to stand twice in a run: a period q leaves max(least, times q) - 2q + 1."""
    return min(max(least, times * q) - 2 * q + 1 for q in range(1, least + 1))


def stretches(codes: np.ndarray, least: int, times: int) -> list[tuple[int, int]]:
    """The parts (start, end) of a text outside which no run can reach."""
    k = anchor(least, times)
    grams = len(codes) - k + 1
    if len(codes) < least:
        return []
    h = np.zeros(grams, np.uint64)
    for j in range(k):
        h = (h ^ codes[j : j + grams].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    _, inverse, many = np.unique(h, return_inverse=True, return_counts=True)
    marks = np.concatenate([[False], many[inverse] > 1, [False]])
    edges = np.flatnonzero(marks[1:] != marks[:-1])
    return [(a, b + k - 1) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if b - a + k - 1 >= least]


def runs_of(words: list, least: int = 24, times: int = 3) -> np.ndarray:
    """start, length and period of every run of ``words``, by start, then period."""
    number = dict(zip(set(words), count(1)))
    codes = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    found = [np.zeros((0, 3), np.int64)]
    for a, b in stretches(codes, least, times):
        own = np.unique(codes[a:b], return_inverse=True)[1] + 1
        found.append(runs_within(own, least, times) + np.array([a, 0, 0]))
    runs = np.concatenate(found)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by a space, of each run only what comes before its first repeat."""
    if len(runs):
        drop = np.zeros(len(words) + 1, np.int64)
        np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
        np.add.at(drop, runs[:, 0] + runs[:, 1], -1)
        kept = np.cumsum(drop)[:-1] == 0
        words = [words[i] for i in np.flatnonzero(kept).tolist()]
    return b" ".join(words)


def with_runs(df: DataFrame, text: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """Add ``runs`` (start, length and period in words, by start, then period) and the ``collapsed`` text."""
    small_batches(df.sparkSession)
    df = df.drop("runs", "collapsed")
    plain, column, original = set_aside(df)
    kept = plain.columns

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.binary_length(batch["words"]).to_numpy()
            part = np.cumsum(size) // BATCH_BYTES
            bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
            for a, b in zip(bounds, bounds[1:]):
                if b > a:
                    yield one(batch.slice(a, b - a))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, all_runs = [], []
        for body in batch["words"].to_pylist():
            words = body.split()  # bytes: at the six ASCII white space characters
            runs = runs_of(words, least, times)
            all_runs.append(runs)
            texts.append(collapsed(words, runs))
        ends = np.cumsum([0, *map(len, all_runs)])
        flat = np.concatenate([*all_runs, np.zeros((0, 3), np.int64)])
        kinds = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])
        rows = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(kinds))
        added = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows), pa.array(texts, pa.binary()).cast(pa.string())]
        columns = [batch[c] for c in kept]
        return pa.RecordBatch.from_arrays(columns + added, names=[*kept, "runs", "collapsed"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    sent = plain.withColumn("words", F.coalesce(column(text), F.lit("")).cast("binary"))
    return sent.mapInArrow(tables, f"{schema}, runs {RUN}, collapsed string").select(*original, "runs", "collapsed")


def repeated_tail(words: Column, a: Column, p: Column) -> Column:
    """``words`` whose tail from a on repeats its first p words."""
    rest = F.size(words) - a
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil(rest / p).cast("int")))
    return F.concat(F.slice(words, F.lit(1), a), F.slice(again, F.lit(1), rest))


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text; a tenth of the texts, chosen by crc32 of the id, get a periodic tail."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all(text_of(), F.lit(WORD), F.lit(0)))
    g = F.floor(F.col("h") / 10)
    n = F.size("w")
    tailed = (
        docs.select("doc_id", "text", h.alias("h"))
        .withColumn("w", words)
        .withColumn("a", F.when(n > 0, g % n).cast("int"))
        .withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    )
    tail = F.array_join(repeated_tail(F.col("w"), F.col("a"), F.col("p")), " ")
    return tailed.select("doc_id", F.when(F.col("a").isNotNull(), tail).otherwise(F.col("text")).alias("text"))


def op11_lyndon_runs(spark, sf_dir):
    found = with_runs(planted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    # Greater exact exponent first: x before y if x.length * y.period > y.length * x.period.
    best = F.expr(
        "get(array_sort(runs, (x, y) -> int(CASE"
        " WHEN x.length * y.period <> y.length * x.period THEN sign(y.length * x.period - x.length * y.period)"
        " WHEN x.start <> y.start THEN sign(x.start - y.start) ELSE sign(x.period - y.period) END)), 0)"
    )
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    chosen = found.withColumn("best", best)
    return chosen.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
