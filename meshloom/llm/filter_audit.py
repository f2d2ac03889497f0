"""How filters overlap: every order of five filters, with exact duplicates found in radix tries of the whole texts.

Conditions A to D look at one text (too few words, too few distinct words, too many capitals, symbols). E, a text
identical to one of a smaller id, comes from tries:

1. A first pass over the rows as they lie inserts their texts into a compressed trie a task, its terminals holding the
   least id: a row that loses there is a duplicate for good, and one text of a task goes on, so that a text that
   a third of all rows hold is one row a task from here.
2. The rest is range-partitioned by prefixes that adapt to the data: a prefix holding too many bytes is lengthened until
   none does. Each partition inserts its texts into tries in order of prefix, a new trie once enough bytes are in;
   the terminals then tell the least id of the whole table.
3. What is left of a row is its five-bit mask. Masks are counted by part, and everything asked about 120 orders follows
   from the counts of rows that fail none of a set of filters.

A null text is empty; a null part is the empty string. A row without an id is no duplicate and makes none. Rows
of the same id and text don't make each other duplicates; repeated rows all count. An empty table has no parts
and gives no rows. ``labels`` may repeat ids or hold nulls: a row is good (or toxic) if any label of its id says so.
Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.llm.common import by_ids, small_batches, table
from meshloom.session import store_once

FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")
ALL = (1 << len(FILTERS)) - 1
#: A trie is emptied once it holds this many bytes of text and the prefix changes.
TRIE_BYTES = 24 << 20


@dataclass(frozen=True)
class Conditions:
    """When a text fails filters A to D."""

    min_words: int = 200
    min_distinct_percent: int = 50
    max_capital_percent: int = 2
    symbols: bytes = rb"[#$%&*|]"


@dataclass(frozen=True)
class Ranges:
    """How finely texts are dealt: bytes a task at most, and how prefixes grow."""

    task_bytes: int = 32 << 20
    first_prefix: int = 8
    growth: int = 4


def mask_of(text: bytes, c: Conditions, symbols: re.Pattern) -> int:
    """Bit k is set if the text fails the k-th filter; E is not decided here."""
    words = text.split()  # bytes: at the six ASCII white space characters
    octets = np.frombuffer(text, np.uint8)
    capitals = np.count_nonzero((octets - np.uint8(65)) < 26)
    points = len(text) - np.count_nonzero((octets & 0xC0) == 0x80)
    failed = (
        len(words) < c.min_words,
        100 * len(set(words)) < c.min_distinct_percent * len(words),
        100 * capitals > c.max_capital_percent * points,
        symbols.search(text) is not None,
    )
    return sum(1 << k for k, x in enumerate(failed) if x)


class Trie:
    """A compressed trie of byte strings. A terminal holds the least id of its text and how many rows a part has of it."""

    def __init__(self):
        self.label = [b""]
        self.below: list[dict[int, int] | None] = [None]
        self.terminal: dict[int, list] = {}
        self.bytes = 0

    def node(self, text: bytes) -> int:
        """The node where ``text`` ends, made if it isn't there."""
        label, below = self.label, self.below
        here, at, size = 0, 0, len(text)
        while at < size:
            if below[here] is None:
                below[here] = {}
            edges = below[here]
            child = edges.get(text[at])
            if child is None:
                edges[text[at]] = here = self._new(text[at:])
                return here
            edge = label[child]
            if not text.startswith(edge, at):
                same, most = 1, min(len(edge), size - at)
                while same < most:  # the longest common prefix, by halves
                    middle = (same + most + 1) // 2
                    if text.startswith(edge[:middle], at):
                        same = middle
                    else:
                        most = middle - 1
                fork = self._new(edge[:same])
                edges[text[at]] = fork
                label[child] = edge[same:]
                below[fork] = {edge[same]: child}
                child = fork
            at += len(label[child])
            here = child
        return here

    def _new(self, edge: bytes) -> int:
        self.label.append(edge)
        self.below.append(None)
        self.bytes += len(edge)
        return len(self.label) - 1

    def insert(self, text: bytes, doc_id, part: str, mask: int, rows: int) -> list[tuple]:
        """Take rows of a text in; gives the rows (doc_id, part, mask, rows) that are duplicates now."""
        end = self.node(text)
        held = self.terminal.get(end)
        if held is None:
            self.terminal[end] = [doc_id, mask, Counter({part: rows})]
        elif doc_id == held[0]:
            held[2][part] += rows
        elif doc_id > held[0]:
            return [(doc_id, part, mask | DUPLICATE, rows)]
        else:
            lost = [(held[0], p, held[1] | DUPLICATE, n) for p, n in held[2].items()]
            self.terminal[end] = [doc_id, mask, Counter({part: rows})]
            return lost
        return []

    def first_rows(self) -> Iterator[tuple]:
        """doc_id, part, mask, rows and the text of every terminal's least id."""
        stack = [(0, b"")]
        while stack:
            here, text = stack.pop()
            if here in self.terminal:
                doc_id, mask, parts = self.terminal[here]
                for part, rows in parts.items():
                    yield doc_id, part, mask, rows, text
            for child in (self.below[here] or {}).values():
                stack.append((child, text + self.label[child]))


def schema_of(docs: DataFrame) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, part string, mask int, rows long, text binary"


def batch_of(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = (kind, pa.string(), pa.int32(), pa.int64(), pa.binary())
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "part", "mask", "rows", "text"]
    )


def within_tasks(docs: DataFrame, conditions: Conditions, trie_bytes: int) -> DataFrame:
    """Rows that are decided (text null), and with its text the least id a task has of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, symbols, kind = Trie(), re.compile(conditions.symbols), None
        for batch in batches:
            kind, decided = batch["doc_id"].type, []
            for doc_id, part, text in zip(batch["doc_id"].to_pylist(), batch["part"].to_pylist(), batch["text"], strict=True):
                body = text.as_buffer().to_pybytes()
                mask = mask_of(body, conditions, symbols)
                if doc_id is None:
                    decided.append((doc_id, part, mask, 1, None))
                else:
                    decided += [(*row, None) for row in trie.insert(body, doc_id, part, mask, 1)]
                if trie.bytes > trie_bytes:
                    yield from emptied(trie, kind)
                    trie = Trie()
            yield batch_of(decided, kind)
        if kind is not None:
            yield from emptied(trie, kind)

    return docs.mapInArrow(run, schema_of(docs))


def emptied(trie: Trie, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The first rows of a trie, in batches of bounded size."""
    rows, size = [], 0
    for row in trie.first_rows():
        rows.append(row)
        size += len(row[4])
        if size > 4 << 20:
            yield batch_of(rows, kind)
            rows, size = [], 0
    yield batch_of(rows, kind)


def within_ranges(dealt: DataFrame, trie_bytes: int) -> DataFrame:
    """All rows of ``dealt`` decided; it lies in order of head and leaf, and equal texts share them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, last, kind = Trie(), None, None
        for batch in batches:
            kind, decided = batch["doc_id"].type, []
            keys = zip(batch["head"].to_pylist(), batch["leaf"].to_pylist(), strict=True)
            rows = zip(*[batch[c].to_pylist() for c in ("doc_id", "part", "mask", "rows")], batch["text"], strict=True)
            for key, (doc_id, part, mask, many, text) in zip(keys, rows, strict=True):
                if key != last and trie.bytes > trie_bytes:
                    decided += [(*row[:4], None) for row in trie.first_rows()]
                    trie = Trie()
                last = key
                decided += [(*row, None) for row in trie.insert(text.as_buffer().to_pybytes(), doc_id, part, mask, many)]
            yield batch_of(decided, kind)
        if kind is not None:
            yield batch_of([(*row[:4], None) for row in trie.first_rows()], kind)

    return dealt.mapInArrow(run, schema_of(dealt))


def leaf_of(length: int):
    return F.xxhash64(F.substring("text", 1, length))


def with_leaf(texts: DataFrame, ranges: Ranges) -> tuple[DataFrame, int]:
    """Add ``leaf``, the hash of a prefix that is as long as the bytes under it ask for; also the number of tasks.

    ``texts`` is stored. Only prefixes with over half a task's bytes are listed, so their number is bounded by twice the tasks.
    """
    cost = F.octet_length("text") + 64
    total = texts.agg(F.sum(cost)).first()[0] or 0
    tasks = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / ranges.task_bytes))
    length, under, leaves = ranges.first_prefix, texts, texts.withColumn("leaf", leaf_of(ranges.first_prefix))
    while True:
        counted = under.groupBy(leaf_of(length).alias("leaf")).agg(
            F.sum(cost).alias("bytes"), F.max(F.octet_length("text")).alias("longest")
        )
        # Where all texts end within the prefix they are equal, and no longer prefix parts them.
        full = counted.filter((F.col("bytes") > total / (2 * tasks)) & (F.col("longest") > length))
        heavy = store_once(full.select("leaf").withColumn("grow", F.lit(True)), "prefixes")
        if heavy.isEmpty():
            return leaves, tasks
        longer = length * ranges.growth
        under = by_ids(under.withColumn("leaf", leaf_of(length)), heavy.select("leaf"), "leaf").drop("leaf")
        leaves = by_ids(leaves, heavy, "leaf", "left").withColumn(
            "leaf", F.when(F.col("grow"), leaf_of(longer)).otherwise(F.col("leaf"))
        ).drop("grow")
        length = longer


def failure_masks(
    docs: DataFrame, conditions: Conditions = Conditions(), ranges: Ranges = Ranges(), trie_bytes: int = TRIE_BYTES
) -> DataFrame:
    """doc_id, part, mask and rows: how many rows of an id fail which filters. ``docs`` has doc_id, source and text."""
    small_batches(docs.sparkSession)
    parts = F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part")
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    first = store_once(within_tasks(docs.select("doc_id", parts, body), conditions, trie_bytes), "masks")
    leaves, tasks = with_leaf(first.filter("text is not null"), ranges)
    # The head keeps prefixes in order; a hash tells longer ones apart, so that a sampled key is small.
    dealt = leaves.withColumn("head", F.substring("text", 1, ranges.first_prefix)).repartitionByRange(tasks, "head", "leaf")
    last = within_ranges(dealt.sortWithinPartitions("head", "leaf"), trie_bytes)
    return first.filter("text is null").unionByName(last).select("doc_id", "part", "mask", "rows")


def spared(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part and, by set of filters, how many rows (all, good, toxic) fail none of the set. ``masks`` is stored."""
    says = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    labelled = labels.filter("doc_id is not null").groupBy("doc_id").agg(says("quality"), says("toxic"))
    rated = masks.join(labelled.filter("quality = 1 or toxic = 1"), "doc_id").groupBy("part", "mask").agg(
        F.lit(0).cast("long").alias("rows"),
        F.sum(F.col("rows") * F.col("quality")).alias("good"),
        F.sum(F.col("rows") * F.col("toxic")).alias("toxic"),
    )
    none = F.lit(0).cast("long")
    every = masks.groupBy("part", "mask").agg(F.sum("rows").alias("rows"), none.alias("good"), none.alias("toxic"))
    by_set = (
        every.unionByName(rated)
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(ALL))).alias("filters"))
        .groupBy("part", "filters")
        .agg(*[F.sum(F.when(F.col("mask").bitwiseAND(F.col("filters")) == 0, F.col(c)).otherwise(0)).alias(c) for c in COUNTS])
    )
    ordered = F.array_sort(F.collect_list(F.struct("filters", *COUNTS)))
    return by_set.groupBy("part").agg(ordered.alias("sets")).select("part", *[F.col(f"sets.{c}").alias(c) for c in COUNTS])


COUNTS = ("rows", "good", "toxic")


def audit(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a part, order of the filters and step, from a stored table of masks."""
    free = spared(masks, labels)
    n = len(FILTERS)

    def shapley(k: int):
        """Rows that filter k removes, over all orders: those it removes after a set, times the orders with this set before it."""
        sets = [s for s in range(ALL + 1) if not s >> k & 1]
        ways = {s: math.factorial(s.bit_count()) * math.factorial(n - 1 - s.bit_count()) for s in sets}
        return sum((ways[s] * (F.col("rows")[s] - F.col("rows")[s | 1 << k]) for s in sets), F.lit(0).cast("long"))

    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    bits = lambda text: sum((F.when(F.instr(text, f) > 0, 1 << k).otherwise(0) for k, f in enumerate(FILTERS)), F.lit(0))
    steps = (
        free.withColumn("shares", F.array(*[shapley(k) for k in range(n)]))
        .select("*", F.explode(orders).alias("filter_order"))
        .select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
        .withColumn("own", F.instr(F.lit(FILTERS), F.expr("substring(filter_order, step, 1)")) - 1)
        .withColumn("before", bits(F.expr("substring(filter_order, 1, step - 1)")))
        .withColumn("bit", F.expr("shiftleft(1, own)"))
        .withColumn("after", F.col("before") + F.col("bit"))
    )
    at = lambda c, where: F.get(F.col(c), where)
    lost = lambda c: at(c, F.col("before")) - at(c, F.col("after"))
    return steps.select(
        "part",
        "filter_order",
        "step",
        at("rows", F.col("after")).alias("kept"),
        lost("rows").alias("removed"),
        (at("rows", F.lit(0)) - at("rows", F.col("bit")) - lost("rows")).alias("redundant"),
        (at("rows", ALL - F.col("bit")) - at("rows", F.lit(ALL))).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        at("shares", F.col("own")).alias("shapley"),
    )


def op13_radix_tries(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    masks = store_once(failure_masks(docs), "failures")
    return audit(masks, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


OP13_SQL = r"""
WITH filters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
), orders AS (
    SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
    FROM filters a JOIN filters b ON a.f <> b.f JOIN filters c ON c.f NOT IN (a.f, b.f)
    JOIN filters d ON d.f NOT IN (a.f, b.f, c.f) JOIN filters e ON e.f NOT IN (a.f, b.f, c.f, d.f)
), worded AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), failing AS (
    SELECT part, doc_id,
        CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
        || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
        || CASE WHEN 100 * (length(body) - length(regexp_replace(body, '[A-Z]', '', 'g'))) > 2 * length(body) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 'D' ELSE '' END
        || CASE WHEN coalesce(doc_id > min(doc_id) OVER (PARTITION BY body), false) THEN 'E' ELSE '' END AS fails
    FROM worded
), rated AS (
    SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id
), counted AS (
    SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
    FROM failing LEFT JOIN rated USING (doc_id) GROUP BY part, fails
), placed AS (
    SELECT part, filter_order, step, substr(filter_order, step, 1) AS own, fails, n, good, toxic,
        coalesce(list_min(list_filter([1, 2, 3, 4, 5], lambda k: contains(fails, substr(filter_order, k, 1)))), 6) AS hit
    FROM counted, orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), told AS (
    SELECT part, filter_order, step, own,
        sum(CASE WHEN hit > step THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN hit = step THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN hit < step AND contains(fails, own) THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN hit = step THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN hit = step THEN toxic ELSE 0 END) AS toxic_lost
    FROM placed GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
    unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
    (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM told
"""
