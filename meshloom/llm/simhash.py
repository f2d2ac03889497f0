"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint bit is the majority of that bit over the hashes of a text's shingles. Two fingerprints differ in at
most r bits just if some value lies within floor(r/2) bits of the one and ceil(r/2) of the other. So

1. every distinct fingerprint emits all its variants within ceil(r/2) bits (65 for r = 2);
2. rows meet on variants. The fingerprints near a variant are at most as many as its ball has values, whatever
   the data, so no key is hot: copies are one fingerprint before anything is emitted;
3. within a variant all are linked with the least fingerprint within floor(r/2) bits of it; a link
   is kept once and verified by its differing bits. No link is lost: both ends of one meet in its middle, and
   both are linked with the same fingerprint there;
4. components of the links give the classes.

Null and empty texts have fingerprint zero, which links like any other. A text with fewer words than a
shingle is one shingle. Long texts are used whole, repeated shingles count. Rows without an id take
part, but a component is named by its smallest id (null only if it has none). Repeated rows have equal fingerprints. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshloom.llm.common import set_aside, small_batches, table, text_of
from meshloom.llm.components import components
from meshloom.session import store_once

BITS = 64
#: Hashes are split into bits in blocks of this many.
BLOCK = 1 << 15


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes (uint64), as a signed integer."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[at : at + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    w = text.lower().split()  # bytes: A-Z alone, and the six ASCII white space characters
    if not w:
        return 0
    k = min(words, len(w))
    shingles = map(b" ".join, zip(*(w[j : len(w) - k + 1 + j] for j in range(k))))
    count = len(w) - k + 1
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, count))


def with_fingerprint(df: DataFrame, text: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """The columns of ``df`` but the text, and ``fingerprint`` (64 bits as a signed long; replaces a column of this name)."""
    small_batches(df.sparkSession)
    df = df.drop("fingerprint")
    plain, column, original = set_aside(df)
    kept = [c for c, name in zip(plain.columns, df.columns, strict=True) if name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_buffer().to_pybytes(), words, seed) for x in batch["body"]]
            yield pa.RecordBatch.from_arrays(
                [*[batch[c] for c in kept], pa.array(found, pa.int64())], names=[*kept, "fingerprint"]
            )

    schema = ", ".join([*[f"`{c}` {plain.schema[c].dataType.simpleString()}" for c in kept], "fingerprint long"])
    sent = plain.select(*kept, text_of(column_name(df, text)).cast("binary").alias("body"))
    named = [c for c, name in zip(original, df.columns, strict=True) if name != text]
    return sent.mapInArrow(run, schema).select(*named, "fingerprint")


def column_name(df: DataFrame, text: str) -> str:
    return f"c{df.columns.index(text)}"


def ball(radius: int) -> list[int]:
    """All masks of at most ``radius`` bits, as signed longs."""
    masks = [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(BITS), k)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def ball_links(fingerprints: DataFrame, radius: int = 2) -> DataFrame:
    """u and v: links between distinct fingerprints that connect all those within ``radius`` bits, directly or by others."""
    masks = F.array(*[F.lit(m).cast("long") for m in ball(-(-radius // 2))])
    met = fingerprints.select("fingerprint", F.explode(masks).alias("mask")).select(
        F.col("fingerprint").bitwiseXOR(F.col("mask")).alias("variant"),
        "fingerprint",
        # In an even radius both halves are equal, and every variant is near enough.
        (F.lit(True) if radius % 2 == 0 else F.bit_count("mask") <= radius // 2).alias("near"),
    )
    least = F.min(F.when(F.col("near"), F.col("fingerprint"))).over(Window.partitionBy("variant"))
    linked = met.withColumn("u", least).select("u", F.col("fingerprint").alias("v")).filter("u <> v")
    return linked.filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius).distinct()


def near_classes(hashed: DataFrame, radius: int = 2) -> DataFrame:
    """Add ``component_id``, the smallest doc_id reachable, to a stored table with doc_id and fingerprint."""
    nodes = store_once(hashed.groupBy("fingerprint").agg(F.min("doc_id").alias("first_doc")), "fingerprints")
    links = store_once(ball_links(nodes.select("fingerprint"), radius), "links")
    roots = components(links).select(F.col("u").alias("fingerprint"), F.col("v").alias("root"))
    rooted = nodes.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    first = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    classes = rooted.join(first, "root").select("fingerprint", "component_id")
    return hashed.drop("component_id").join(classes, "fingerprint")


def near_duplicates(df: DataFrame, radius: int = 2, words: int = 3) -> DataFrame:
    """``df`` without its text, with ``fingerprint`` and ``component_id``."""
    return near_classes(store_once(with_fingerprint(df, words=words), "hashed"), radius)


def op12_ball_hashing(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
