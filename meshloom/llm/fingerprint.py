"""Document fingerprints by a threshold-scaled sketch of word shingles.

Every 5-word shingle is hashed; a fingerprint keeps each distinct hash below a fixed
fraction of the hash space, so documents of any length are compared on the same part of that space and
fingerprints merge by union. A text with fewer than ``floor`` such hashes keeps its ``floor``
smallest ones (all, if it has fewer) and is compared below the largest it keeps.

A fingerprint is the ascending hashes in hexadecimal, eight digits each; equal texts have
equal fingerprints. A text of one to four words is one shingle; a null or empty text, or
one of white space, has the empty fingerprint, which is like (1.0) another empty one and
unlike (0.0) any other. Only DataFrame functions are used.

``next`` documents follow in ascending doc_id, null ids first, equal ids by a hash of the text; the first
follows the last. Rows equal in id and text follow one another. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshloom.llm.common import prefix_sums, table, text_of
from meshloom.session import store_once

SHINGLE_WORDS, FRACTION, FLOOR = 5, 4, 64
SPACE = " \t\n\x0b\x0c\r"
THRESHOLD = (1 << 32) // FRACTION


def with_sketch(df: DataFrame, text: str, sketch: str) -> DataFrame:
    """Add ``sketch``: the sorted hashes (32 bits, as long) that the fingerprint of ``text`` keeps."""
    words, shingles, few = f"_{sketch}_words", f"_{sketch}_shingles", f"_{sketch}_few"
    n = SHINGLE_WORDS

    def top(h: Column) -> Column:
        return F.shiftrightunsigned(h, 32)

    bare = F.btrim(F.col(text), F.lit(SPACE))
    hashed = F.transform(F.split(bare, r"[\x20\x09-\x0D]+"), lambda w: F.xxhash64(w))
    windows = F.transform(
        F.slice(words, 1, F.size(words) - (n - 1)),
        lambda w, i: top(F.xxhash64(w, *[F.get(F.col(words), i + k) for k in range(1, n)])),
    )
    # Each step in a projection of its own: a lambda must not compute its input once an element.
    return (
        df.withColumn(words, F.when(bare != "", hashed))
        .withColumn(
            shingles,
            F.when(F.col(words).isNull(), F.array().cast("array<bigint>"))
            .when(F.size(words) < n, F.array(top(F.xxhash64(words))))
            .otherwise(windows),
        )
        .withColumn(few, F.array_distinct(F.filter(shingles, lambda h: h < THRESHOLD)))
        .withColumn(
            sketch,
            F.when(F.size(few) >= FLOOR, F.sort_array(few)).otherwise(
                F.slice(F.sort_array(F.array_distinct(shingles)), 1, FLOOR)
            ),
        )
        .drop(words, shingles, few)
    )


def digits(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")), "")


def reach(sketch: Column) -> Column:
    """Hashes below this are all kept by the sketch."""
    longest = F.coalesce(F.element_at(sketch, -1), F.lit(0)) + 1
    return F.when(F.size(sketch) < FLOOR, F.lit(1 << 32)).when(F.size(sketch) > FLOOR, F.lit(THRESHOLD)).otherwise(
        F.greatest(longest, F.lit(THRESHOLD))
    )


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two texts from their sketches."""
    limit = F.least(reach(a), reach(b))
    low = [F.filter(s, lambda h: h < limit) for s in (a, b)]
    union = F.size(F.array_union(*low))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(
        F.coalesce(F.size(F.array_intersect(*low)) / F.nullif(union, F.lit(0)), F.lit(0.0))
    )


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has: 1 for an empty a, null where no hash of a tells."""
    limit = F.least(reach(a), reach(b))
    low = [F.filter(s, lambda h: h < limit) for s in (a, b)]
    return F.when(F.size(a) == 0, 1.0).otherwise(
        F.size(F.array_intersect(*low)) / F.nullif(F.size(low[0]), F.lit(0))
    )


def merged(a: Column, b: Column) -> Column:
    """The sketch of two texts' shingles together."""
    limit = F.least(reach(a), reach(b))
    return F.sort_array(F.filter(F.array_union(a, b), lambda h: h < limit))


KEY = ["_null", "_id", "_hash", "_chars"]


def successions(keyed: DataFrame) -> DataFrame:
    """A row a distinct key: ``copies``, and the key of the row before it in order (the last, for the first)."""
    distinct = keyed.select(*KEY).groupBy(*KEY).agg(F.count(F.lit(1)).alias("copies"))
    order = [F.desc("_null"), F.col("_id"), F.col("_hash"), F.col("_chars")]
    # Sorted ranges are stored with their number: computed again, their bounds could differ.
    ranged = store_once(
        distinct.repartitionByRange(*order).withColumn("_range", F.spark_partition_id().cast("long")), "ranges"
    )
    sizes = prefix_sums(ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n")), "_range", ["n"])
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    ranked = store_once(
        ranged.withColumn("_rank", rank.cast("long"))
        .join(sizes.select("_range", "n_before"), "_range")
        .select(*KEY, "copies", (F.col("n_before") + F.col("_rank")).alias("_at")),
        "ranks",
    )
    rows = ranked.count()
    before = ranked.select(
        *[F.col(c).alias(f"before{c}") for c in KEY], F.pmod(F.col("_at") + 1, F.lit(max(rows, 1))).alias("_at")
    )
    return ranked.join(before, "_at").drop("_at")


def fingerprints_with_neighbours(docs: DataFrame) -> DataFrame:
    """Sketches of every text, of its edited text and of the next text."""
    keyed = docs.select(
        F.col("doc_id").isNull().alias("_null"),
        F.coalesce(F.col("doc_id"), F.lit(0)).alias("_id"),
        F.xxhash64(text_of()).alias("_hash"),
        F.length(text_of()).cast("long").alias("_chars"),
        text_of().alias("text"),
    )
    copy = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.lit(1)))
    placed = keyed.join(successions(keyed), KEY).withColumn("_copy", copy)
    # Of equal rows the first meets the next text, the others meet each other.
    heads = with_sketch(
        placed.filter("_copy = 1").select(
            *[F.col(f"before{c}").alias(c) for c in KEY],
            F.expr("substring(text, 1, int(before_chars div 4))").alias("next_head"),
            "text",
        ),
        "text",
        "next_sketch",
    ).drop("text")
    joined = with_sketch(placed.join(heads, KEY), "text", "sketch")
    first = F.col("_copy") == 1
    head = F.when(first, F.col("next_head")).otherwise(F.expr("substring(text, 1, int(_chars div 4))"))
    edited = joined.withColumn("edited", F.concat(F.expr("substring(text, 1, int(_chars - _chars div 4))"), head))
    return with_sketch(edited, "edited", "edited_sketch").select(
        F.when(~F.col("_null"), F.col("_id")).alias("doc_id"),
        F.col("_chars").alias("n_chars"),
        "edited",
        "sketch",
        "edited_sketch",
        F.when(first, F.col("next_sketch")).otherwise(F.col("sketch")).alias("next_sketch"),
    )


def op3_scaled_sketch(spark, sf_dir):
    a, edited, after = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return fingerprints_with_neighbours(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        digits(a).alias("fingerprint"),
        digits(edited).alias("edited_fingerprint"),
        likeness(a, edited).alias("near_edited"),
        likeness(a, after).alias("near_next"),
    )
