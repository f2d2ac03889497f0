"""Removal of lines that a site repeats: the share of a site's pages that hold a line.

Pages are grouped by host. A line's ratio is the number of the host's pages that contain
it over the number of its pages; above ``max_ratio`` and on at least ``min_pages`` pages it
is boilerplate and goes from every page of that host. A page is a distinct text: exact
copies count once, so mirrored pages don't turn their own text into boilerplate. A caller that knows
near copies gives ``pages``, in which texts that count as one page of a host have one value. Lines are
compared without spaces, tabs and carriage returns around them; blank lines stay.

A null text has no lines and stays null; a null host is a host of its own. A line repeated within a page
counts once there. A text of which all lines go becomes empty. Repeated rows are all kept. An empty table gives no rows.
Other columns are kept; ``lines`` and ``dropped`` are replaced.

Counts are combined before they are shuffled, so neither a large host nor a common line
meets in one task. The lines to drop are few: a host has at most its mean number of
lines a page over ``max_ratio`` of them, whatever its size, so they travel as one array a host, to the texts where these
lie if all arrays together are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshloom.llm.common import set_aside, table
from meshloom.session import store_once

MAX_RATIO, MIN_PAGES = 0.02, 5
EDGE = " \t\r"
#: Lines to drop that may be broadcast, of 16 bytes each; with more of them texts are joined by shuffle.
BROADCAST_LINES = 1_000_000


def line_keys(text: Column) -> Column:
    """A struct of two hashes for each line that isn't blank; null for the blank ones."""

    def key(line: Column) -> Column:
        bare = F.btrim(line, F.lit(EDGE))
        return F.when(bare != "", F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit(1), bare).alias("b")))

    return F.transform(F.split(text, "\n"), key)


def boilerplate(pages: DataFrame, max_ratio: float, min_pages: int) -> DataFrame:
    """``_host`` and the array ``_boilerplate`` of line keys to drop, for hosts that have any."""
    pages = pages.filter("_lines is not null")
    totals = pages.select("_host", "_page").distinct().groupBy("_host").agg(F.count(F.lit(1)).alias("_pages"))
    counts = (
        pages.select("_host", "_page", F.explode("_lines").alias("_line"))
        .filter("_line is not null")
        .distinct()
        .groupBy("_host", "_line")
        .agg(F.count(F.lit(1)).alias("_holding"))
        .filter(F.col("_holding") >= min_pages)
    )
    over = counts.alias("c").join(totals.alias("t"), F.col("c._host").eqNullSafe(F.col("t._host")))
    return (
        over.filter(F.col("_holding") > max_ratio * F.col("_pages"))
        .groupBy(F.col("c._host").alias("_host"))
        .agg(F.collect_list("_line").alias("_boilerplate"))
    )


def drop_site_lines(
    df: DataFrame,
    host: str = "source",
    text: str = "text",
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
    pages: DataFrame | None = None,
) -> DataFrame:
    """``df`` with boilerplate lines gone from ``text``, and the numbers of ``lines`` and ``dropped`` ones.

    ``pages``: ``_host``, ``_page`` and ``_lines`` (the distinct keys of its lines, null for a null text) of every row of ``df``, if a
    page isn't a distinct text.
    """
    df = df.drop("lines", "dropped")
    plain, column, original = set_aside(df)
    body = column(text)
    if pages is None:
        lines = F.array_distinct(line_keys(body)).alias("_lines")
        pages = plain.select(column(host).alias("_host"), F.xxhash64(body, F.lit(2)).alias("_page"), lines)
    drops = store_once(boilerplate(pages, max_ratio, min_pages), "boilerplate")
    hosts, lines_in_all = drops.agg(F.count(F.lit(1)), F.sum(F.size("_boilerplate"))).first()
    if hosts + (lines_in_all or 0) <= BROADCAST_LINES:  # stored first: a join by shuffle would move all texts
        drops = F.broadcast(drops)
    joined = plain.join(drops, column(host).eqNullSafe(F.col("_host")), "left")
    keyed = F.arrays_zip(F.split(body, "\n").alias("line"), line_keys(body).alias("key"))
    kept = F.filter(keyed, lambda x: x["key"].isNull() | ~F.array_contains(F.col("_boilerplate"), x["key"]))
    lines = F.when(body.isNull(), 0).otherwise(F.size(F.split(body, "\n")))
    any_ = F.col("_boilerplate").isNotNull() & body.isNotNull()
    return (
        joined.withColumn("_kept", F.when(any_, F.transform(kept, lambda x: x["line"])))
        .withColumn("lines", lines)
        .withColumn("dropped", F.when(any_, F.col("lines") - F.size("_kept")).otherwise(0))
        .withColumn("_text", F.when(F.col("dropped") > 0, F.array_join("_kept", "\n")).otherwise(body))
        .select(*[F.col("_text").alias(text) if n == text else c for n, c in zip(df.columns, original, strict=True)], "lines", "dropped")
    )


def op4_site_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_site_lines(docs).select("doc_id", "source", "lines", "dropped", "text")


OP4_SQL = f"""
WITH line AS (
    SELECT DISTINCT source, text, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13)) AS bare
    FROM documents WHERE text IS NOT NULL
), total AS (
    SELECT source, count(DISTINCT text) AS pages FROM documents WHERE text IS NOT NULL GROUP BY source
), boiler AS (
    SELECT line.source, list(bare) AS bares FROM (
        SELECT source, bare, count(*) AS holding FROM line WHERE bare <> '' GROUP BY source, bare
    ) line JOIN total ON line.source IS NOT DISTINCT FROM total.source
    WHERE holding >= {MIN_PAGES} AND holding > {MAX_RATIO} * pages GROUP BY line.source
), split AS (
    SELECT doc_id, d.source, string_split(text, chr(10)) AS all_lines, coalesce(bares, []) AS bares, text
    FROM documents d LEFT JOIN boiler ON d.source IS NOT DISTINCT FROM boiler.source
), kept AS (
    SELECT *, list_filter(all_lines, lambda x: NOT list_contains(bares, trim(x, ' ' || chr(9) || chr(13)))) AS kept_lines FROM split
)
SELECT doc_id, source, coalesce(len(all_lines), 0)::INTEGER AS lines,
    coalesce(len(all_lines) - len(kept_lines), 0)::INTEGER AS dropped,
    CASE WHEN text IS NULL THEN NULL ELSE array_to_string(kept_lines, chr(10)) END AS text
FROM kept
"""
