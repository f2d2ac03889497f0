"""Quality classifier by compression: which of two zstandard dictionaries shortens a text more.

One dictionary is trained on pieces of good labelled texts, one on pieces of bad ones. A
text is cut in blocks, each compressed with either dictionary; the difference of the two
total sizes over their sum is near 1 for text like the good ones. A logistic curve fitted to
other labelled texts, weighted to the true shares of the labels, makes it a probability.

The fit uses a bounded sample of the labels (``Bounds``), the same on every run: the rows
of smallest seeded hash. The score depends on nothing but the text. A null or empty text
has no evidence and scores the share of good labels. Where a label has no rows, every score is
that share, 0.5 without any labels. Labels that are null, or whose id is null, are not
used; of several labels for an id the smallest quality counts. Repeated rows get equal
scores. An empty table gives no rows. Columns of ``df`` are kept; ``score`` is replaced.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshloom.llm.common import free_name, small_batches, table, text_of
from meshloom.session import store_once

THRESHOLD = 0.7


@dataclass(frozen=True)
class Bounds:
    """What a fit may use: documents a label for dictionaries and for calibration, pieces and sizes."""

    dictionary_docs: int = 2000
    calibration_docs: int = 1000
    pieces_per_doc: int = 4
    piece_bytes: int = 512
    dictionary_bytes: int = 110 << 10
    block_bytes: int = 128
    level: int = 3


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    slope: float
    intercept: float
    prior: float
    bounds: Bounds


class Measure:
    """The normalised difference of compressed sizes under two dictionaries."""

    def __init__(self, good: bytes, bad: bytes, bounds: Bounds):
        self.block = bounds.block_bytes
        self.good, self.bad = (compressor(d, bounds.level) for d in (good, bad))

    def __call__(self, text: str) -> float:
        data = text.encode("utf-8", "surrogatepass")
        blocks = [data[k : k + self.block] for k in range(0, len(data), self.block)]
        good = sum(map(len, map(self.good.compress, blocks)))
        bad = sum(map(len, map(self.bad.compress, blocks)))
        return (bad - good) / (bad + good) if blocks else 0.0


def compressor(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(dictionary)
    held.precompute_compress(level=level)
    return zstandard.ZstdCompressor(
        dict_data=held, level=level, write_checksum=False, write_content_size=False, write_dict_id=False
    )


def train(pieces: list[bytes], bounds: Bounds) -> bytes:
    """A trained dictionary, or the pieces themselves where there are too few to train on."""
    room = min(bounds.dictionary_bytes, max(1024, sum(map(len, pieces)) // 4))
    try:
        return zstandard.train_dictionary(room, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(pieces)[-bounds.dictionary_bytes :]


def held_out(column: str = "doc_id") -> Column:
    """Rows kept from every fit: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, bounds: Bounds, seed: int = 41) -> DataFrame:
    """text, quality and use (dictionary or calibration) of the labelled ids of smallest hash.

    An id counts once, with its smallest text, however many rows repeat it.
    """
    known = (
        labels.filter("quality in (0, 1) and doc_id is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .filter(~held_out())
        .withColumn("_h", F.xxhash64(F.lit(seed), "doc_id"))
        .withColumn("calibrate", F.pmod("_h", F.lit(3)) == 0)
    )
    parts = [
        known.filter((F.col("quality") == q) & (F.col("calibrate") == c)).orderBy("_h").limit(n)
        for q in (0, 1)
        for c, n in ((False, bounds.dictionary_docs), (True, bounds.calibration_docs))
    ]
    chosen = parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3]).select("doc_id", "quality", "calibrate")
    # At most 2 * (dictionary_docs + calibration_docs) rows of a few bytes.
    read = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")
    return read.groupBy("doc_id", "quality", "calibrate").agg(F.min("text").alias("text"))


def pieces_of(sample: DataFrame, bounds: Bounds, seed: int = 43) -> DataFrame:
    """Pieces of the dictionary rows from seeded places of the text, with the row's quality."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, quality in zip(batch["text"], batch["quality"], strict=True):
                data = text.encode("utf-8", "surrogatepass")
                draw = random.Random(zlib.crc32(data) + seed)
                for _ in range(bounds.pieces_per_doc if data else 0):
                    at = draw.randrange(max(1, len(data) - bounds.piece_bytes + 1))
                    out.append((quality, data[at : at + bounds.piece_bytes]))
            yield pd.DataFrame(out, columns=["quality", "piece"])

    return sample.filter("not calibrate").select("text", "quality").mapInPandas(cut, "quality int, piece binary")


def difference_udf(good: bytes, bad: bytes, bounds: Bounds):
    @F.pandas_udf("double")
    def difference(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        measure = Measure(good, bad, bounds)
        for texts in batches:
            yield texts.map(measure).astype("float64")

    return difference


def logistic_fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and intercept by Newton steps."""
    inputs, w = np.c_[x, np.ones_like(x)], np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(inputs @ w, -30, 30)))
        gradient = inputs.T @ (weight * (p - y)) + ridge * w
        curvature = (inputs * (weight * p * (1 - p))[:, None]).T @ inputs + ridge * np.eye(2)
        step = np.linalg.solve(curvature, gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit_quality(docs: DataFrame, labels: DataFrame, bounds: Bounds = Bounds()) -> QualityModel:
    """Fit on labelled rows outside the held-out quarter. The driver gets pieces and numbers, no texts."""
    shares = {
        r["quality"]: r["count"]
        for r in labels.filter("quality in (0, 1)").filter(~held_out()).groupBy("quality").count().collect()
    }
    total = sum(shares.values())
    prior = shares.get(1, 0) / total if total else 0.5
    none = QualityModel(b"", b"", 0.0, 0.0, prior, bounds)
    if not shares.get(0) or not shares.get(1):
        return none
    sample = store_once(labelled_sample(docs, labels, bounds), "quality-sample")
    pieces: dict[int, list[bytes]] = {0: [], 1: []}
    for row in sorted((r[0], bytes(r[1])) for r in pieces_of(sample, bounds).collect()):
        pieces[row[0]].append(row[1])
    if not pieces[0] or not pieces[1]:
        return none
    for part in pieces.values():
        random.Random(47).shuffle(part)
    good, bad = train(pieces[1], bounds), train(pieces[0], bounds)
    measured = sample.filter("calibrate and text <> ''").select(
        difference_udf(good, bad, bounds)("text").alias("x"), "quality"
    )
    rows = measured.toPandas().sort_values(["x", "quality"])
    y = rows["quality"].to_numpy(dtype=float)
    if not 0 < y.mean() < 1:
        return none
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    slope, intercept = logistic_fit(10 * rows["x"].to_numpy(), y, weight)
    return QualityModel(good, bad, 10 * slope, intercept, prior, bounds)


def with_quality(df: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """Add ``score``: the probability of label 1."""
    df = df.drop("score")
    small_batches(df.sparkSession)
    if not model.good:
        return df.withColumn("score", F.lit(model.prior))
    name = free_name(df, "_difference")
    body = text_of(f"`{text}`")
    measured = df.withColumn(name, difference_udf(model.good, model.bad, model.bounds)(body))
    logit = F.col(name) * model.slope + model.intercept
    return measured.withColumn(
        "score", F.when(body == "", F.lit(model.prior)).otherwise(1 / (1 + F.exp(-logit)))
    ).drop(name)


def op6_compression_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return with_quality(docs.select("doc_id", "text"), model).select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
