"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

A text is lower-cased, other characters than letters become single spaces, and its n-grams of 1 to
``orders`` characters are hashed to ``buckets`` features. Weights 1 + ln(count) times inverse
document frequency are scaled to length 1. The model is trained by
follow-the-regularised-leader with an elastic-net penalty, so most weights are exactly
zero; a temperature fitted on texts kept from training calibrates its probabilities.

The fit uses at most ``Settings.docs_per_language`` documents a language, those of smallest
seeded hash, each as a whole and as short cuttings, so that short texts are known too. The
prediction depends on the text alone. A text that is null or has no letters is ``und``, score
0; so is every text where nothing could be learned. Ties go to the language first by code point.
Repeated rows get equal results; an empty table gives no rows. Columns ``lang_pred`` and
``score`` are replaced.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshloom.llm.common import by_ids, free_name, small_batches, table, text_of
from meshloom.llm.quality import held_out
from meshloom.session import store_once

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    docs_per_language: int = 400
    cuttings: int = 2
    cutting_chars: int = 160
    orders: int = 3
    buckets: int = 1 << 15
    epochs: int = 4
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.02


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    settings: Settings


@functools.cache
def letter_table() -> np.ndarray:
    """Whether each code point is a letter; made once a worker process."""
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)


class Grams:
    """Hashed n-gram features of a text."""

    def __init__(self, settings: Settings):
        self.settings = settings
        self.letter = letter_table()
        self.shift = np.uint32(32 - int(math.log2(settings.buckets)))

    def letters(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
        codes = np.where(self.letter[codes], codes, np.uint32(32))
        space = codes == 32
        codes = codes[~(space & np.append(True, space[:-1]))]
        return codes if len(codes) and (codes != 32).any() else codes[:0]

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Features that occur and their counts; none for a text without letters."""
        codes = self.letters(text)
        if not len(codes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        codes = np.concatenate([[np.uint32(32)], codes, [np.uint32(32)]]).astype(np.uint32)
        hashed, found = np.zeros(len(codes), np.uint32), []
        for order in range(self.settings.orders):
            n = len(codes) - order
            if n <= 0:
                break
            hashed = (hashed[:n] ^ (codes[order : order + n] + np.uint32(order))) * np.uint32(0x9E3779B1)
            hashed ^= hashed >> np.uint32(15)
            found.append((hashed * np.uint32(0x85EBCA6B)) >> self.shift)
        counts = np.bincount(np.concatenate(found), minlength=self.settings.buckets)
        at = np.flatnonzero(counts)
        return at, counts[at]


def scaled(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[at]
    return x / max(np.sqrt(x @ x), 1e-12)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max())
    return e / e.sum()


def training_sample(docs: DataFrame, settings: Settings, seed: int = 53) -> DataFrame:
    """Features of the sampled documents and their cuttings: lang, part (0: whole), fit, at, counts.

    An id counts once, however many rows repeat it: with the smallest language that the sieve
    leaves it and the smallest text of that language.
    """
    known = docs.filter("lang is not null and text is not null and doc_id is not null").filter(~held_out())
    known = known.select("doc_id", "lang", F.xxhash64(F.lit(seed), "doc_id").alias("_h"))
    # A first sieve by hash keeps little more than is wanted of each language, whatever its share.
    share = known.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("_n"))
    wanted = 2.0 * settings.docs_per_language + 50
    sieved = known.join(share, "lang").filter(F.pmod("_h", F.lit(1_000_000)) < F.lit(wanted) / F.col("_n") * 1_000_000)
    once = sieved.groupBy("doc_id", "_h").agg(F.min("lang").alias("lang"))
    first = Window.partitionBy("lang").orderBy("_h", "doc_id")
    ranked = once.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= settings.docs_per_language)
    # Texts are read for these rows alone.
    chosen = store_once(ranked.select("doc_id", "lang", "_rank"), "language-sample")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = Grams(settings)
        for batch in batches:
            rows = []
            for text, lang, rank in zip(batch["text"], batch["lang"], batch["_rank"], strict=True):
                draw = np.random.default_rng(zlib.crc32(text.encode("utf-8", "surrogatepass")))
                parts = [text]
                for n in draw.integers(8, settings.cutting_chars, settings.cuttings).tolist():
                    at = int(draw.integers(0, max(1, len(text) - n)))
                    parts.append(text[at : at + n])
                for k, part in enumerate(parts):
                    at, counts = grams(part)
                    if len(at):
                        rows.append((lang, rank, k, rank % 5 != 0, at.tolist(), counts.tolist()))
            yield pd.DataFrame(rows, columns=["lang", "rank", "part", "fit", "at", "counts"])

    read = by_ids(docs.filter("text is not null").select("doc_id", "lang", "text"), chosen, ["doc_id", "lang"])
    texts = read.groupBy("lang", "_rank").agg(F.min("text").alias("text"))
    return texts.select("lang", "text", "_rank").mapInPandas(
        cut, "lang string, rank int, part int, fit boolean, at array<int>, counts array<int>"
    )


def follow_the_leader(
    rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, settings: Settings
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias after ``epochs`` passes of per-coordinate FTRL-proximal."""
    # The last feature is the bias, always 1.
    z = np.zeros((settings.buckets + 1, classes))
    n = np.zeros_like(z)

    def solve(zz: np.ndarray, nn: np.ndarray) -> np.ndarray:
        shrunk = np.sign(zz) * np.maximum(np.abs(zz) - settings.l1, 0)
        return -shrunk / ((settings.beta + np.sqrt(nn)) / settings.alpha + settings.l2)

    draw = np.random.default_rng(59)
    for _ in range(settings.epochs):
        for i in draw.permutation(len(rows)).tolist():
            at, x, label = rows[i]
            at, x = np.append(at, settings.buckets), np.append(x, 1.0)
            w = solve(z[at], n[at])
            error = softmax(x @ w)
            error[label] -= 1
            g = x[:, None] * error
            before = n[at]
            after = before + g * g
            z[at] += g - (np.sqrt(after) - np.sqrt(before)) / settings.alpha * w
            n[at] = after
    weights = solve(z, n)
    return weights[:-1], weights[-1]


def fitted_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm."""

    def loss(log_t: float) -> float:
        scaled_ = logits / math.exp(log_t)
        top = scaled_.max(axis=1)
        return float(np.mean(np.log(np.exp(scaled_ - top[:, None]).sum(axis=1)) + top - scaled_[np.arange(len(labels)), labels]))

    low, high, ratio = math.log(0.02), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return math.exp((low + high) / 2)


def fit_languages(docs: DataFrame, settings: Settings = Settings()) -> LanguageModel | None:
    """Fit on documents with a language outside the held-out quarter; None if there are none."""
    found = training_sample(docs, settings).toPandas()
    if not len(found):
        return None
    found = found.sort_values(["lang", "rank", "part"])
    languages = tuple(sorted(found["lang"].unique()))
    label = {name: i for i, name in enumerate(languages)}
    examples = [
        (np.asarray(a, np.int64), np.asarray(c, np.int64), label[lang], fit)
        for a, c, lang, fit in zip(found["at"], found["counts"], found["lang"], found["fit"], strict=True)
    ]
    frequency = np.zeros(settings.buckets)
    for at, *_ in examples:
        frequency[at] += 1
    idf = np.log((1 + len(examples)) / (1 + frequency)) + 1
    rows = [(at, scaled(at, c, idf), k) for at, c, k, fit in examples if fit] or [
        (at, scaled(at, c, idf), k) for at, c, k, _ in examples
    ]
    weights, bias = follow_the_leader(rows, len(languages), settings)
    kept = [(at, scaled(at, c, idf), k) for at, c, k, fit in examples if not fit] or rows
    logits = np.array([x @ weights[at] + bias for at, x, _ in kept])
    temperature = fitted_temperature(logits, np.array([k for *_, k in kept]))
    return LanguageModel(languages, idf, weights, bias, temperature, settings)


def with_language(df: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and its probability ``score``."""
    df = df.drop("lang_pred", "score")
    small_batches(df.sparkSession)
    if model is None:
        return df.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        grams = Grams(model.settings)
        for texts in batches:
            names, scores = [], []
            for body in texts:
                at, counts = grams(body)
                if not len(at):
                    names.append(UNKNOWN), scores.append(0.0)
                    continue
                x = scaled(at, counts, model.idf)
                p = softmax((x @ model.weights[at] + model.bias) / model.temperature)
                k = int(p.argmax())
                names.append(model.languages[k]), scores.append(float(p[k]))
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    name = free_name(df, "_language")
    return df.withColumn(name, predict(text_of(f"`{text}`"))).select(
        *[f"`{c}`" for c in df.columns], f"{name}.lang_pred", f"{name}.score"
    )


def op7_ftrl_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs)
    return with_language(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score"
    )
