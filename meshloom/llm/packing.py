"""Packing of tokenised documents into sequences of bounded length by the sum-of-squares rule.

``tokenise`` turns a text into ids and a closing id; what is longer than a sequence is cut
into pieces, of which only the first may be shorter. ``pack`` deals the pieces into groups
of bounded size by hash and places each group's pieces, longest first or in a seeded order
(whichever needs fewer sequences, with and without a preference for open sequences), where the sum of
the squared numbers N of open sequences per gap becomes smallest: a gap that occurs changes it
by 2 (N(gap - piece) - N(gap)) + 2, or 1 - 2 N(gap) where the piece fills it, and a new sequence by
2 N(capacity - piece) + 1, or 0 where the piece is as long as a sequence. Groups are
independent tasks; each leaves at most a few sequences part-filled.

A null or empty text is the closing id alone. Repeated rows are packed one by one, and rows equal in
every column are dealt to groups singly; null
ids are kept. Very long texts give many pieces. Equal sums go to the fuller sequence, an open one before a new one. An
empty table gives no rows.
"""

from __future__ import annotations

import base64
import math
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.llm.common import free_name, numbered_copies, row_hash, small_batches, table, text_of
from meshloom.session import store_once

#: One vocabulary in two forms: for the tokenizers library, and as ranks for tiktoken.
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: A space before other white space or the end, or a special token: such texts are tokenised whole.
UNUSUAL = r" (?:[ \t-\r\x{85}\pZ]|\z)|<\|endoftext\|>"


class WordIds:
    """The ids that the vocabulary's tokenizer gives, each distinct word of a batch tokenised once.

    Byte-level BPE never merges across a space before a non-space, so an ordinary text is
    the sequence of its words, each but the first with the space before it; and in a run of
    such words the ids that start with a space mark where words start. Other texts go through
    the tokenizer as they are.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(os.path.join(os.path.dirname(path), RANKS), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encode = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary
        self.spaced = np.zeros(max(ranks.values()) + 1, dtype=bool)
        self.spaced[[rank for token, rank in ranks.items() if token[:1] == b" "]] = True

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text (no nulls)."""
        odd = pc.match_substring_regex(texts, UNUSUAL)
        ordinary = iter(self.by_words(texts.filter(pc.invert(odd))))
        whole = iter(self.whole.encode_batch(texts.filter(odd).to_pylist(), add_special_tokens=False))
        return [
            np.array(next(whole).ids, dtype=np.uint32) if o else next(ordinary)
            for o in odd.to_numpy(zero_copy_only=False).tolist()
        ]

    def by_words(self, texts: pa.Array) -> list[np.ndarray]:
        split = pc.split_pattern(texts, " ")
        ends = split.offsets.to_numpy() - split.offsets[0].as_py()
        words = split.flatten()
        inner = np.ones(len(words), dtype=bool)
        inner[ends[:-1]] = False
        coded = words.filter(pa.array(inner)).dictionary_encode()
        code = coded.indices.to_numpy()
        distinct = len(coded.dictionary)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, distinct], pa.int32()), coded.dictionary), " ")
        flat = np.array(self.encode(" " + joined[0].as_py() if distinct else ""), dtype=np.uint32)
        starts = np.append(np.flatnonzero(self.spaced[flat]), len(flat))
        lengths, starts = np.diff(starts), starts[:-1]
        if len(starts) != distinct:
            raise ValueError("ids do not mark where words start")
        out = []
        for i, first in enumerate(words.filter(pa.array(~inner)).to_pylist()):
            c = code[ends[i] - i : ends[i + 1] - i - 1]
            n = lengths[c]
            # The place in ``flat`` of every id of these words, one after the other.
            at = np.repeat(starts[c] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out.append(np.concatenate([np.array(self.encode(first), dtype=np.uint32), flat[at]]))
        return out


def pieces_of(ids: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece: full pieces at the end, the rest first."""
    first = len(ids) % capacity or capacity
    return [(0, min(first, len(ids)))] + [(s, capacity) for s in range(first, len(ids), capacity)]


def tokenise(
    docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, batch_chars: int = 4 << 20
) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(path)
        for batch in batches:
            size = pc.utf8_length(batch["text"]).to_numpy()
            part = np.cumsum(size) // batch_chars
            bounds = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
            for a, b in zip(bounds, bounds[1:]):
                if b > a:
                    yield rows(words, batch.slice(a, b - a))

    def rows(words: WordIds, batch: pa.RecordBatch) -> pa.RecordBatch:
        at, piece, start, length, crc, kept = [], [], [], [], [], []
        for i, ids in enumerate(words(batch["text"])):
            ids = np.append(ids, np.uint32(end_id)).astype("<u4")
            for k, (s, n) in enumerate(pieces_of(ids, capacity)):
                at.append(i), piece.append(k), start.append(s), length.append(n)
                crc.append(zlib.crc32(ids[s : s + n].tobytes()))
                if with_ids:
                    kept.append(ids[s : s + n].astype(np.int32))
        columns = [
            batch["doc_id"].take(pa.array(at, pa.int64())),
            pa.array(piece, pa.int32()),
            *[pa.array(x, pa.int64()) for x in (start, length, crc)],
        ]
        if with_ids:
            columns.append(pa.array(kept, pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(cut, schema)


def fewest(lengths: np.ndarray, capacity: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces sorted longest first: the best of both orders and both rules on near ties."""
    mixed = np.random.default_rng(seed).permutation(len(lengths))
    best = None
    for order in (np.arange(len(lengths)), mixed):
        for prefer_open in (False, True):
            sequence, offset, used = place(lengths[order], capacity, prefer_open)
            if best is None or used < best[0]:
                back = np.argsort(order)
                best = used, sequence[back], offset[back]
    return best[1], best[2]


def place(lengths: np.ndarray, capacity: int, prefer_open: bool = True) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence and offset of each piece in the order given, and the number of sequences.

    With ``prefer_open`` a new sequence must make the sum smaller by two at least.
    """
    open_ = np.zeros(capacity + 1, dtype=np.int64)  # sequences by gap; full ones don't count
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    used = 0
    for i, n in enumerate(lengths.tolist()):
        gaps = open_[n:]
        change = np.where(gaps > 0, 2 * (open_[: capacity + 1 - n] - gaps) + 2, np.iinfo(np.int64).max)
        change[0] -= gaps[0] > 0  # a full sequence is no longer counted
        left = int(change.argmin())
        if change[left] <= (2 * open_[capacity - n] + 1 if n < capacity else 0) + prefer_open:
            gap = left + n
            open_[gap] -= 1
            number = stacks[gap].pop()
        else:
            gap, left, number = capacity, capacity - n, used
            used += 1
        sequence[i], offset[i] = number, capacity - gap
        if left:
            open_[left] += 1
            stacks[left].append(number)
    return sequence, offset, used


def pack(pieces: DataFrame, capacity: int = 2048, group_rows: int = 50_000, seed: int = 31) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a table of pieces with a ``length`` of at most ``capacity``.

    ``pieces`` is read twice (counted, then placed): pass a stored table, without map columns, as
    equal rows are counted and numbered. Sequence numbers are group * 2^32 + number in the group.
    """
    pieces = pieces.drop("sequence_id", "offset")
    groups = max(1, math.ceil(pieces.count() / group_rows))
    name, copy = free_name(pieces, "_group"), free_name(pieces, "_copy")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)

    def placed(part: pd.DataFrame) -> pd.DataFrame:
        group = int(part[name].iloc[0])
        part = part.drop(columns=name).sort_values(["length", *order], ascending=False, kind="stable")
        sequence, offset = fewest(part["length"].to_numpy(), capacity, seed)
        return part.assign(sequence_id=sequence + (group << 32), offset=offset)

    order = [c for c in ("doc_id", "piece") if c in pieces.columns]
    return (
        numbered_copies(pieces, copy)
        .withColumn(name, F.pmod(row_hash(pieces, seed, [*pieces.columns, copy]), F.lit(groups)))
        .drop(copy)
        .groupBy(name)
        .applyInPandas(placed, schema + ", sequence_id long, offset long")
    )


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of all documents with their places; ids are cut once, into a table of lengths."""
    return pack(store_once(tokenise(docs, path, capacity, end_id), "pieces"), capacity)


def packed_ids(pieces: DataFrame, places: DataFrame) -> DataFrame:
    """The sequences themselves: ``sequence_id`` and its ids, for pieces that carry ``ids``."""
    keyed = pieces.select("doc_id", "piece", "ids").join(places, ["doc_id", "piece"])
    listed = keyed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return listed.select("sequence_id", F.flatten("parts.ids").alias("ids"))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op10_sum_of_squares(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary_path())
