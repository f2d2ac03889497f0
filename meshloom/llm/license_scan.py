"""License scans by conditional compression.

Words around each licensing word, as many as two of the longest template's, are a region. Every template of whose words
a region has enough is aligned with it: at each word the span ending there that differs from the template
in the fewest words. Spans holding enough of the template's words in order are candidates. A candidate is compressed alone and
with its template as zstandard raw dictionary, and stays if that shortens it enough. Of overlapping candidates the one that holds most
words beyond its differences is reported, so a text's spans never overlap.

A notice with more foreign words than its own is no such span. So what the spans leave of each block (sentences with a
licensing word, joined over small gaps) is also compared as a whole, and the template with the fewest differing words reported.

Texts are searched whole. Null and empty texts have no findings; a text with several notices
has several; repeated rows are scanned each. Ties go to the larger reduction, then the
template first by name. Differences in case, punctuation, line breaks and white space do not count. An
empty table gives no rows. The work is done row by row, so no group can grow hot.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.llm.common import small_batches, table

# Notices as their licences publish them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:"
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "Reserved": "All rights reserved.",
}
HINT = (
    r"(?i)licen[cs]|copyright|rights[\W_]+reserved|redistribut|hereby[\W_]+granted|public[\W_]+domain|warranty|creative[\W_]+commons"
)

SENTENCE = re.compile(r"[^\n]*?(?:[.!?](?=\s)|\n|$)", re.S)
WORDS = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
MARKS = re.compile(r"[^\w\s]*")


@dataclass(frozen=True)
class Limits:
    min_reduction: float = 0.2
    min_share: float = 0.8
    gap_chars: int = 80
    level: int = 9


class Scanner:
    def __init__(self, templates: dict[str, str], limits: Limits):
        self.limits, self.hint = limits, re.compile(HINT)
        self.names = sorted(templates)
        self.words = {n: WORDS.findall(templates[n].lower()) for n in self.names}
        self.alone = zstandard.ZstdCompressor(level=limits.level, write_content_size=False, write_checksum=False)
        self.longest = max(map(len, self.words.values()), default=0)
        self.given = {}
        for n in self.names:
            held = zstandard.ZstdCompressionDict(
                " ".join(self.words[n]).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT
            )
            self.given[n] = zstandard.ZstdCompressor(
                level=limits.level, dict_data=held, write_content_size=False, write_checksum=False
            )

    def blocks(self, text: str) -> Iterator[tuple[int, int]]:
        """Spans of sentences with a licensing word, joined where little lies between them."""
        start = end = -1
        for sentence in SENTENCE.finditer(text):
            if sentence.end() == sentence.start() or not self.hint.search(sentence.group()):
                continue
            if start >= 0 and sentence.start() - end > self.limits.gap_chars:
                yield start, end
                start = -1
            start, end = sentence.start() if start < 0 else start, sentence.end()
        if start >= 0:
            yield start, end

    def reduction(self, block: list[str], name: str) -> float:
        data = " ".join(block).encode()
        return 1 - len(self.given[name].compress(data)) / len(self.alone.compress(data))

    def differences(self, block: list[str], name: str) -> tuple[int, int]:
        """Template words that the block lacks, and words that it has between those it holds."""
        wanted = self.words[name]
        runs = [m for m in SequenceMatcher(None, wanted, block, autojunk=False).get_matching_blocks() if m.size]
        held = sum(m.size for m in runs)
        span = runs[-1].b + runs[-1].size - runs[0].b if runs else 0
        return len(wanted) - held, span - held

    def enough(self, held: int, name: str) -> bool:
        return held >= self.limits.min_share * len(self.words[name])

    def aligned(self, words: list[str], name: str) -> Iterator[tuple[int, int, int, int]]:
        """Spans [first, last) of ``words`` near the template, each the best of its end, with missing and extra words."""
        wanted = self.words[name]
        m, at = len(wanted), defaultdict(list)
        for i, w in enumerate(wanted):
            at[w].append(i)
        # A cell is differences << 32 | start: of equal differences the longer span holds more of the template.
        one, steps = 1 << 32, np.arange(m + 1, dtype=np.int64) << 32
        row = steps.copy()
        for end, word in enumerate(words, 1):
            before, row = row, row + one
            row[0] = end
            here = at.get(word)
            if here:
                i = np.array(here)
                row[i + 1] = np.minimum(row[i + 1], before[i])
            row = np.minimum.accumulate(row - steps) + steps
            if here and row[m] < before[m] + one:
                differ, first = int(row[m]) >> 32, int(row[m]) & (one - 1)
                held = (m + end - first - differ) // 2
                if held and self.enough(held, name):
                    yield first, end, m - held, end - first - held

    def candidates(self, words: list[str], hinted: list[tuple[int, int]]) -> dict[int, list[tuple[int, int, str, int, int]]]:
        """Spans near a template by how many words they hold beyond their differences."""
        regions: list[list[int]] = []
        for first, last in hinted:
            first, last = max(0, first - 2 * self.longest), min(len(words), last + 2 * self.longest)
            if regions and first <= regions[-1][1]:
                regions[-1][1] = max(last, regions[-1][1])
            else:
                regions.append([first, last])
        found = defaultdict(list)
        for first, last in regions:
            part = words[first:last]
            has = Counter(part)
            for name in self.names:
                if self.enough(sum(min(n, has[w]) for w, n in Counter(self.words[name]).items()), name):
                    for a, b, missing, extra in self.aligned(part, name):
                        found[len(self.words[name]) - 2 * missing - extra].append((first + a, first + b, name, missing, extra))
        return found

    def scan(self, text: str) -> Iterator[tuple[int, int, str, float, int, int]]:
        tokens = [(m.start(), m.end()) for m in WORDS.finditer(text)]
        words = [text[a:b].lower() for a, b in tokens]
        starts, ends = [a for a, _ in tokens], [b for _, b in tokens]
        hints = [m.span() for m in self.hint.finditer(text)]
        found, taken = [], np.zeros(len(words) + 1, bool)
        candidates = self.candidates(words, [(bisect_right(ends, a), bisect_left(starts, b)) for a, b in hints])
        for worth in sorted(candidates, reverse=True):
            open_ = [
                (-self.reduction(words[a:b], name), name, a, b, missing, extra)
                for a, b, name, missing, extra in candidates[worth]
                if not taken[a:b].any()
            ]
            for reduction, name, a, b, missing, extra in sorted(open_):
                if -reduction >= self.limits.min_reduction and not taken[a:b].any():
                    taken[a:b] = True
                    # Marks that touch the last word belong to it.
                    last = MARKS.match(text, ends[b - 1]).end()
                    found.append((starts[a], last, name, -reduction, missing, extra))
        for start, end in self.blocks(text):
            a, last = bisect_left(starts, start), bisect_left(starts, end)
            while a < last:
                b = a
                while b < last and not taken[b]:
                    b += 1
                if b > a and self.hint.search(text, starts[a], ends[b - 1]):
                    found.extend(self.whole(words[a:b], starts[a], MARKS.match(text, ends[b - 1]).end()))
                a = b + 1
        yield from sorted(found)

    def whole(self, block: list[str], start: int, end: int) -> Iterator[tuple[int, int, str, float, int, int]]:
        """The template nearest to a block, if the block has enough of it."""
        winners = []
        for name in self.names:
            reduction = self.reduction(block, name)
            if reduction >= self.limits.min_reduction:
                missing, extra = self.differences(block, name)
                if self.enough(len(self.words[name]) - missing, name):
                    winners.append((missing + extra, -reduction, name, missing, extra))
        if winners:
            _, reduction, name, missing, extra = min(winners)
            yield start, end, name, -reduction, missing, extra


def scan_licenses(df: DataFrame, templates: dict[str, str] = TEMPLATES, limits: Limits = Limits()) -> DataFrame:
    """doc_id, span (start, end in characters), license, reduction, missing, extra and the span's wording."""
    kind = df.schema["doc_id"].dataType.simpleString()

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates, limits)
        columns = ["at", "start", "end", "license", "reduction", "missing", "extra", "wording"]
        for batch in batches:
            texts = batch["text"].tolist()
            rows = [(i, *found, t[found[0] : found[1]].strip()) for i, t in enumerate(texts) for found in scanner.scan(t)]
            out = pd.DataFrame(rows, columns=columns)
            ids = batch["doc_id"].iloc[out["at"]].reset_index(drop=True)
            yield out.assign(doc_id=ids)[["doc_id", *columns[1:]]]

    small_batches(df.sparkSession)
    hits = df.select("doc_id", "text").filter(F.col("text").rlike(HINT))
    return hits.mapInPandas(
        find,
        f"doc_id {kind}, start long, end long, license string, reduction double, missing int, extra int, wording string",
    )


def op2_license_blocks(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents"))
