import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from fixtures import CLASHING, documents, empty, odd_rows, plain, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meshloom.llm.components import components
from meshloom.llm import jaccard_join
from meshloom.llm.jaccard_join import Join, near_duplicates, one_of_each_group
from meshloom.llm.packing import (
    WordIds,
    op10_sum_of_squares,
    pack,
    pack_documents,
    packed_ids,
    pieces_of,
    place,
    tokenise,
    vocabulary_path,
)
from meshloom.llm.topk_search import integer_vectors, top_products
from meshloom.session import store_once


def brute_groups(rows, k, num, den):
    """(shingles, group) of each row: all pairs that share a shingle are compared."""
    sets = []
    for _, t in rows:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append(frozenset(tuple(w[a : a + k]) for a in range(max(1, len(w) - k + 1))) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    lists = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            lists[g].append(i)
    for a, b in {(a, b) for held in lists.values() for b in held for a in held if a < b}:
        shared = len(sets[a] & sets[b])
        if den * shared >= num * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i) if sets[i] else ("alone", i)].append(i)
    out = []
    for i in range(len(rows)):
        ids = [rows[j][0] for j in groups[find(i) if sets[i] else ("alone", i)] if rows[j][0] is not None]
        out.append((rows[i][0], len(sets[i]), min(ids, default=None)))
    return sorted(out, key=repr)


def families(rng, groups, copies):
    """Near copies of some texts at all distances, with a passage that all share."""
    passage = prose(rng, 25)
    rows = []
    for _ in range(groups):
        words = (prose(rng, rng.choice([20, 60, 150])) + " " + passage).split()
        for _ in range(copies):
            near = words.copy()
            for _ in range(rng.randrange(6)):
                near[rng.randrange(len(near))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(near)))
    return rows


@pytest.mark.parametrize(
    "join",
    [
        Join(),
        Join(words=5, num=4, den=5),
        Join(yielding=0.0, rounds=3),
        Join(words=2, num=1, den=2, sieve=0.2, longest=4),
    ],
)
def test_groups_equal_brute_force(spark, join):
    rows = families(random.Random(join.words * 10 + join.rounds), 5, 24) + [r[:2] for r in odd_rows()]
    rows = [(None if i is None else 1000 + i if k >= 120 else i, t) for k, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert plain(near_duplicates(docs, join)) == brute_groups(rows, join.words, join.num, join.den)


def family_of_far_copies(members):
    """Sets of one text with three to five words changed, and for every tenth member a sibling with one word more."""
    rng = random.Random(members)
    words = prose(rng, 150).split()
    texts = []
    for i in range(members):
        near = words.copy()
        for at in rng.sample(range(len(near)), rng.randrange(3, 6)):
            near[at] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(near))
        if i % 10 == 0:
            near[rng.randrange(len(near))] = f"s{i}"
            texts.append(" ".join(near))
    return jaccard_join.shingle_sets(pa.array(texts), Join().words)


def least_of_components(nodes, pairs):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in nodes}


def test_listing_of_one_family_is_short(spark, monkeypatch):
    join, rows = Join(), {}
    counted = jaccard_join.counted_pairs
    for members in (200, 600):
        sets = {jaccard_join.set_key(s): s for s in family_of_far_copies(members)}
        stored = store_once(
            spark.createDataFrame([(k, len(s), s.tobytes()) for k, s in sets.items()], "node long, n long, shingles binary"), "sets"
        )
        live = store_once(jaccard_join.shingle_entries(stored, None, join).withColumn("comp", F.col("node")), "live")
        rows[members] = 0

        def counting(met, members=members):
            rows[members] += met.count()
            return counted(met)

        monkeypatch.setattr(jaccard_join, "counted_pairs", counting)
        pairs = store_once(jaccard_join.listed_pairs(live, stored, join), "pairs")
        found = {tuple(r) for r in jaccard_join.verified(pairs, stored, join).collect()}
        keys = list(sets)
        truth = set()
        for i, a in enumerate(keys):
            for b in keys[:i]:
                shared = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if join.links(shared, len(sets[a]), len(sets[b])):
                    truth.add((a, b))
        assert len(truth) >= members // 10
        assert least_of_components(keys, found) == least_of_components(keys, truth)
        # Not linear (443 and 5,875 rows were measured), but far from the shared shingles of all pairs.
        assert 1000 * rows[members] <= sum(np.unique(np.concatenate(list(sets.values())), return_counts=True)[1] ** 2)


def test_listing_of_a_family_without_its_first_text_is_short(spark, monkeypatch):
    """Changes that a member used as centre has itself are not common to all pairs, and linked members are not listed."""
    join, rows = Join(num=4, den=5), []
    sets = {jaccard_join.set_key(s): s for s in family_of_far_copies(600)}
    stored = store_once(
        spark.createDataFrame([(k, len(s), s.tobytes()) for k, s in sets.items()], "node long, n long, shingles binary"), "sets"
    )
    live = store_once(jaccard_join.shingle_entries(stored, None, join).withColumn("comp", F.col("node")), "live")
    counted = jaccard_join.counted_pairs

    def counting(met):
        rows.append(met.count())
        return counted(met)

    monkeypatch.setattr(jaccard_join, "counted_pairs", counting)
    pairs = store_once(jaccard_join.listed_pairs(live, stored, join), "pairs")
    found = {tuple(r) for r in jaccard_join.verified(pairs, stored, join).collect()}
    truth = set()
    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and join.links(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)):
                truth.add((a, b))
    assert len(truth) > 60
    assert least_of_components(sets, found) == least_of_components(sets, truth)
    # 49,161 rows for 8,194 links (3,844,951 with changes from a pivot)
    assert sum(rows) <= 10 * len(truth)


def test_one_row_of_each_group_stays(spark):
    docs = documents(spark)
    out = one_of_each_group(docs)
    assert out.columns == docs.columns
    rows = [r[:2] for r in odd_rows()]
    groups = brute_groups(rows, 5, 4, 5)
    named = {g for _, n, g in groups if n and g is not None}
    empty_rows = [r for r in groups if not r[1]]
    without_id = 1  # the text without an id is a group of its own
    assert out.count() == len(named) + len(empty_rows) + without_id
    assert named <= {r["doc_id"] for r in out.collect()}
    assert one_of_each_group(empty(spark)).count() == 0 and near_duplicates(empty(spark)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(3, 3), (260, 7), (260, 7)]
    out = {r["u"]: r["v"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {**{i: 100 for i in range(101, 141)}, **{i: 7 for i in [*range(200, 260), 260]}}


def reference_ids(texts):
    whole = Tokenizer.from_file(vocabulary_path())
    return [whole.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list(" \n\t\xa0a.é1'sÉ漢　<|>")), max_size=14), max_size=12))
def test_word_ids_equal_the_tokenizer(texts):
    texts = [*texts, "", " ", "a <|endoftext|> b", "plain words here", "plain  words"]
    words = test_word_ids_equal_the_tokenizer.__dict__.setdefault("words", WordIds(vocabulary_path()))
    assert [x.tolist() for x in words(pa.array(texts, pa.string()))] == reference_ids(texts)


def test_pieces_are_full_but_the_first():
    assert pieces_of(np.zeros(5), 4) == [(0, 1), (1, 4)] and pieces_of(np.zeros(8), 4) == [(0, 4), (4, 4)]
    assert pieces_of(np.zeros(3), 4) == [(0, 3)]


def test_sum_of_squares_choice():
    # After 6 and 6 of 10 (two gaps of 4), a 4 fills a gap; a 3 would leave gaps (4, 1) or (4, 4, 7).
    assert place(np.array([6, 6, 4, 3]), 10)[0].tolist() == [0, 1, 1, 0]
    rng = np.random.default_rng(1)
    lengths = np.sort(rng.integers(1, 2049, 4000))[::-1]
    sequence, offset, used = place(lengths, 2048)
    assert used <= 1.04 * lengths.sum() / 2048
    fill = np.zeros(used, int)
    for s, o, n in zip(sequence, offset, lengths, strict=True):
        assert fill[s] == o
        fill[s] += n
    assert fill.max() <= 2048


def least_squares(lengths, capacity):
    """Gaps after each placement, by trying every choice."""
    gaps = []
    for n in lengths:
        choices = []
        for gap in [*sorted({g for g in gaps if g >= n}), None]:
            after = gaps.copy()
            if gap is not None:
                after.remove(gap)
            after.append((capacity if gap is None else gap) - n)
            squares = sum(c * c for g, c in Counter(after).items() if g)
            choices.append((squares, gap is None, after[-1], after))
        gaps = min(choices)[-1]
    return sorted(gaps)


@pytest.mark.parametrize("seed", range(30))
def test_places_equal_brute_force(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 21, 60)
    sequence, _, used = place(lengths, 20, prefer_open=False)
    fill = np.bincount(sequence, lengths, used)
    assert sorted((20 - fill).astype(int).tolist()) == least_squares(lengths.tolist(), 20)


def test_equal_rows_are_dealt_to_all_groups(spark):
    pieces = spark.range(300).selectExpr("if(id < 200, 7, id) as doc_id", "cast(0 as int) as piece", "5L as length")
    out = pack(store_once(pieces, "equal"), 10, group_rows=30)
    assert out.count() == 300
    hot = out.filter("doc_id = 7").groupBy(F.expr("shiftright(sequence_id, 32)")).count().collect()
    assert len(hot) == 10 and max(r["count"] for r in hot) < 60


def test_packing_of_odd_rows(spark):
    docs = documents(spark)
    out = pack_documents(docs, vocabulary_path(), 64).collect()
    fill = defaultdict(list)
    for r in out:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in fill.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) <= 64
    want = sorted(
        ((i, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for i, ids in whole_ids() for k, (s, n) in enumerate(pieces_of(ids, 64))),
        key=repr,
    )
    assert sorted((tuple(r)[:5] for r in out), key=repr) == want
    assert pack_documents(empty(spark), vocabulary_path()).count() == 0


def whole_ids():
    rows = odd_rows()
    return [(r[0], [*ids, 0]) for r, ids in zip(rows, reference_ids([r[1] or "" for r in rows]), strict=True)]


def test_sequences_hold_the_ids(spark):
    docs = documents(spark, odd_rows()[:40], extra=False)
    pieces = store_once(tokenise(docs, vocabulary_path(), 64, with_ids=True), "pieces")
    places = pack(pieces.drop("ids"), 64)
    sequences = packed_ids(pieces, places).collect()
    total = sum(len(ids) + 1 for ids in reference_ids([r[1] for r in odd_rows()[:40]]))
    assert sum(len(r["ids"]) for r in sequences) == total and max(len(r["ids"]) for r in sequences) <= 64


def test_pack_keeps_other_columns(spark):
    pieces = spark.createDataFrame([(1, 5, "x"), (2, 3, None)], "doc_id long, length long, _group string")
    assert plain(pack(pieces, 8).select("doc_id", "_group", "sequence_id", "offset")) == [(1, "x", 0, 0), (2, None, 0, 5)]


def test_packing_query_is_close_to_the_bound(spark):
    out = op10_sum_of_squares(spark, "/root/testdata/sf0.01")
    used, total = out.agg(F.count_distinct("sequence_id"), F.sum("length")).first()
    assert used <= 1.01 * total / 2048 + 1


def brute_top(vectors, k):
    out = []
    for q, v in vectors:
        if q % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in vectors if c != q and len(w) == len(v))
        out += [(q, i + 1, c, -s) for i, (s, c) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("bucket_rows,block_rows,dim", [(1000, 1000, 8), (40, 2, 3), (64, 3, 2)])
def test_top_products_equal_brute_force(spark, bucket_rows, block_rows, dim):
    rng = np.random.default_rng(dim)
    raw = [(i, (rng.normal(size=dim) * 10 ** rng.uniform(-1, 1)).astype(np.float32).tolist()) for i in range(400)]
    raw += [(1000 + i, raw[5][1]) for i in range(150)]  # a third are one vector
    raw += [(1200 + i, [0.0] * dim) for i in range(3)]
    odd = [(2000, None), (2050, [None] * dim), (2100, [float("nan")] * dim), (2150, [float("inf")] * dim), (None, [1.0] * dim), (2200, [1.0]), (2201, [2.0])]
    items = integer_vectors(spark.createDataFrame(raw + odd, "vec_id long, embedding array<float>"))
    out = top_products(items.filter("id % 50 = 0"), items, 5, bucket_rows=bucket_rows, block_rows=block_rows)
    kept = raw + [(2200, [1.0]), (2201, [2.0])]
    vectors = [(i, [int(np.floor(np.float64(np.float32(x)) * 256)) for x in v]) for i, v in kept]
    assert plain(out) == sorted(brute_top(vectors, 5), key=repr)


def test_top_products_of_empty_tables(spark):
    items = integer_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert top_products(items, items).count() == 0
    one = integer_vectors(spark.createDataFrame([(50, [1.0])], "vec_id long, embedding array<float>"))
    assert top_products(one, one).count() == 0


def test_huge_components_saturate(spark):
    items = integer_vectors(spark.createDataFrame([(0, [1e30]), (1, [1e30]), (2, [-3e38])], "vec_id long, embedding array<double>"))
    assert plain(top_products(items.filter("id = 0"), items)) == [(0, 1, 1, 2**63 - 1), (0, 2, 2, -(2**63))]


def test_clashing_names_are_told_apart():
    assert len(set(CLASHING)) == len(CLASHING)
