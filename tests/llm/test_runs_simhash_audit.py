import hashlib
import random
import re
import zlib
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest
import xxhash
from fixtures import CLASHING, documents, empty, odd_rows, plain, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meshloom.llm.filter_audit import Ranges, Trie, audit, failure_masks, op13_radix_tries
from meshloom.llm.periodic_runs import SuffixTree, anchor, op11_lyndon_runs, runs_of, stretches, with_runs
from meshloom.llm.simhash import ball, ball_links, near_classes, near_duplicates, op12_ball_hashing, with_fingerprint
from meshloom.session import store_once

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def stored(df, tmp_path, name="documents"):
    path = str(tmp_path)
    df.write.parquet(f"{path}/{name}.parquet")
    return path


# --- periodic runs


def brute_runs(w, least=24, times=3):
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            size = i - s + q
            smaller = any(all(w[s + k] == w[s + k + d] for k in range(size - d)) for d in range(1, q))
            if size >= max(least, times * q) and not smaller:
                out.append((s, size, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2**32), st.sampled_from([(24, 3), (4, 2), (6, 3), (9, 4)]))
def test_runs_equal_brute_force(seed, kind):
    rng = random.Random(seed)
    letters = rng.choice([1, 2, 2, 3, 5, 40])
    w = [rng.randrange(letters) for _ in range(rng.randrange(130))]
    for _ in range(rng.randrange(3)):
        if w:
            a, p = rng.randrange(len(w)), rng.randrange(1, 25)
            for i in range(a + p, min(len(w), a + p * rng.randrange(1, 6))):
                w[i] = w[i - p]
    assert [tuple(r) for r in runs_of(w, *kind).tolist()] == brute_runs(w, *kind)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=2, max_size=60), st.data())
def test_extension_is_the_longest_common_prefix(codes, data):
    a, b = data.draw(st.sampled_from([(i, j) for i in range(len(codes) + 1) for j in range(len(codes) + 1) if i != j]))
    want = 0
    while max(a, b) + want < len(codes) and codes[a + want] == codes[b + want]:
        want += 1
    tree = SuffixTree(np.array(codes))
    assert tree.extension(np.array([a]), np.array([b])).tolist() == [want]
    suffixes = sorted(range(len(codes) + 1), key=lambda i: codes[i:])
    assert tree.rank[suffixes].tolist() == list(range(len(codes) + 1))


def test_no_run_reaches_out_of_its_stretch():
    assert anchor(24, 3) == 9
    assert stretches(np.arange(1, 500), 24, 3) == []
    w = [f"w{i}" for i in range(300)]
    assert runs_of(w + ["a", "b"] * 12 + w[:40]).tolist() == [[300, 24, 2]]


def brute_digest(doc_id, text):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def test_runs_query_equals_brute_force(spark, tmp_path):
    rows = [r for r in odd_rows() if len(r[1] or "") < 5000]
    rows += [(1000 + i, prose(random.Random(i), 150), "en", "s", 1) for i in range(60)]
    got = op11_lyndon_runs(spark, stored(documents(spark, rows), tmp_path))
    assert plain(got) == sorted([brute_digest(r[0], r[1]) for r in rows], key=repr)
    assert got.filter("n_runs > 0").count() >= 5


def test_runs_keep_columns_and_empty_tables(spark, tmp_path):
    df = documents(spark).withColumn("runs", F.lit(1))
    found = with_runs(df)
    assert found.columns == [*documents(spark).columns, "runs", "collapsed"]
    assert found.count() == len(odd_rows())
    assert {r[0] for r in found.select(*CLASHING).distinct().collect()} == {"kept"}
    lines = found.filter("text like 'same line%'").first()
    assert [tuple(r) for r in lines["runs"]] == [(0, 100, 2)] and lines["collapsed"] == "same line"
    assert with_runs(empty(spark)).count() == 0
    assert op11_lyndon_runs(spark, stored(empty(spark), tmp_path)).count() == 0


# --- simhash


def brute_fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    k = min(3, len(w))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(len(w) - k + 1)] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(rows, prints, radius):
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r)
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(rows))]


def test_simhash_query_equals_brute_force(spark, tmp_path):
    rows = odd_rows() + [(500, "Ärger IST Ä Groß x", "de", "s", 1), (501, "Ärger ist Ä Groß x", "de", "s", 1)]
    prints = [brute_fingerprint(r[1]) for r in rows]
    classes = brute_classes([r[0] for r in rows], prints, 2)
    want = sorted([(r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, classes, strict=True)], key=repr)
    assert plain(op12_ball_hashing(spark, stored(documents(spark, rows), tmp_path))) == want


def clouds(seed, n=400):
    """Fingerprints in chains and dense balls, with the sign bit among those that differ."""
    rng, out = random.Random(seed), [0, 1 << 63]
    while len(out) < n:
        x = rng.choice(out) if rng.random() < 0.7 else rng.getrandbits(64)
        for b in rng.sample(range(64), rng.randrange(5)):
            x ^= 1 << b
        out.append(x)
    return out


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_classes_equal_all_pairs(spark, radius):
    prints = clouds(radius)
    rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
    hashed = store_once(spark.createDataFrame(rows, "doc_id long, fingerprint long"), "hashed")
    got = dict(near_classes(hashed, radius).select("doc_id", "component_id").collect())
    assert [got[i] for i in range(len(rows))] == brute_classes(list(range(len(rows))), prints, radius)


def test_links_grow_with_the_fingerprints_not_their_pairs(spark):
    """A family of 64 + 2016 fingerprints, all within four bits of each other."""
    family = spark.createDataFrame([(m,) for m in ball(2)], "fingerprint long")
    found = ball_links(family, 2)
    assert len(ball(2)) == 2081 and found.count() <= 65 * 2081
    assert found.filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) > 2).count() == 0


def test_simhash_keeps_columns_and_empty_tables(spark, tmp_path):
    found = with_fingerprint(documents(spark))
    assert found.columns == [c for c in documents(spark).columns if c != "text"] + ["fingerprint"]
    assert {r[0] for r in found.select(*CLASHING).distinct().collect()} == {"kept"}
    assert near_duplicates(documents(spark)).count() == len(odd_rows())
    assert op12_ball_hashing(spark, stored(empty(spark), tmp_path)).count() == 0


# --- filter audit


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text("ab", max_size=7), st.integers(0, 9)), max_size=50))
def test_trie_holds_the_least_id_of_every_text(rows):
    trie, lost = Trie(), []
    for text, doc_id in rows:
        lost += trie.insert(text.encode(), doc_id, "p", 0, 1)
    least = {}
    for text, doc_id in rows:
        least[text] = min(doc_id, least.get(text, doc_id))
    first = {text.decode(): (doc_id, n) for doc_id, _, _, n, text in trie.first_rows()}
    assert first == {t: (i, sum(1 for r in rows if r == (t, i))) for t, i in least.items()}
    assert sum(r[3] for r in lost) + sum(n for _, n in first.values()) == len(rows)
    assert all(mask & 16 for _, _, mask, _ in lost)


def brute_audit(rows, labels):
    texts, parts = [r[1] or "" for r in rows], [r[3] or "" for r in rows]
    fails = []
    for r, t in zip(rows, texts, strict=True):
        w = WORD.findall(t)
        smaller = any(r[0] is not None and o[0] is not None and o[0] < r[0] and u == t for o, u in zip(rows, texts, strict=True))
        told = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": smaller,
        }
        fails.append({f for f, x in told.items() if x})
    good, toxic = ({r[0] for r in labels if r[0] is not None and r[k] == 1} for k in (1, 2))
    out = []
    for part in set(parts):
        own = [(f, r[0] in good, r[0] in toxic) for f, r, p in zip(fails, rows, parts, strict=True) if p == part]
        share, told = dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                share[f] += len(gone)
                told.append((
                    part, "".join(order), step, len(left), len(gone), sum(f in x[0] for x in own) - len(gone),
                    sum(x[0] == {f} for x in own), sum(x[1] for x in gone), sum(x[2] for x in gone),
                ))
        out += [(*t, share[t[1][t[2] - 1]]) for t in told]
    return sorted(out)


def audited_rows():
    rng = random.Random(3)
    rows = odd_rows()
    base = prose(rng, 260)
    rows += [(300 - i, base, "en", f"s{i % 2}", 1) for i in range(30)] + [(280, base, "en", "other", 1)] * 3
    rows += [(400 + i, f"{base} {'Ab' * (i % 3)} {'#' * (i % 2)} ENDING{i % 4}", "en", "s1", 1) for i in range(20)]
    return rows


LABELS = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 420, 3)] + [(300, 1, 0), (300, 0, 1), (None, 1, 1), (3, None, None)]


@pytest.mark.parametrize("ranges, trie_bytes", [(Ranges(), 1 << 20), (Ranges(task_bytes=2000, first_prefix=2, growth=2), 500)])
def test_audit_equals_brute_force(spark, ranges, trie_bytes):
    rows = audited_rows()
    docs = documents(spark, rows).repartition(5)
    masks = store_once(failure_masks(docs, ranges=ranges, trie_bytes=trie_bytes), "failures")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = sorted(tuple(r) for r in audit(masks, labels).collect())
    assert got == brute_audit(rows, LABELS)
    assert masks.agg(F.sum("rows")).first()[0] == len(rows)


def test_a_hot_text_is_a_row_a_task(spark):
    """A text that most rows hold goes on once a task; the rest of its rows are decided where they lie."""
    from meshloom.llm.filter_audit import Conditions, within_tasks

    rows = [(i, "the same text", None, "s", 1) for i in range(900)]
    docs = documents(spark, rows, extra=False).repartition(6)
    sent = docs.select("doc_id", F.col("source").alias("part"), F.col("text").cast("binary").alias("text"))
    first = within_tasks(sent, Conditions(), 1 << 20)
    assert first.filter("text is not null").count() == 6
    assert first.agg(F.sum("rows")).first()[0] == 900


def test_audit_of_an_empty_table(spark, tmp_path):
    path = stored(empty(spark), tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    assert op13_radix_tries(spark, path).count() == 0
