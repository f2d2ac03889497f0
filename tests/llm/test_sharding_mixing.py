import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from fixtures import CLASHING, DOCUMENTS, documents, empty, odd_rows, plain
from pyspark.sql import functions as F

from meshloom.llm.common import prefix_sums
from meshloom.llm.mixing import mix, mixed_documents, op9_sainte_lague, with_targets
from meshloom.llm.sharding import op8_external_shuffle, shuffle_into_shards, write_shards


def test_prefix_sums_cross_block_bounds(spark):
    rows = [(i * 3, i + 1) for i in range(50)]
    out = prefix_sums(spark.createDataFrame(rows, "at long, n long"), "at", ["n"], block=10).collect()
    assert {r["at"]: r["n_before"] for r in out} == {at: sum(n for b, n in rows if b < at) for at, _ in rows}


def test_shards_hold_every_row_once_and_gaplessly(spark):
    df = documents(spark)
    out = shuffle_into_shards(df, shards=16, bucket_bytes=1 << 12)
    rows = out.collect()
    assert Counter(map(tuple, out.drop("shard", "slot").collect())) == Counter(
        map(tuple, df.drop("shard", "slot").collect())
    )
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) == set(range(16)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_shuffle_repeats_itself_and_follows_its_seed(spark):
    df = documents(spark, extra=False)
    first, again = (plain(shuffle_into_shards(df, bucket_bytes=1 << 12)) for _ in range(2))
    other = plain(shuffle_into_shards(df.repartition(5), bucket_bytes=1 << 12, seed=3))
    assert first == again != other


@pytest.mark.parametrize("partitions,adaptive", [(4, "true"), (7, "true"), (7, "false")])
def test_shuffle_agrees_with_itself_on_any_layout(spark, partitions, adaptive):
    docs = documents(spark, extra=False)
    first = plain(shuffle_into_shards(docs, bucket_bytes=1 << 12))
    names = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.enabled": adaptive}
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n, value in names.items():
            spark.conf.set(n, value)
        other = plain(shuffle_into_shards(docs.repartition(partitions, "text"), bucket_bytes=1 << 12))
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)
    assert first == other


def test_shards_of_no_rows(spark, tmp_path):
    assert shuffle_into_shards(empty(spark)).count() == 0
    write_shards(shuffle_into_shards(documents(spark, extra=False), shards=2), f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(odd_rows())


def test_shard_query_describes_its_rows(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    out = op8_external_shuffle(spark, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in out} == {
        i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in docs.items()
    }
    assert {r["law"] for r in out} == {"rows"} and {r["grown_shard"] for r in out} == {None}


def water_filling(sizes, weights, cap):
    """Shares by weight, the excess over a cap shared again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = sum(max(0.0, target[s] - cap * sizes[s]) for s in names)
        for s in names:
            if target[s] >= cap * sizes[s]:
                target[s] = cap * sizes[s]
                open_.discard(s)
    return target


def test_targets_equal_repeated_resharing(spark):
    sizes = {"a": 10, "b": 5000, "c": 900, "é": 3, "z": 0, None: 70, "B": 1}
    rows = [(s is None, s or "", n) for s, n in sizes.items()]
    out = with_targets(spark.createDataFrame(rows, "_null boolean, _source string, source_size long"), (5, 2, 1), 3.0)
    mine = {None if r["_null"] else r["_source"]: r["target"] for r in out.collect()}
    theirs = water_filling(sizes, (5, 2, 1), 3)
    assert all(math.isclose(mine[s], theirs[s], rel_tol=1e-9, abs_tol=1e-6) for s in sizes)


def test_quotas_are_sainte_lague(spark):
    rows = [(f"s{i % 4}", 1 + 37 * (i % 4) ** 3) for i in range(400)]
    df = spark.createDataFrame([(s, "w " * n) for s, n in rows], "source string, text string")
    out = mix(df, blocks=64, shards=4).groupBy("source").agg(
        F.max("target").alias("t"), F.sum("taken").alias("k"), F.max("source_size").alias("n")
    )
    found = {r["source"]: r for r in out.collect()}
    total = sum(n for _, n in rows)
    block = math.ceil(total / 64)
    seats = Counter()
    for _ in range(round(total / block)):
        free = [s for s in found if (seats[s] + 1) * block <= 3 * found[s]["n"]]
        seats[max(free, key=lambda s: (found[s]["t"] / (2 * seats[s] + 1), -ord(s[1])))] += 1
    assert {s: r["k"] for s, r in found.items()} == {s: seats[s] * block for s in found}


def test_small_sources_meet_their_targets_in_a_large_mix(spark):
    rows = [("large", 1 << 20)] * 4096 + [(f"s{i}", n) for i, n in enumerate([1, 90, 1_500, 5_999, 10_500, 40_000])]
    out = mix(spark.createDataFrame(rows, "source string, n long"), size="n").groupBy("source").agg(
        F.max("target").alias("target"), F.sum("taken").alias("taken"), F.sum("size").alias("size")
    )
    found = {r["source"]: r for r in out.collect()}
    targets = water_filling({s: r["size"] for s, r in found.items()}, (5, 2, 1), 3)
    assert all(abs(r["taken"] - targets[s]) <= max(1, 0.01 * targets["s0"]) for s, r in found.items())


def test_full_sources_leave_their_blocks_to_others(spark):
    rng = random.Random(8)
    for blocks, shards in ((9, 4), (60, 16), (500, 3)):
        rows = [(f"s{i:02}", rng.choice([3, 40, 41, 500, 9000])) for i in range(25)]
        out = mix(spark.createDataFrame(rows, "source string, n long"), cap=1.2, blocks=blocks, shards=shards, size="n")
        found = {r["source"]: r for r in out.collect()}
        block = math.ceil(sum(n for _, n in rows) / blocks)
        total, seats = math.floor(sum(n for _, n in rows) / block + 0.5), Counter()
        want = defaultdict(lambda: [0] * shards)
        for k in range(total):
            free = [s for s in sorted(found) if (seats[s] + 1) * block <= 1.2 * found[s]["source_size"]]
            if free:
                s = max(free, key=lambda s: found[s]["target"] / (2 * seats[s] + 1))
                seats[s] += 1
                want[s][k * shards // total] += block
        assert {s: r["shard_words"] for s, r in found.items()} == {s: want[s] for s in found}


def test_mix_takes_words_near_targets(spark):
    df = documents(spark)
    out = mix(df).collect()
    assert len(out) == len(odd_rows())
    by = defaultdict(lambda: [0, 0, 0.0])
    for r in out:
        assert 0 <= r["taken"] <= 3 * r["size"] and sum(r["shard_words"]) == r["taken"]
        by[r["source"]][0] += r["size"]
        by[r["source"]][1] += r["taken"]
        by[r["source"]][2] = r["target"]
    targets = water_filling({s: v[0] for s, v in by.items()}, (5, 2, 1), 3)
    for s, (_, taken, target) in by.items():
        assert math.isclose(target, targets[s], rel_tol=1e-9, abs_tol=1e-6) and abs(taken - target) <= 3
    assert all(r[c] == "kept" for r in out for c in CLASHING if c != "size")


def test_mix_agrees_with_itself_on_any_layout(spark):
    df = documents(spark, extra=False)
    assert plain(mix(df, blocks=100)) == plain(mix(df.repartition(7), blocks=100, bin_rows=4096))
    assert plain(mix(df.filter("text is null or text = ''")).select("taken")) == [(0,)] * 4
    assert mix(empty(spark)).count() == 0


def test_mixed_documents_repeat_rows(spark):
    df = documents(spark)
    taken = Counter()
    for r in mix(df.drop(*CLASHING)).collect():
        if r["size"]:
            taken[(r["doc_id"], r["text"])] += int(r["taken"] / r["size"] + 0.5)
    out = mixed_documents(df)
    assert out.columns == df.columns
    assert sum(taken.values()) > 0 and abs(out.count() - sum(taken.values())) <= 10


def test_mix_query_counts_words(spark):
    out = op9_sainte_lague(spark, "/root/testdata/sf0.001")
    assert out.columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, op9_sainte_lague(spark, "/root/testdata/sf0.001").collect()))
