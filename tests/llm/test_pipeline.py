import os
import random
from collections import Counter

import corpus_pipeline
import pytest
from fixtures import DOCUMENTS, documents, odd_rows, plain, prose
from test_pairs_and_packing import brute_groups

from meshloom.llm.quality import fit_quality, with_quality
from meshloom.session import shared_dir

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage was given and what it returned."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.store_once(stage(spark, docs, SF), "test")
        out.append((name, docs, after))
        docs = after
    return out


def test_stages_and_their_columns(kept):
    assert [name for name, *_ in kept] == [
        "quality classifier", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "best-fit packing",
    ]
    assert all(after.columns == before.columns for _, before, after in kept[:-1])


def test_quality_stage_drops_what_its_classifier_rejects(spark, kept):
    _, before, after = kept[0]
    model = fit_quality(before, spark.read.parquet(f"{SF}/labels.parquet"))
    scored = with_quality(before, model).collect()
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(r["doc_id"] for r in scored if r["score"] >= 0.7)
    assert before.count() > after.count() > 0.8 * before.count()


def test_line_stage_keeps_rows_and_counts_characters(kept):
    _, before, after = kept[1]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    assert after.count() == len(texts)
    for r in after.collect():
        if r["text"] != texts[r["doc_id"]]:
            assert r["n_chars"] == len(r["text"])
        assert Counter(r["text"].split("\n")) <= Counter(texts[r["doc_id"]].split("\n"))


@pytest.mark.parametrize("copies", [6, 60])
def test_near_copies_keep_the_lines_they_share(spark, copies):
    rng = random.Random(6)
    page = [prose(rng, 12) for _ in range(10)]
    menu = "Home | About | Contact"
    rows = [(i, f"{menu}\n{prose(rng, 60)}\n{prose(rng, 60)}", "en", "s", 1) for i in range(100)]
    rows.append((1000, "\n".join(page), "en", "s", 1))
    for i in range(copies):
        near = page.copy()
        near[i % 10] += f" edit{i}"
        rows.append((1001 + i, "\n".join(near), "en", "s", 1))
    out = corpus_pipeline.line_dedup(spark, documents(spark, rows, extra=False), SF).collect()
    texts = {r[0]: r[1] for r in rows}
    assert len(out) == len(rows)
    assert all(r["text"] == texts[r["doc_id"]].removeprefix(f"{menu}\n") for r in out)


def test_line_stage_moves_no_text_and_frees_its_tables(spark):
    """Only hashes of lines are shuffled, and lists that were read for the last time are gone."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    plan = corpus_pipeline.line_dedup(spark, docs, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before}
    assert "sets" in left and not left & {"prefixes", "entries", "live", "pairs"}


def test_join_stage_keeps_the_first_of_each_group(kept):
    _, before, after = kept[2]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    want = {i if not n else g for i, n, g in brute_groups(rows, 5, 4, 5)}
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(want)


def test_packing_stage_holds_every_document(kept):
    _, before, after = kept[4]
    assert Counter(r["doc_id"] for r in before.collect()) == Counter(r["doc_id"] for r in after.filter("start = 0").collect())


def test_run_equals_its_stages(spark, kept):
    assert plain(corpus_pipeline.run(spark, SF)) == plain(kept[-1][2])


def test_pipeline_of_odd_and_of_no_rows(spark, tmp_path):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, docs in (("odd", documents(spark, odd_rows(), extra=False)), ("none", spark.createDataFrame([], DOCUMENTS))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert (out.count() > 0) == (name == "odd")
