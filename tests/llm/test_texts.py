import hashlib
import random
import re
import textwrap
from collections import Counter

import duckdb
import pytest
from fixtures import CLASHING, documents, empty, odd_rows, plain, prose
from pyspark.sql import functions as F

from meshloom.llm.fingerprint import (
    containment,
    fingerprints_with_neighbours,
    likeness,
    merged,
    op3_scaled_sketch,
    with_sketch,
)
from meshloom.llm.langid import Settings, fit_languages, op7_ftrl_language, training_sample, with_language
from meshloom.llm.license_scan import TEMPLATES, Limits, Scanner, op2_license_blocks, scan_licenses
from meshloom.llm.line_dedup import OP4_SQL, drop_site_lines
from meshloom.llm.quality import Bounds, fit_quality, labelled_sample, op6_compression_quality, with_quality

SF = "/root/testdata/sf0.01"


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def test_neighbours_and_fingerprints_of_odd_rows(spark):
    rows = [r[:2] for r in odd_rows()]
    out = op3_like(documents(spark))
    assert len(out) == len(rows)
    by_text = {}
    for r in out:
        by_text.setdefault((r["doc_id"], r["n_chars"]), set()).add(r["fingerprint"])
    assert all(len(v) == 1 for k, v in by_text.items() if k[0] is not None)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)
    distinct = [(i, t or "") for i, t in rows if i is not None]
    distinct = sorted(distinct, key=lambda x: x[0])
    edited = {(r["doc_id"], r["edited_sha256"]) for r in out}
    for (i, t), (_, following) in zip(distinct, distinct[1:]):
        n = len(t)
        whole = t[: n - n // 4] + following[: n // 4]
        assert (i, hashlib.sha256(whole.encode()).hexdigest()) in edited
    assert op3_like(empty(spark)) == []


def op3_like(df):
    a, b, c = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return (
        fingerprints_with_neighbours(df)
        .select(
            "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.col("sketch").cast("string").alias("fingerprint"),
            likeness(a, b).alias("near_edited"), likeness(a, c).alias("near_next"),
        )
        .collect()
    )


def test_sketch_estimates_jaccard_and_merges(spark):
    rng = random.Random(3)
    base = prose(rng, 4000)
    part = " ".join(base.split()[:1000])
    short = prose(rng, 12)
    df = spark.createDataFrame([(base, part, short)], "a string, b string, s string")
    for c in "abs":
        df = with_sketch(df, c, f"_{c}")
    row = df.select(
        likeness(F.col("_a"), F.col("_b")), containment(F.col("_b"), F.col("_a")), containment(F.col("_a"), F.col("_b")),
        likeness(F.col("_s"), F.col("_a")), F.size("_s"), (merged(F.col("_a"), F.col("_b")) == F.col("_a")).cast("int"),
    ).first()
    assert abs(row[0] - 0.25) < 0.06 and row[1] == 1.0 and abs(row[2] - 0.25) < 0.06
    assert row[3] == 0 and row[4] == 8 and row[5] == 1


def test_fingerprint_query_is_near_the_truth(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    out = {r["doc_id"]: r for r in op3_scaled_sketch(spark, SF).collect()}
    off = []
    for k, (i, t) in enumerate(docs):
        following, n = docs[(k + 1) % len(docs)][1], len(t)
        edited = t[: n - n // 4] + following[: n // 4]
        assert out[i]["n_chars"] == n and out[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(t), shingles(edited)
        off.append(abs(out[i]["near_edited"] - len(a & b) / len(a | b)))
    assert sum(off) / len(off) < 0.05


def test_boilerplate_lines_equal_sql(spark):
    rows = odd_rows()
    rows += [(1000 + i, f"Home | About\nbody {i}\n  Home | About \n\nfooter", "en", "s7", 1) for i in range(30)]
    rows += [(2000 + i, f"null host menu\nbody {i}", "en", None, 1) for i in range(8)]
    docs = documents(spark, rows, extra=False)
    out = drop_site_lines(docs).select("doc_id", "source", "lines", "dropped", "text")
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64", "n_chars": "Int64"}))
    assert plain(out) == sorted(con.execute(OP4_SQL).fetchall(), key=repr)
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[1005] == "body 5\n" and texts[2003] == "body 3"


def test_line_dedup_keeps_columns_and_copies(spark):
    out = drop_site_lines(documents(spark))
    assert set(CLASHING) <= set(out.columns) and out.count() == len(odd_rows())
    base = {r["text"] for r in out.filter("lang = 'fr'").collect()}
    assert len(base) == 1 and base != {""}  # copies of a page don't make its lines boilerplate
    assert drop_site_lines(empty(spark)).count() == 0


def test_quality_on_held_out_rows(spark):
    rows = op6_compression_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    good, bad = [r for r in held if r["quality"] == 1], [r for r in held if r["quality"] == 0]
    assert sum(r["predicted"] for r in good) >= 0.93 * len(good)
    assert sum(r["predicted"] for r in bad) <= 0.5 * len(bad)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_containment_without_evidence_is_null(spark):
    long = [h << 20 for h in range(200)]
    rows = [([1 << 31, 3 << 30], long), ([], long), ([0, 1 << 31], long), ([5], long)]
    out = spark.createDataFrame(rows, "a array<long>, b array<long>").select(containment(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in out] == [None, 1.0, 1.0, 0.0]


def test_repeated_ids_count_once_in_samples(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 20), "en" if i % 2 else "de", "s0", 1) for i in range(200)]
    rows += [(1, f"copy {i % 7} of one id", "en" if i % 3 else "fr", "s0", 1) for i in range(150)]
    docs = documents(spark, rows)
    labels = spark.range(200).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    bounds = Bounds(dictionary_docs=15, calibration_docs=5)
    sample = labelled_sample(docs, labels, bounds).collect()
    assert len(sample) == 40
    settings = Settings(docs_per_language=30)
    parts = training_sample(docs, settings).collect()
    whole = Counter(r["lang"] for r in parts if r["part"] == 0)
    assert whole == {"en": 30, "de": 30} and len(parts) <= 60 * (1 + settings.cuttings)


def test_symbols_beyond_the_first_plane_are_no_letters(spark):
    docs = documents(spark, [(1, "\U0001F600 \U0001F680", "en", "s0", 3), (2, "\U00010400\U00010401", "en", "s0", 2)], extra=False)
    out = with_language(docs, fit_languages(documents(spark), Settings(docs_per_language=20)))
    assert dict(out.select("doc_id", "lang_pred").collect())[1] == "und"
    assert dict(out.select("doc_id", "lang_pred").collect())[2] != "und"


def test_quality_of_odd_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame(
        [(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (3, None, 0), (4, 0, 0), (4, 1, 1)], "doc_id long, quality int, toxic int"
    )
    model = fit_quality(docs, labels, Bounds(dictionary_docs=30, calibration_docs=30))
    out = with_quality(docs, model)
    rows = out.collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in rows if not r["text"]} == {model.prior}
    one_sided = fit_quality(docs, labels.filter("quality = 1"))
    assert {r["score"] for r in with_quality(docs, one_sided).collect()} == {1.0}
    nothing = fit_quality(empty(spark), labels.limit(0))
    assert {r["score"] for r in with_quality(docs, nothing).collect()} == {0.5}
    assert with_quality(empty(spark), model).count() == 0


def test_languages_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    held = [r for r in op7_ftrl_language(spark, SF).join(docs, "doc_id").collect() if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.98 * len(held)


def test_languages_of_odd_rows(spark):
    docs = documents(spark)
    model = fit_languages(docs, Settings(docs_per_language=20, epochs=2))
    assert (model.weights == 0).any()
    out = with_language(docs, model).collect()
    assert len(out) == len(odd_rows())
    for r in out:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert r["lang_pred"] in (model.languages if letters else {"und"}) and 0 <= r["score"] <= 1
    assert fit_languages(empty(spark)) is None
    assert {(r["lang_pred"], r["score"]) for r in with_language(docs, None).collect()} == {("und", 0.0)}
    assert with_language(empty(spark), model).count() == 0


@pytest.mark.parametrize("name", sorted(TEMPLATES))
def test_each_notice_is_found_in_prose(name):
    rng = random.Random(1)
    text = f"{prose(rng, 30)}.\n{TEMPLATES[name]}\n{prose(rng, 30)}."
    found = [x for x in Scanner(TEMPLATES, Limits()).scan(text)]
    assert [f[2] for f in found] == [name] and found[0][4] == 0


def test_altered_notices_and_clean_prose():
    scanner = Scanner(TEMPLATES, Limits())
    assert [f[2:3] + f[4:] for f in scanner.scan("Released under the famous MIT License.")] == [("MIT", 0, 1)]
    assert list(scanner.scan("She took out a licence for the dog.")) == []
    assert list(scanner.scan("")) == []


@pytest.mark.parametrize("name", ["MIT-text", "CC0-1.0", "Apache-2.0-header", "GPL-3.0-header", "Reserved"])
@pytest.mark.parametrize("width", [15, 40, 50, 72])
@pytest.mark.parametrize("prefix", ["", " * "])
def test_wrapped_notices_are_found_whole(name, width, prefix):
    rng = random.Random(4)
    body = textwrap.fill(TEMPLATES[name], width, initial_indent=prefix, subsequent_indent=prefix, break_on_hyphens=False, break_long_words=False)
    text = f"{prose(rng, 200)}.\n{body}\n{prose(rng, 200)}."
    assert [f[2:3] + f[4:] for f in Scanner(TEMPLATES, Limits()).scan(text)] == [(name, 0, 0)]


def test_adjacent_notices_are_all_found():
    scanner = Scanner(TEMPLATES, Limits())
    names = ["CC-BY-4.0", "MIT", "MIT", "Apache-2.0-header", "Reserved", "GPL-3.0", "MIT-text", "CC-BY-SA-4.0"]
    for joint in (" ", "\n"):
        text = joint.join(TEMPLATES[n] for n in names)
        found = list(scanner.scan(text))
        assert [f[2:3] + f[4:] for f in found] == [(n, 0, 0) for n in names]
        assert [text[f[0] : f[1]] for f in found] == [TEMPLATES[n] for n in names]


def test_a_notice_among_many_foreign_words_is_found():
    text = "Released under the famous and really quite good and new MIT License. All rights reserved."
    assert [f[2:3] + f[4:] for f in Scanner(TEMPLATES, Limits()).scan(text)] == [("MIT", 0, 7), ("Reserved", 0, 0)]


def test_license_scan_of_odd_rows(spark):
    rows = odd_rows() + [(5000, "Released under the MIT License.\n" + "filler words here. " * 20 + "All rights reserved.", "en", "s", 1)]
    out = scan_licenses(documents(spark, rows)).collect()
    assert sorted((r["doc_id"], r["license"]) for r in out) == [(5000, "MIT"), (5000, "Reserved")]
    assert scan_licenses(empty(spark)).count() == 0


def test_license_query_finds_every_planted_line(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = {(r["doc_id"], r["wording"]) for r in op2_license_blocks(spark, SF).collect()}
    planted = {(i, line) for i, t in texts.items() for line in t.split("\n") if line in TEMPLATES.values()}
    assert planted and planted <= found
