"""Percentiles, ranks, gates, splits, storage and streaming on small tables."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from meshloom.catalog import training_queries
from meshloom.config import DEFAULTS, LinearityGate, LoadScaling, Material, Scale, Splitting
from meshloom.functions import encode
from meshloom.functions.uniform import between, normalised, uniform
from meshloom.operators import batching, filters, linearity, normalize, percentiles, reports, resume, scaling
from meshloom.operators.percentiles import percentiles_by
from meshloom.operators.ranking import cut_in_ranges, ranged_rank, shuffle_rank
from meshloom.operators.slots import free_slots
from meshloom.plans import sample_plan, splits
from meshloom.session import scratch_path, store_once
from meshloom.sources import derived
from meshloom.sources import fields as field_store
from meshloom.sources import manifest as ms
from meshloom.sources import stats as stats_store
from meshloom.streaming import manifest_stream as stream

NAMED = {"p5": 0.05, "p50": 0.5, "p95": 0.95, "p0": 0.0, "p100": 1.0}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.one_of(st.floats(-1e6, 1e6), st.sampled_from([0.0, 1.0, -1.0])), min_size=1, max_size=300
    )
)
def test_percentiles_match_numpy(spark, values):
    df = spark.createDataFrame([(1, float(v)) for v in values] + [(2, 7.5)], "k int, v double")
    for rest in (1, 10_000):
        rows = {r["k"]: r for r in percentiles_by(df, ["k"], "v", NAMED, rest=rest).collect()}
        assert set(rows) == {1, 2} and rows[2]["p50"] == 7.5
        for name, p in NAMED.items():
            assert math.isclose(rows[1][name], np.percentile(values, 100 * p), rel_tol=1e-9, abs_tol=1e-9)


def test_large_group_selection_is_exact(spark):
    df = spark.range(400_000).select(
        F.lit(1).alias("k"), (F.exp(F.rand(7) * 30) - F.rand(8) * 5).alias("v")
    ).union(spark.range(200_000).select(F.lit(1), F.lit(3.25)))
    stored = df.checkpoint() if spark.sparkContext.getCheckpointDir() else df.cache()
    values = np.array([r["v"] for r in stored.collect()])
    row = percentiles_by(stored, ["k"], "v", NAMED, rest=1000).first()
    whole = percentiles_by(stored, [], "v", NAMED).first()
    for name, p in NAMED.items():
        want = np.percentile(values, 100 * p)
        assert math.isclose(row[name], want, rel_tol=1e-12)
        assert math.isclose(whole[name], want, rel_tol=1e-12)


def test_percentiles_of_odd_values_and_keys(spark):
    inf, nan = math.inf, math.nan
    rows = [(None, 1.0), (None, 3.0), (1, -0.0), (1, 0.0), (1, None), (2, None), (3, -inf), (3, 1e-320), (3, inf), (4, nan), (4, -1.7e308), (4, 1.7e308)]
    df = spark.createDataFrame(rows, "k int, v double")
    got = {r["k"]: (r["p0"], r["p50"], r["p100"]) for r in percentiles_by(df, ["k"], "v", NAMED, rest=1).collect()}
    assert got[None] == (1.0, 2.0, 3.0) and got[1] == (0.0, 0.0, 0.0) and got[3] == (-inf, 1e-320, inf)
    assert got[4][:2] == (-1.7e308, 1.7e308) and math.isnan(got[4][2]) and set(got) == {None, 1, 3, 4}
    none = percentiles_by(df.where("k = 2"), [], "v", NAMED).collect()
    assert [tuple(r) for r in none] == [(None,) * len(NAMED)]
    assert percentiles_by(df.where("k = 2"), ["k"], "v", NAMED).isEmpty()


def test_value_ranges_never_fall(spark):
    steps = [math.ldexp(1 + j / 64, e) for e in range(-1074, 1024, 7) for j in range(64)]
    values = sorted({*steps, *[-v for v in steps], 0.0, math.inf, -math.inf})
    ordered = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", percentiles.octave(F.col("v")).alias("o"))
    parts = [r["o"] for r in ordered.orderBy("i").collect()]
    assert parts == sorted(parts) and max(parts) - min(parts) < percentiles.RANGES


def test_a_single_key_is_dealt_over_all_tasks(spark):
    """Rows of the one range that holds the median of one key stay in as many tasks as they came from."""
    df = spark.range(40_000).select((1 + F.rand(5) / 100).alias("v"))
    rows = df.select(F.lit(1).alias("_k"), F.col("v").alias("_v"), F.lit(0.0).alias("_in"))
    part = percentiles.octave(F.col("_v"))
    wanted = percentiles._narrowed(rows, part, None, [0.5])
    assert wanted.count() == 2
    kept = percentiles._rows_within(rows, part, wanted, 2).withColumn("task", F.spark_partition_id())
    sizes = [r["count"] for r in kept.groupBy("task").count().collect()]
    assert sum(sizes) == 40_000 and len(sizes) >= 6 and max(sizes) < 15_000


def test_binned_rank_equals_a_plain_window(spark):
    df = spark.range(5000).select(
        "id", (F.col("id") % 3).alias("g"), F.md5(F.col("id").cast("string")).alias("h")
    )
    ranked = shuffle_rank(df, ["g"], "h", "id", "r", "n", bin_digits=2)
    w = Window.partitionBy("g")
    plain = df.withColumn("r2", F.row_number().over(w.orderBy("h", "id"))).withColumn(
        "n2", F.count("*").over(w)
    )
    both = ranked.join(plain.select("id", "r2", "n2"), "id")
    assert both.count() == 5000
    assert both.where("r <> r2 OR n <> n2").isEmpty()


def test_uniform_is_repeatable_and_in_range(spark):
    df = spark.range(20_000).select(uniform(42, "id", "a").alias("u"), uniform(42, "id", "b").alias("w"))
    row = df.agg(F.min("u"), F.max("u"), F.avg("u"), F.corr("u", "w")).first()
    assert 0 <= row[0] and row[1] < 1 and abs(row[2] - 0.5) < 0.02 and abs(row[3]) < 0.03


def test_vanishing_direction_becomes_the_x_axis(spark):
    row = spark.range(1).select(normalised(F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("d")).first()["d"]
    assert (row["x"], row["y"], row["z"]) == (1.0, 0.0, 0.0)


def test_buckets_are_half_open_and_fall_back_to_the_last(spark):
    df = spark.createDataFrame([(0.02,), (0.15,), (0.6,), (2.0,), (5.0,), (0.001,)], "v double")
    got = [r[0] for r in df.select(encode.scale_bucket(F.col("v"), Scale())).collect()]
    assert got == ["small", "medium", "large", "large", "large", "large"]
    with pytest.raises(ValueError):
        Scale(edges=(0.1, 0.2))


# --- scaling and gates ---------------------------------------------------------------


def base_row(spark, **changes):
    row = dict(
        base_sample_id="base_000001", geometry_family="plate_3d", characteristic_length=1.0,
        governing_thickness=0.02, ref_peak=100.0, ref_p95=100.0, ref_scale=100.0, ref_max_disp=1e-9,
    ) | changes
    kinds = "base_sample_id string, geometry_family string, characteristic_length double, " \
            "governing_thickness double, ref_peak double, ref_p95 double, ref_scale double, ref_max_disp double"
    return spark.createDataFrame([tuple(row.values())], kinds)


def variants_of(spark, cap=432e6, factors=(1.2, 2.0, 5.0), **changes):
    loads = LoadScaling(peak_stress_cap=cap, safety_factors=factors)
    out = scaling.load_variants(base_row(spark, **changes), loads, LinearityGate(), Material())
    return out.orderBy("target_safety_factor").collect()


def test_factors_fall_as_the_safety_factor_rises(spark):
    rows = variants_of(spark)
    factors = [r["scale_factor"] for r in rows]
    assert factors == sorted(factors, reverse=True) and len(set(factors)) == 3
    assert math.isclose(rows[0]["p95_von_mises"], 420e6 / 1.2)
    assert rows[0]["sample_id"] == "base_000001_sf1.2" and rows[0]["load_class"] == "SF_1.2"


def test_cap_rejects_with_its_reason(spark):
    rows = variants_of(spark, cap=1.0)
    assert all(r["rejection_code"] == "peak_cap" and "cap 1.0 Pa" in r["rejection_reason"] for r in rows)


def test_thin_plate_fails_on_thickness_not_length(spark):
    """Displacement of 4 % of the length but 200 % of the thickness must be flagged."""
    rows = variants_of(spark, factors=(1.2,), ref_max_disp=0.04 / (420e6 / 1.2 / 100.0))
    assert rows[0]["rejection_code"] == "delta_t" and rows[0]["linearity_gate_type"] == "both"
    assert rows[0]["rejection_reason"].startswith("Bending δ/t = 2.0000 > 0.5")


def test_first_failing_gate_decides_and_unknown_families_are_bulk(spark):
    factor = 420e6 / 1.2 / 100.0
    rows = variants_of(spark, factors=(1.2,), geometry_family="sphere", ref_max_disp=0.06 / factor)
    assert rows[0]["rejection_reason"].startswith("Default δ/L = 0.0600") and rows[0]["linearity_gate_type"] == "bulk"
    rows = variants_of(spark, factors=(1.2,), cap=1.0, ref_max_disp=1.0)
    assert rows[0]["rejection_code"] == "peak_cap"
    rows = variants_of(spark, factors=(1.2,), governing_thickness=None)
    assert rows[0]["linearity_gate_type"] == "bending" and rows[0]["linearity_gate_pass"]
    rows = variants_of(spark, factors=(1.2,), characteristic_length=0.0, geometry_family="l_bracket")
    assert rows[0]["linearity_gate_pass"]


def test_vanishing_reference_scales_to_zero(spark):
    assert all(r["scale_factor"] == 0 for r in variants_of(spark, ref_scale=1e-11))


# --- splits --------------------------------------------------------------------------


def mock_manifest(spark, bases=100):
    rng = random.Random(42)
    rows = []
    for i in range(bases):
        family, bucket = rng.choice(sample_plan.FAMILIES), rng.choice(["small", "medium", "large"])
        for sf in (1.2, 1.5, 2.0, 3.0, 5.0):
            ratio = rng.uniform(0.02, 0.3) if family == "l_bracket" else None
            rows.append((f"base_{i:06d}", f"base_{i:06d}_sf{sf}", family, bucket, ratio, i % 2 == 0))
    return spark.createDataFrame(
        rows,
        "base_sample_id string, sample_id string, geometry_family string, scale_bucket string, "
        "radius_ratio double, has_multihot_nodes boolean",
    )


def test_split_never_divides_a_base_and_fills_every_split(spark):
    out = splits.assign_splits(mock_manifest(spark), Splitting())
    splits.check_leakage(out)
    assert out.count() == 500
    assert {r[0] for r in out.select("split").distinct().collect()} == {"train", "val", "test"}
    large = out.where("scale_bucket = 'large'").select("base_sample_id", "split").distinct()
    assert large.where("split = 'test'").count() >= large.count() // 2
    first = splits.one_row_per_base(mock_manifest(spark))
    held = first.where("geometry_family = 'l_bracket' AND radius_ratio BETWEEN 0.1 AND 0.2")
    assert held.join(out, "base_sample_id").where("split <> 'test'").isEmpty()


def test_leakage_and_multihot_raise(spark):
    manifest = mock_manifest(spark, 4).withColumn("split", F.substring("sample_id", -1, 1))
    with pytest.raises(splits.SplitLeakage, match="base_000000"):
        splits.check_leakage(manifest)
    with pytest.raises(splits.TooFewMultihot):
        splits.check_multihot(manifest.where("false"), 1)
    splits.check_multihot(manifest, 10)
    legacy = manifest.drop("has_multihot_nodes").withColumns({"is_fixed": F.lit(1), "is_loaded": F.lit(1)})
    splits.check_multihot(legacy, 20)


def test_ranges_follow_counts_for_skewed_ids(spark):
    # One prefix of nine characters holds all but a few ids; a third of all rows are one split.
    ids = spark.range(12_000).select(
        F.when(F.col("id") % 500 == 0, F.format_string("zz_%d", "id"))
        .otherwise(F.concat(F.lit("base_000000"), F.col("id").cast("string"))).alias("sample_id"),
        F.when(F.col("id") % 3 == 0, "val").when(F.col("id") % 1000 == 1, "test").otherwise("train").alias("split"),
    )
    cut = cut_in_ranges(ids, ["split", "sample_id"], 500)
    sizes = [r["count"] for r in cut.groupBy("_range").count().collect()]
    assert len(sizes) > 20 and max(sizes) < 1000
    ranked = ranged_rank(ids, ["split"], ["sample_id"], "r", "n", 500)
    assert set(ranked.columns) == {"split", "sample_id", "n", "r"}
    plain = Window.partitionBy("split")
    wrong = ranked.withColumn("w", F.row_number().over(plain.orderBy("sample_id"))).withColumn(
        "m", F.count(F.lit(1)).over(plain)
    ).where("r <> w or n <> m")
    assert ranked.count() == 12_000 and wrong.isEmpty()
    assert ranged_rank(ids.limit(0), ["split"], ["sample_id"]).count() == 0


def test_batches_are_contiguous_and_offsets_accumulate(spark):
    samples = spark.range(100).select(
        F.format_string("base_%06d", "id").alias("sample_id"),
        F.when(F.col("id") < 70, "train").otherwise("val").alias("split"),
        (F.col("id") % 7 + 1).alias("node_count"),
    )
    one = batching.assign_batches(samples, 32, epoch=0)
    sizes = {(r[0], r[1]): r[2] for r in one.groupBy("split", "batch_id").count().collect()}
    assert sizes == {("train", 0): 32, ("train", 1): 32, ("train", 2): 6, ("val", 0): 30}
    val = [r["sample_id"] for r in one.where("split = 'val'").orderBy("position").collect()]
    assert val == sorted(val)
    rows = one.orderBy("split", "position").collect()
    for a, b in zip(rows, rows[1:]):
        if (a["split"], a["batch_id"]) == (b["split"], b["batch_id"]):
            assert b["node_offset"] == a["node_offset"] + a["node_count"]
    other = batching.assign_batches(samples, 32, epoch=1)
    assert one.join(other.select("sample_id", F.col("position").alias("p")), "sample_id").where(
        "split = 'train' AND position <> p").count() > 30


# --- plan ------------------------------------------------------------------------------


def test_free_slots_fill_gaps_first(spark):
    rng = random.Random(4)
    used = {0: {s for s in range(300) if rng.random() < 0.8}, 1: set(range(64)), 2: set(), 3: {5, 900}}
    wanted = {0: 100, 1: 3, 2: 130, 3: 0, 4: 1}
    rows = [(k, s) for k, held in used.items() for s in held for _ in range(2)] + [(9, 1), (1, -4)]
    out = free_slots(
        spark.createDataFrame(rows, "stream long, slot long"),
        spark.createDataFrame(list(wanted.items()), "stream long, n long"),
        "stream", "n", block=16,
    )
    want = [(k, s) for k, n in wanted.items() for s in [s for s in range(2000) if s not in used.get(k, ())][:n]]
    assert sorted(map(tuple, out.collect())) == want


def test_failed_ids_are_planned_again_with_their_draws(spark):
    nothing = mock_manifest(spark, 1).limit(0)
    first = sample_plan.stratum_plan(nothing, DEFAULTS.sampling, DEFAULTS.scale, 20, 30).toPandas()
    assert len(first) == 330
    failed = set(first.sort_values("base_sample_id")["base_sample_id"].iloc[5:300:9])
    done = spark.createDataFrame(first[~first["base_sample_id"].isin(failed)])
    again = sample_plan.stratum_plan(done, DEFAULTS.sampling, DEFAULTS.scale, 20, 0).toPandas()
    merged = again.merge(first, on="base_sample_id", suffixes=("", "_first"))
    assert len(merged) == len(again) > 0 and set(again["base_sample_id"]) <= failed
    for name in ("geometry_family", "scale_bucket", "characteristic_length", "mesh_size"):
        assert (merged[name] == merged[f"{name}_first"]).all()


def test_plan_fills_deficits_and_resumes_without_collisions(spark):
    manifest = mock_manifest(spark, 60)
    plan = sample_plan.stratum_plan(manifest, DEFAULTS.sampling, DEFAULTS.scale, 10, 25)
    done = manifest.select("base_sample_id", "geometry_family", "scale_bucket").distinct()
    both = done.unionByName(plan.select(*done.columns))
    counts = both.groupBy("geometry_family", "scale_bucket").count().collect()
    assert len(counts) == 15 and min(r["count"] for r in counts) >= 10
    assert plan.select("base_sample_id").distinct().count() == plan.count()
    assert plan.join(done, "base_sample_id").isEmpty()
    edges = dict(zip(("small", "medium", "large"), zip(Scale().edges, Scale().edges[1:])))
    for r in plan.collect():
        lo, hi = edges[r["scale_bucket"]]
        assert lo <= r["characteristic_length"] < hi
    assert resume.remaining(plan, plan.select("base_sample_id")).isEmpty()


def test_shape_parameters_stay_in_range(spark):
    df = spark.range(300).select(F.format_string("base_%06d", "id").alias("base_sample_id"))
    for family in sample_plan.FAMILIES:
        rows = df.select(sample_plan.shape_params(family, DEFAULTS).alias("p")).collect()
        for row in (r["p"] for r in rows):
            if family == "l_bracket":
                assert 0.02 <= row["radius_ratio"] <= 0.3
            if "holes" in row:
                assert len(row["holes"]) == row["hole_count"]
            if family == "elongated_bar":
                assert 8 <= row["aspect_ratio"] <= 15
            if family == "block_with_fillet":
                edges = row["fillet_edges"]
                assert len(set(edges)) == row["num_fillets"] and edges == sorted(edges) and max(edges) < 12
            if family == "block_with_holes":
                for hole in row["holes"]:
                    assert [hole[f"centre_{c}"] is None for c in "xyz"].index(True) == hole["axis"]


def test_a_leak_in_the_composition_raises(spark, monkeypatch):
    manifest = mock_manifest(spark, 6)
    torn = manifest.select("base_sample_id").distinct().select("base_sample_id", F.explode(F.array(F.lit("train"), F.lit("test"))).alias("split"))
    monkeypatch.setattr(splits, "base_splits", lambda *_: torn)
    with pytest.raises(splits.SplitLeakage, match="base_"):
        splits.assign_splits(manifest, DEFAULTS.splitting)


def test_no_valid_face_is_an_error_and_a_lone_face_is_multihot(spark):
    def plan(faces):
        df = spark.createDataFrame([("base_000001", faces)], "base_sample_id string, faces array<string>")
        return sample_plan.with_boundary_conditions(df, 42).first()

    row = plan(["hole_1", "z_max"])
    assert row["load_face"] == row["fixed_face"] == "z_max"
    with pytest.raises(Exception, match="no valid face"):
        plan(["hole_1"])


# --- reports, normalisation, storage, streaming ------------------------------------------


def test_null_strata_are_left_out_of_reports(spark):
    df = mock_manifest(spark, 10).withColumn("geometry_family", F.when(F.col("base_sample_id") != "base_000003", F.col("geometry_family")))
    table = {r["geometry_family"]: r["All"] for r in reports.stratum_crosstab(df).collect()}
    assert table["All"] == 45 and None not in table


def test_a_node_that_one_solve_lacks_is_a_failure(spark):
    columns = "sample_id long, node_id long, ux double, uy double, uz double, von_mises double"
    a = spark.createDataFrame([(1, 0, 3.0, 4.0, 0.0, 8.0), (1, 1, 1.0, 0.0, 0.0, 5.0), (2, 0, 1.0, 0.0, 0.0, 4.0), (2, 7, 1.0, 0.0, 0.0, 4.0)], columns)
    b = spark.createDataFrame([(1, 0, 3.0, 4.0, 0.0, 8.0), (2, 0, 1.0, 0.0, 0.0, 5.0), (2, 7, 1.0, 0.0, 0.0, 5.0), (3, 2, None, None, None, 1.0)], columns)
    pairs = linearity.pair_fields(a, b, ["sample_id", "node_id"])
    got = {r["sample_id"]: r for r in linearity.compare(pairs, ["sample_id"], 0.01).collect()}
    assert (got[1]["missing_nodes"], got[1]["max_von_mises_error"], got[1]["passed"]) == (1, 0.0, False)
    assert (got[2]["missing_nodes"], got[2]["worst_von_mises_node"], got[2]["passed"]) == (0, 0, False)
    assert (got[3]["missing_nodes"], got[3]["max_displacement_error"], got[3]["passed"]) == (1, None, False)


def test_merged_moments_equal_those_of_scaled_rows(spark):
    rng = random.Random(2)
    rows = [(i % 4, 1e9 + i % 7, None if i % 5 == 0 else rng.gauss(3, 2), *[rng.gauss(0, 1) for _ in range(8)]) for i in range(200)]
    fields = spark.createDataFrame(rows, "base long, " + ", ".join(f"{t} double" for t in normalize.TARGETS))
    factors = spark.createDataFrame([(0, 1.0), (0, 0.5), (1, 0.0), (2, 3.0), (9, 2.0), (3, None)], "base long, scale_factor double")
    got = normalize.variant_stats(fields, factors, "base").first()
    scaled = fields.join(factors, "base").select(*[(F.col(t) * F.col("scale_factor")).alias(t) for t in normalize.TARGETS])
    want = normalize.target_stats(scaled).first()
    assert got["n_nodes"] == want["n_nodes"] == 250
    assert all(math.isclose(got[c], want[c], rel_tol=1e-9, abs_tol=1e-12) for c in want.asDict())
    with pytest.raises(Exception, match="no rows to compute"):
        normalize.variant_stats(fields, factors.where("base = 9"), "base").collect()


def test_linearity_report_blocks_only_above_the_rate(spark):
    rows = [("a", i != 0, 0.01, 0.02) for i in range(20)] + [("b", i > 1, 0.03, 0.04) for i in range(20)]
    results = spark.createDataFrame(
        rows, "geometry_family string, passed boolean, max_displacement_error double, max_von_mises_error double"
    )
    report = linearity.report(results, 0.05)
    blocking = {r["geometry_family"]: r["blocking"] for r in report.collect()}
    assert blocking == {"a": False, "b": True, None: False}
    verdict = linearity.verdict(report).first()
    assert (verdict["total_checked"], verdict["total_failed"], verdict["all_passed"]) == (40, 3, False)


def test_pair_fields_lines_up_nodes(spark):
    columns = "sample_id long, node_id long, ux double, uy double, uz double, von_mises double"
    a = spark.createDataFrame([(1, 0, 3.0, 4.0, 0.0, 10.0), (1, 1, 1.0, 0.0, 0.0, 5.0)], columns)
    b = spark.createDataFrame([(1, 1, 1.0, 0.0, 0.0, 5.0), (1, 0, 3.0, 4.0, 0.0, 8.0)], columns)
    pairs = linearity.pair_fields(a, b, ["sample_id", "node_id"])
    row = linearity.compare(pairs, ["sample_id"], 0.01).first()
    assert row["max_displacement_error"] == 0 and math.isclose(row["max_von_mises_error"], 0.25) and not row["passed"]


def field_rows(spark, rows):
    names = ", ".join(f"{t} double" for t in normalize.TARGETS)
    return spark.createDataFrame(rows, names)


def test_stats_of_nothing_fail_and_constants_get_the_floor(spark):
    with pytest.raises(Exception, match="no rows"):
        normalize.target_stats(field_rows(spark, [])).collect()
    row = normalize.target_stats(field_rows(spark, [(1.0,) * 10, (1.0,) * 10])).first()
    assert row["std_ux"] == 1e-10 and row["mean_ux"] == 1.0


def test_given_stats_win_over_stored_ones(spark):
    given_ = normalize.target_stats(field_rows(spark, [(1.0,) * 10]))
    assert stats_store.cached_stats(spark, given_, "/nowhere", lambda: None) is given_


def test_absent_manifest_is_empty_and_null_reason_is_accepted(spark):
    empty = ms.read_manifest_or_empty(spark, scratch_path(spark, "absent"))
    assert empty.count() == 0 and resume.completed_ids(empty).count() == 0
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", "cap")], "sample_id string, rejection_reason string")
    assert [r[0] for r in filters.accepted(df).collect()] == ["a", "b"]
    assert resume.completed_ids(df).count() == 3
    assert filters.coherent(df) is df and filters.in_split(df, "train") is df


def test_stream_rerun_adds_only_new_files(spark):
    incoming, table, state = (scratch_path(spark, n) for n in ("in", "table", "state"))
    schema = "sample_id string, ts timestamp, ok boolean"

    def deliver(ids):
        rows = spark.createDataFrame([(i,) for i in ids], "sample_id string")
        rows.select("sample_id", F.lit("2024-01-05").cast("timestamp").alias("ts"), F.lit(True).alias("ok")).coalesce(
            1
        ).write.mode("append").parquet(incoming)

    def ingest():
        stream.ingest_manifest(spark, incoming, schema, table, state)
        return sorted(r[0] for r in stream.stored_rows(spark, table, schema).select("sample_id").collect())

    deliver(["a", "b", "b"])
    assert ingest() == ["a", "b"]
    assert ingest() == ["a", "b"]
    deliver(["b", "c"])
    assert ingest() == ["a", "b", "c"]


def test_stream_keeps_late_rows_and_ignores_later_repeats(spark):
    incoming, table, state = (scratch_path(spark, n) for n in ("in", "table", "state"))
    schema = "sample_id string, ts timestamp, ok boolean"
    days = [("a", "2024-01-02"), ("b", "2024-06-01"), ("c", "2024-01-05"), ("d", "2024-06-20"), ("a", "2024-06-25"), (None, None)]
    for key, day in days:
        rows = spark.createDataFrame([(key, day, True)], "sample_id string, day string, ok boolean")
        rows = rows.select("sample_id", F.col("day").cast("timestamp").alias("ts"), "ok")
        rows.coalesce(1).write.mode("append").parquet(incoming)
    stream.ingest_manifest(spark, incoming, schema, table, state, files_per_trigger=1)
    stored = stream.stored_rows(spark, table, schema)
    assert sorted((r["sample_id"] or "", str(r["ts"])[:10]) for r in stored.collect()) == [
        ("", "None"), ("a", "2024-01-02"), ("b", "2024-06-01"), ("c", "2024-01-05"), ("d", "2024-06-20")
    ]
    # A lost checkpoint delivers everything again, in folders of its own, and adds nothing but the row without a key.
    stream.ingest_manifest(spark, incoming, schema, table, scratch_path(spark, "state"))
    assert stream.stored_rows(spark, table, schema).where("sample_id is not null").count() == 4


def test_ingest_batches_read_no_stored_rows(spark, monkeypatch):
    """Twenty batches of new, late and repeated keys; the table isn't read, and a restart adds nothing."""
    incoming, table, state = (scratch_path(spark, n) for n in ("in", "table", "state"))
    schema = "sample_id string, ts timestamp, ok boolean"

    def deliver(n):
        rows = [(f"s{n}", f"2024-03-{n + 1:02d}"), (f"s{n}", f"2024-02-{n + 1:02d}"), (f"s{n // 2}", "2023-01-01"), (None, None)]
        df = spark.createDataFrame(rows, "sample_id string, day string").repartition(2)
        df = df.select("sample_id", F.col("day").cast("timestamp").alias("ts"), F.lit(True).alias("ok"))
        df.coalesce(1).write.mode("append").parquet(incoming)

    for n in range(20):
        deliver(n)
    stored_rows = stream.stored_rows
    monkeypatch.setattr(stream, "stored_rows", lambda *a: pytest.fail("a batch read the table"))
    for _ in range(2):
        stream.ingest_manifest(spark, incoming, schema, table, state, files_per_trigger=1)
    monkeypatch.undo()
    got = sorted((r["sample_id"] or "", str(r["ts"])[:10]) for r in stored_rows(spark, table, schema).collect())
    # The first batch holds its key three times, the earliest of 2023.
    want = [("s0", "2023-01-01")] + [(f"s{n}", f"2024-02-{n + 1:02d}") for n in range(1, 20)]
    assert got == sorted([("", "None")] * 20 + want)


@pytest.mark.parametrize("keys", [50_000, 40])
def test_rows_of_a_large_batch_are_sorted_a_few_times_only(monkeypatch, keys):
    """Hundreds of Arrow batches in a task: rows already kept aren't sorted again with each of them."""
    rng, rows = random.Random(3), 100_000
    events = [(rng.randrange(keys), rng.randrange(1000)) if i % 100 else (None, i) for i in range(rows)]
    monkeypatch.setattr(stream, "WINDOW_ROWS", 1000)
    sort, sorted_rows = stream.pc.sort_indices, []
    monkeypatch.setattr(stream.pc, "sort_indices", lambda t, *a, **k: (sorted_rows.append(len(t)), sort(t, *a, **k))[1])
    best = {}
    for k, t in events:
        if k is not None:
            best[k] = min(t, best.get(k, t))
    table = pa.table({"key": [e[0] for e in events], "ts": [e[1] for e in events]})
    for whole in (True, False):
        out = list(stream.earliest_rows("key", "ts", whole)(iter(table.to_batches(max_chunksize=200))))
        got = [(r["key"], r["ts"]) for b in out for r in b.to_pylist()]
        none, keyed = [t for k, t in got if k is None], [r for r in got if r[0] is not None]
        assert none == [e[1] for e in events if e[0] is None]
        if whole:
            assert sorted(keyed) == sorted(best.items())
        else:
            assert set(best.items()) <= set(keyed) <= set(events)
    assert sum(sorted_rows) <= 5 * rows


def test_running_totals_store_what_changed(spark):
    incoming, totals, state = (scratch_path(spark, n) for n in ("in", "totals", "state"))
    for part in (["a", "b"], ["b", "b"], ["c"]):
        spark.createDataFrame([(x,) for x in part], "event_type string").coalesce(1).write.mode("append").parquet(incoming)
    rows = stream.stream_rows(spark, incoming, "event_type string", 1)
    stream.run_running_totals(stream.stratum_fill(rows, ["event_type"], 4), totals, state)
    assert spark.read.parquet(totals).count() == 4
    last = stream.latest_totals(spark, totals, ["event_type"])
    assert sorted(map(tuple, last.collect())) == [("a", 1, 3), ("b", 3, 1), ("c", 1, 3)]


def test_csv_manifest_is_read_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("sample_id,base_sample_id,rejection_reason,scale_factor\ns1,b1,cap,0.5\n")
    (tmp_path / "b.csv").write_text("base_sample_id,sample_id\nb2,s2\nb3\n,\n")
    (tmp_path / "c.csv").write_text("scale_factor,sample_id,other\nabc,s4,x\n2.5,s5,x\n")
    rows = ms.read_manifest(spark, str(tmp_path), "csv").select("sample_id", "base_sample_id", "rejection_reason", "scale_factor")
    assert sorted(map(tuple, rows.collect())) == [
        ("s1", "b1", "cap", 0.5), ("s2", "b2", None, None), ("s5", None, None, 2.5)
    ]
    assert ms.bad_rows(spark, str(tmp_path)).count() == 3


def test_damaged_parquet_files_are_named(spark, tmp_path):
    path = f"{tmp_path}/manifest"
    ms.append_manifest(spark.createDataFrame([("s1",)], "sample_id string").coalesce(1), path)
    (tmp_path / "manifest" / "cut.parquet").write_text("not a parquet file")
    assert [r["sample_id"] for r in ms.read_manifest_or_empty(spark, path).collect()] == ["s1"]
    assert [r["path"].rsplit("/", 1)[1] for r in ms.damaged_files(spark, path).collect()] == ["cut.parquet"]


def test_numbers_are_printed_by_their_exact_value(spark):
    values = [0.25, 0.35, 0.05, 0.15, 9.95, 99.96, -0.25, -0.04, 0.0, 1.2, 0.00015, 412345678.25, 412345678.35, 412345678.75, 2.0**53, 1e22]
    df = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)
    rows = df.select("v", encode.one_decimal(F.col("v")).alias("one"), encode.fixed(F.col("v"), 4).alias("four")).collect()
    assert [(r["one"], r["four"]) for r in rows] == [("%.1f" % r["v"], "%.4f" % r["v"]) for r in rows]


def test_fields_are_stored_by_the_keys_that_place_them(spark, tmp_path):
    manifest = spark.createDataFrame(
        [(1, "a", "small", None), (1, "b", "large", None), (2, "c", "small", "cap")],
        "base_id long, sample_id string, scale_bucket string, rejection_reason string",
    )
    rows = spark.createDataFrame([(1, "a", 0.5), (1, "b", 1.5), (2, "c", 2.5)], "base_id long, sample_id string, ux double")
    field_store.write_sample_fields(rows, manifest, f"{tmp_path}/f", ["base_id", "sample_id"])
    stored = spark.read.parquet(f"{tmp_path}/f").select("sample_id", "ux", "scale_bucket")
    assert sorted(map(tuple, stored.collect())) == [("a", 0.5, "small"), ("b", 1.5, "large")]


def test_split_queries_store_only_what_they_read(spark, monkeypatch):
    stored = {}

    def store(df, name):
        stored[name] = df.columns
        return store_once(df, name)

    for module in (derived, normalize):
        monkeypatch.setattr(module, "store_once", store)
    assert training_queries.target_statistics(spark, "/root/testdata/sf0.001").count() == 1
    assert len(stored["variants"]) == 8
    # A row of moments a base with its factors, not a row a variant.
    assert "factors" in stored["moments"] and "scale_factor" not in stored["moments"]
