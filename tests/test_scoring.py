"""Fits against an exact Newton solution, AUC against all pairs, and audit properties."""

from __future__ import annotations

import random

import numpy as np
import pytest
from conftest import rows

from cutline.catalog import models
from cutline.operators.detector import contaminated
from cutline.operators.scoring import exact_auc, fit_models, model_aucs, scores
from cutline.plans.scenario import Rules
from cutline.plans.sweep import sweep
from cutline.plans.validate import compare_aucs, validate


def newton(features, label):
    """Penalised logistic optimum, intercept free, unit penalty on the sum loss."""
    x = np.column_stack((np.ones(len(label)), features))
    penalty = np.diag([0.0] + [1.0] * features.shape[1])
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        gradient = x.T @ (p - label) + penalty @ w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-13:
            break
    return w


def sample(n=400):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=n), rng.normal(5, 3, size=n)
    label = (a + 0.2 * b + rng.normal(size=n) > 1).astype(int)
    split = np.where(np.arange(n) < n * 0.7, "train", "test")
    return a, b, label, split


def test_coefficients_match_the_exact_optimum(spark):
    a, b, label, split = sample()
    data = [(i, float(a[i]), float(b[i]), 7.0, int(label[i]), str(split[i])) for i in range(len(a))]
    frame = spark.createDataFrame(data, "i int, a double, b double, c double, label int, split_name string")
    fits = fit_models(frame, {"ab": ["a", "b"], "abc": ["a", "b", "c"]})
    train = split == "train"
    x = np.column_stack((a, b))
    scaled = (x[train] - x[train].mean(axis=0)) / x[train].std(axis=0)
    exact = newton(scaled, label[train])
    assert np.allclose([fits["ab"].intercept, *fits["ab"].weights], exact, atol=1e-5)
    # A constant column is centred away and changes nothing.
    assert np.allclose(fits["abc"].weights[:2], fits["ab"].weights, atol=1e-5)
    test = (x[~train] - x[train].mean(axis=0)) / x[train].std(axis=0)
    scores = test @ exact[1:]
    assert model_aucs(frame, fits)["ab"] == pytest.approx(pairwise(label[~train], scores), abs=2e-6)


def pairwise(label, score):
    positive, negative = score[label == 1], score[label == 0]
    wins = (positive[:, None] > negative[None, :]) + 0.5 * (positive[:, None] == negative[None, :])
    return wins.mean()


@pytest.mark.parametrize("low,high", [(1, 2), (-1, 1)])
def test_any_two_labels_are_one_model(spark, low, high):
    a, b, label, split = sample()
    data = [(float(a[i]), float(b[i]), int(label[i]), str(split[i])) for i in range(len(a))]
    plain = spark.createDataFrame(data, "a double, b double, label int, split_name string")
    coded = plain.replace({0: low, 1: high}, subset=["label"])
    names = {"ab": ["a", "b"]}
    expected, found = fit_models(plain, names), fit_models(coded, names)
    assert np.allclose(found["ab"].weights, expected["ab"].weights, atol=1e-9)
    assert model_aucs(coded, found) == model_aucs(plain, expected)


@pytest.mark.parametrize("small", [True, False])
def test_auc_equals_all_pairs(spark, small):
    rng = random.Random(9)
    data = [("m", rng.randint(0, 1), float(rng.randint(0, 12))) for _ in range(300)]
    # Most of one model's scores are equal, and one model has a single class.
    data += [("hot", i % 2, 0.5 if i % 3 else 0.9 - i / 1000) for i in range(300)]
    data += [("one", 1, float(i)) for i in range(5)]
    frame = spark.createDataFrame(data, "model string, label int, score double").repartition(5)
    got = {r["model"]: r["auc"] for r in exact_auc(frame, small=small).collect()}
    for name in ("m", "hot"):
        label = np.array([y for n, y, _ in data if n == name])
        score = np.array([s for n, _, s in data if n == name])
        assert got[name] == pytest.approx(pairwise(label, score), abs=1e-12)
    assert got["one"] is None


@pytest.mark.parametrize(
    ("aucs", "collapsed", "retained"),
    [
        ((0.7, 1.0, 0.83), True, 0.433333),
        ((0.698288, 1.0, 0.83363), True, 0.44858),
        ((0.7, 1.0, 0.866), False, 0.553333),
        ((0.7, 0.74, 0.7), False, 0.0),
        ((0.7, 0.7, 0.9), False, 1.0),
        ((0.7, 0.6, 0.5), False, 1.0),
        ((0.5, 0.7, 0.6), True, 0.5),
    ],
)
def test_comparison(spark, aucs, collapsed, retained):
    frame = spark.createDataFrame(
        [("x", *aucs)], "name string, baseline double, observed double, point_in_time double"
    )
    row = compare_aucs(spark, frame, Rules(0, 0)).first()
    assert (row["collapsed"], row["advantage_retained"]) == (collapsed, pytest.approx(retained, abs=1e-6))


@pytest.fixture(scope="module")
def folder():
    return "/root/testdata/sf0.01"


def test_a_sweep_finds_the_leaks_only(spark, folder):
    ranked = sweep(models.customer_scenario(spark, folder)).collect()
    assert [r["feature"] for r in ranked if r["collapsed"]] == ["days_since_last", "partly_leaked"]
    by_name = {r["feature"]: r for r in ranked}
    assert by_name["strong_honest"]["advantage_lost"] < 0.01
    assert by_name["strong_honest"]["observed_auc"] > 0.9
    assert by_name["gappy"]["status"] == "could_not_evaluate" and "null" in by_name["gappy"]["reason"]
    assert ranked[-1]["feature"] == "gappy"
    assert by_name["days_since_last"]["excluded_post_cutoff_records"] > 0
    single = validate(models.customer_scenario(spark, folder, ("partly_leaked",)))
    assert single["leakage_case"]["observed_auc"] == by_name["partly_leaked"]["observed_auc"]
    assert single["leakage_case"]["point_in_time_auc"] == by_name["partly_leaked"]["point_in_time_auc"]


def test_the_benchmark_decays_with_reach_and_clears_guarded_queries(spark, folder):
    cases = models.benchmark_cases(spark, folder, seeds=(20260727,)).collect()
    assert len(cases) == 14
    leaked = sorted((r for r in cases if r["is_leaked"]), key=lambda r: -r["coverage"])
    deltas = [r["observed_auc"] - r["point_in_time_auc"] for r in leaked]
    assert deltas == sorted(deltas, reverse=True)
    assert leaked[0]["collapsed"] and not leaked[-1]["collapsed"]
    assert all(r["verdict"] == "confirmed" for r in leaked)
    clean = [r for r in cases if not r["is_leaked"]]
    assert {r["verdict"] for r in clean} == {"clear_for_release"}
    assert all(r["correct"] for r in cases)


def test_contamination_is_deterministic_and_grows(spark):
    from pyspark.sql import functions as F

    frame = spark.range(2000).select(F.col("id").cast("string").alias("k"))

    def hit(frame, coverage):
        value = contaminated(F.lit(0), F.lit(1), coverage, F.col("k"), 7)
        return rows(frame.select("k", value.alias("v")))

    assert hit(frame, 0.4) == hit(frame.repartition(7), 0.4)
    sets = [{k for k, v in hit(frame, c) if v} for c in (0.0, 0.02, 0.4, 1.0, 3.0)]
    assert sets[0] == set() and len(sets[3]) == len(sets[4]) == 2000
    assert sets[1] < sets[2] < sets[3]
    assert 700 < len(sets[2]) < 900


def jobs_of(spark, work):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("fits", "")
    try:
        before = len(tracker.getJobIdsForGroup("fits"))
        work()
        return len(tracker.getJobIdsForGroup("fits")) - before
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_jobs_do_not_grow_with_the_models(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 12))
    label = (x[:, 0] + rng.normal(size=300) > 0).astype(int)
    rows_ = [(*map(float, v), int(y), "train") for v, y in zip(x, label, strict=True)]
    frame = spark.createDataFrame(rows_, ", ".join(f"c{i} double" for i in range(12)) + ", label int, split_name string").cache()
    frame.count()
    one = jobs_of(spark, lambda: fit_models(frame, {"a": ["c0", "c1"]}))
    many = {f"m{i}": ["c0", f"c{i}"] for i in range(1, 12)} | {"wide": [f"c{i}" for i in range(12)], "none": []}
    assert jobs_of(spark, lambda: fit_models(frame, many)) <= one + 4
    fits = fit_models(frame, many)
    scaled = (x - x.mean(axis=0)) / x.std(axis=0)
    assert np.allclose([fits["wide"].intercept, *fits["wide"].weights], newton(scaled, label), atol=1e-8)
    assert np.allclose([fits["m7"].intercept, *fits["m7"].weights], newton(scaled[:, [0, 7]], label), atol=1e-8)


def test_separable_single_label_and_no_training_rows(spark):
    schema = "a double, label int, split_name string"
    apart = spark.createDataFrame([(float(i), int(i >= 50), "train") for i in range(100)] + [(1.0, 0, "test"), (90.0, 1, "test")], schema)
    fits = fit_models(apart, {"a": ["a"]})
    scaled = (np.arange(100) - 49.5) / np.arange(100).std()
    assert np.allclose([fits["a"].intercept, *fits["a"].weights], newton(scaled[:, None], (np.arange(100) >= 50).astype(int)), atol=1e-7)
    ones = apart.where("label = 1")
    assert {r["score"] for r in scores(ones, fit_models(ones, {"a": ["a"]})).collect()} == {1.0}
    with pytest.raises(ValueError, match="no training rows"):
        fit_models(apart.where("split_name = 'test'"), {"a": ["a"]})
