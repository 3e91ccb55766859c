import json
from datetime import datetime

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tabloom.operators import margins
from tabloom.operators.margins import fit_svc, fit_svr
from tabloom.operators.models import fit_spark_model, model_parameters, top_importance
from tabloom.operators.score import check_compatibility, row_key, score
from tabloom.plans.training import predictions, retrain, train
from tabloom.sources.registry import list_models, load_metadata, load_model, registry_name, save_model


def vectors(spark, x, y):
    rows = [(Vectors.dense(a), float(b)) for a, b in zip(x, y)]
    return spark.createDataFrame(rows, ["features", "label"]).cache()


def linear_data(n=200, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, [1, 3, 0.5], (n, 3)) + [1, 0, 5]
    return x, x @ [2.0, -1.0, 0.3] + 4 + rng.normal(0, 0.7, n)


def penalised(x, y, l1, l2):
    """Coordinate descent for 1/(2n)·SSE + l1·|w| + l2/2·|w|² with a free intercept."""
    xc, yc = x - x.mean(axis=0), y - y.mean()
    w = np.zeros(x.shape[1])
    for _ in range(3000):
        for j in range(len(w)):
            r = yc - xc @ w + xc[:, j] * w[j]
            rho = xc[:, j] @ r / len(y)
            w[j] = np.sign(rho) * max(abs(rho) - l1, 0) / (xc[:, j] @ xc[:, j] / len(y) + l2)
    return w, y.mean() - x.mean(axis=0) @ w


@pytest.mark.parametrize(
    "name, params, l1, l2",
    [
        ("linear_regression", {}, 0, 0),
        ("ridge_regression", {"alpha": 50.0}, 0, 50.0 / 200),
        ("lasso_regression", {"alpha": 0.2}, 0.2, 0),
        ("elastic_net", {"alpha": 0.5, "l1_ratio": 0.7}, 0.35, 0.15),
    ],
)
def test_linear_models(spark, name, params, l1, l2):
    x, y = linear_data()
    fitted = fit_spark_model(vectors(spark, x, y), name, model_parameters(name, params), len(y), 0)
    w, b = penalised(x, y, l1, l2)
    got, intercept = fitted.linear_terms()
    np.testing.assert_allclose(got, w, atol=1e-5)
    assert intercept == pytest.approx(b, abs=1e-4)


def test_logistic_regression_is_stationary(spark):
    x, s = linear_data()
    y = (s > np.median(s)).astype(float)
    fitted = fit_spark_model(
        vectors(spark, x, y), "logistic_regression", model_parameters("logistic_regression", {"C": 0.5}), len(y), 2
    )
    w, b = fitted.model.coefficients.toArray(), fitted.model.intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    np.testing.assert_allclose(w + 0.5 * x.T @ (p - y), 0, atol=2e-2)


def svr_loss(x, y, w, b, c):
    return 0.5 * w @ w + c * np.maximum(0, np.abs(y - x @ w - b) - 0.1).sum()


def test_svr_reaches_the_minimum(spark):
    x, y = linear_data()
    y[::17] += 30  # outliers
    fitted = fit_svr(vectors(spark, x, y).repartition(3), C=1.0)
    ours = svr_loss(x, y, fitted.coefficients, fitted.intercept, 1.0)
    # Averaged subgradient steps from the found point and from zero must not do better.
    rng = np.random.default_rng(0)
    for _ in range(300):
        step = rng.normal(0, 0.02, 4)
        assert svr_loss(x, y, fitted.coefficients + step[:3], fitted.intercept + step[3], 1.0) > ours * (1 - 2e-4)
    best, w, b = np.inf, np.zeros(3), 0.0
    for t in range(1, 20_000):
        e = y - x @ w - b
        s = np.sign(e) * (np.abs(e) > 0.1)
        rate = 0.05 / np.sqrt(t) / len(y)
        w, b = w - rate * (w - x.T @ s), b + rate * s.sum()
        best = min(best, svr_loss(x, y, w, b, 1.0))
    assert ours <= best * 1.002


def test_svr_takes_the_flattest_line(spark):
    """Labels on a line of slope 3: the tube lets the slope fall, its gap says how far."""
    x = np.arange(5.0)[:, None]
    fitted = fit_svr(vectors(spark, x, 3 * x[:, 0]), C=1.0)
    assert fitted.gap <= 1e-5 and fitted.coefficients[0] == pytest.approx(2.95, abs=1e-3)
    assert fitted.objective == pytest.approx(0.5 * 2.95**2, rel=1e-4)


@pytest.mark.parametrize("task_numbers", [1_000_000, 0])
def test_pairs_of_classes(spark, monkeypatch, task_numbers):
    """Every pair's line reaches its gap, in one task and in rounds; votes decide."""
    monkeypatch.setattr(margins, "TASK_NUMBERS", task_numbers)
    rng = np.random.default_rng(4)
    centres = np.array([[0, 0, 1], [3, 0, 0], [0, 3, 0], [3, 3, 5]], float)
    y = rng.integers(0, 4, 300)
    x = centres[y] + rng.normal(0, 0.8, (300, 3))
    fitted = fit_svc(vectors(spark, x, y).repartition(3), C=0.5, classes=4)
    assert fitted.pairs == [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)] and fitted.gap <= 1e-5 and fitted.rounds < 200
    votes = np.zeros((300, 4))
    for (low, high), w in zip(fitted.pairs, fitted.weights):
        side = x @ w[:3] + w[3]
        votes[np.arange(300), np.where(side > 0, high, low)] += 1
        rows = (y == low) | (y == high)
        sign = np.where(y[rows] == high, 1, -1)

        def loss(v):
            return 0.5 * v[:3] @ v[:3] + 0.5 * np.maximum(0, 1 - sign * (x[rows] @ v[:3] + v[3])).sum()

        for _ in range(200):
            assert loss(w + rng.normal(0, 0.02, 4)) > loss(w) * (1 - 1e-5)
    got = [r["prediction"] for r in fitted.predict(vectors(spark, x, y)).collect()]
    assert got == votes.argmax(axis=1).tolist() and np.mean(got == y) > 0.85
    lone = fit_svc(vectors(spark, x[y == 2], y[y == 2]), classes=4)
    assert {r["prediction"] for r in lone.predict(vectors(spark, x[:5], y[:5])).collect()} == {2.0}


def test_parameters():
    assert model_parameters("knn", {})["n_neighbors"] == 5
    assert model_parameters("random_forest", {"max_depth": None})["n_estimators"] == 100
    for name, bad in [
        ("nope", {}),
        ("knn", {"C": 1}),
        ("knn", {"weights": "odd"}),
        ("knn", {"n_neighbors": 0}),
        ("elastic_net", {"l1_ratio": 2}),
        ("svm", {"kernel": "rbf"}),
    ]:
        with pytest.raises(ValueError):
            model_parameters(name, bad)
    with pytest.raises(ValueError):
        model_parameters("ridge_regression", {"alpha": 3.0}, strict=True)


def people(spark, n=240):
    return spark.range(n).select(
        "id",
        F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise((F.col("id") % 7).cast("double")).alias(" size "),
        F.concat(F.lit("c"), F.col("id") % 4).alias("colour"),
        (F.col("id") % 2 == 0).alias("flag"),
        F.concat(F.lit("k"), F.col("id") % 3).alias("kind"),
        (F.col("id") % 7 * 3.0 + F.col("id") % 4).alias("price"),
    )


PREDICTORS = ["size", "colour", "flag"]


@pytest.mark.parametrize(
    "name, target, params",
    [
        ("decision_tree", "kind", {"max_depth": 4}),
        ("random_forest", "kind", {"n_estimators": 5, "max_depth": 3}),
        ("logistic_regression", "kind", {}),
        ("svm", "kind", {}),
        ("svm", "flag_text", {}),
        ("knn", "kind", {"n_neighbors": 3, "weights": "distance"}),
        ("naive_bayes", "kind", {}),
        ("ridge_regression", "price", {}),
        ("decision_tree_regressor", "price", {"max_depth": 4}),
        ("svr", "price", {}),
        ("knn_regressor", "price", {}),
    ],
)
def test_store_load_and_score(spark, tmp_path, name, target, params):
    data = people(spark).withColumn("flag_text", F.col("flag").cast("string"))
    trained = train(data, target, PREDICTORS, name, ["id"], **params)
    saved = save_model(spark, str(tmp_path), trained, "m", datetime(2024, 1, 2))
    fitted, preparation, meta = load_model(spark, str(tmp_path), saved)
    assert meta["feature_columns"] == PREDICTORS and json.loads(meta["model_params"]) == trained.params
    new = people(spark, 30).drop("kind", "price")
    before = score(new, trained.fitted, trained.preparation, ["id"])
    after = score(new, fitted, preparation, ["id"])
    assert sorted(map(str, before.collect())) == sorted(map(str, after.collect()))
    assert after.count() == 30 and after.columns[:4] == ["id", "size", "colour", "flag"]
    assert predictions(trained).count() == trained.metrics["test_size"] == 48
    assert check_compatibility(new, preparation).first()["compatible"]
    if target == "kind" and name != "svm":
        assert [c for c in after.columns if c.startswith("Prob_")] == ["Prob_k0", "Prob_k1", "Prob_k2"]


def test_registry_names_and_listing(spark, tmp_path):
    now = datetime(2024, 1, 2, 3, 4, 5)
    assert registry_name(" mi modelo/ñ-1! ", "knn", "classification", now) == "mimodeloñ-1"
    assert registry_name("!!", "knn", "classification", now) == "knn_classification_20240102_030405"
    assert list_models(spark, str(tmp_path / "none")).isEmpty()
    trained = train(people(spark), "price", PREDICTORS, "linear_regression", ["id"])
    save_model(spark, str(tmp_path), trained, "m", datetime(2023, 1, 1))
    assert save_model(spark, str(tmp_path), trained, "m", now) == "m_20240102_030405"
    listed = list_models(spark, str(tmp_path)).collect()
    assert [r["model_name"] for r in listed] == ["m_20240102_030405", "m"]
    # A name that another writer has claimed but not yet filled is taken as well.
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "claim").touch()
    assert save_model(spark, str(tmp_path), trained, "n", now) == "n_20240102_030405"
    assert save_model(spark, str(tmp_path), trained, "n", now) == "n_20240102_030405_2"
    assert listed[0]["created_at_formatted"] == "02/01/2024 03:04"


def test_retrain_keeps_parameters(spark, tmp_path):
    trained = train(people(spark), "price", PREDICTORS, "ridge_regression", ["id"], alpha=7.0)
    name = save_model(spark, str(tmp_path), trained, "m", datetime(2024, 1, 2))
    records = spark.createDataFrame([("12.5", "3", "c1", None), ("bad", "4", "c2", None)], "price string, size string, colour string, flag boolean")
    again = retrain(people(spark).toDF("id", "size", "colour", "flag", "kind", "price"), records, load_metadata(spark, str(tmp_path), name))
    assert again.params["alpha"] == 7.0
    assert again.lineage == {"retrained_from": "m", "original_records": 240, "new_records_added": 2, "total_records": 242}
    # The record whose price does not convert has no target.
    assert again.metrics["train_size"] + again.metrics["test_size"] == 241


def test_top_importance(spark):
    df = spark.createDataFrame([(0, "a", 0.1), (1, "b", -3.0), (2, "c", 2.0)], "position int, feature string, importance double")
    assert [r["feature"] for r in top_importance(df, 2).collect()] == ["b", "c"]


@pytest.mark.parametrize("model, name, value", [("logistic_regression", "solver", "liblinear")])
def test_parameters_without_effect_are_refused(model, name, value):
    with pytest.raises(ValueError, match=name):
        model_parameters(model, {name: value})


def test_metrics_are_measured_when_asked(spark):
    df = spark.range(200).select("id", (F.col("id") % 7).alias("x"), (F.col("id") * 1.5).alias("y"))
    trained = train(df, "y", ["x"], "linear_regression", ["id"])
    assert "metrics" not in vars(trained)
    first = trained.metrics
    assert first["train_size"] + first["test_size"] == 200 and trained.metrics is first
    trained.close()
    assert predictions(trained).count() == first["test_size"]


def test_joined_keys_stay_apart(spark):
    rows = [("a|b", "c"), ("a", "b|c"), ("a\\", "b|c"), ("a\\|b", "c"), (None, "x"), ("\\N", "x"), ("", "x")]
    df = spark.createDataFrame(rows, "p string, q string")
    assert row_key(df, ["p", "q"]).select("__id").distinct().count() == len(rows)


def test_rounds_read_blocks_of_rows(spark):
    rows = [(Vectors.dense([float(k % 7), float(k % 11)]), float(k)) for k in range(4_000)]
    train = spark.createDataFrame(rows, ["features", "label"]).repartition(2)
    blocks, _, width, _, _ = margins._prepared(train, labelled=True)
    held = blocks.collect()
    blocks.unpersist()
    assert width == 2 and len(held) <= 4
    x = np.vstack([np.frombuffer(r["x"]).reshape(-1, 3) for r in held])
    y = np.concatenate([np.frombuffer(r["y"]) for r in held])
    assert sorted(zip(*x.T.tolist(), y.tolist())) == sorted((*v.tolist(), 1.0, t) for v, t in ((r[0].toArray(), r[1]) for r in rows))
    assert sorted(v for r in held for v in r["labels"]) == sorted(y.tolist())
