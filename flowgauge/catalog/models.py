"""Classifiers, search, retraining and encoder fitting."""

from pyspark.sql import functions as F

from ..functions.bounded import local_table, work_dir
from ..operators.classify import FittedClassifier, fit_classifier, grid_search, retrain_and_score
from ..operators.mlp import encode, fit_encoder, random_trials, sweep_encoder
from . import query
from .views import LATENT_SQL, flow_latent, latent, rounded

FOREST = {"n_estimators": 10, "max_depth": 6}
NETWORK = {"hidden_dims": [16], "epochs": 30}
METRICS = ("accuracy", "precision", "recall", "f1")


def _rows(spark, sf, side=None):
    rows = latent(spark, sf).select("row_id", "y", "side", F.col("z").alias("features"))
    return rows.filter(F.col("side") == side) if side else rows


def _scored(spark, sf, kind, params):
    model = fit_classifier(_rows(spark, sf, "train"), kind, params)
    return rounded(model.evaluate(_rows(spark, sf, "test")), *METRICS)


@query("n1_random_forest")
def n1(spark, sf):
    return _scored(spark, sf, "random_forest", FOREST)


@query("n1b_random_forest_flows")
def n1b(spark, sf):
    rows = flow_latent(spark, sf).select("y", "side", F.col("z").alias("features"))
    model = fit_classifier(rows.filter("side = 'train'"), "random_forest", FOREST)
    return rounded(model.evaluate(rows.filter("side = 'test'")), *METRICS)


@query("n2_kernel_machine")
def n2(spark, sf):
    return _scored(spark, sf, "svm", {"m": 64, "max_iter": 20})


@query("n3_feed_forward")
def n3(spark, sf):
    return _scored(spark, sf, "dnn", NETWORK)


@query("n4_probabilities_and_activations")
def n4(spark, sf):
    train, test = _rows(spark, sf, "train"), _rows(spark, sf, "test")
    model = fit_classifier(train, "dnn", NETWORK)
    both = model.predict_proba(model.predict(test))
    return model.activations(both).select(
        "row_id", "y", "pred", F.round(F.array_max("proba"), 6).alias("top"), F.size("activation").alias("width")
    )


@query("n5_grid_search")
def n5(spark, sf):
    _, table = grid_search(
        _rows(spark, sf, "train"), "random_forest", {"n_estimators": [5], "max_depth": [3, 6]}, folds=3
    )
    return table


@query("n6_stored_model")
def n6(spark, sf):
    path = work_dir(spark, "model")
    fit_classifier(_rows(spark, sf, "train"), "random_forest", FOREST).save(spark, path)
    return rounded(FittedClassifier.load(spark, path).evaluate(_rows(spark, sf, "test")), *METRICS)


# What must hold for every test row, whatever the fitted model.
_EVERY_TEST_ROW = LATENT_SQL + "SELECT row_id, 1 AS holds FROM latent WHERE side = 'test'"


@query("n4b_probabilities_hold", _EVERY_TEST_ROW)
def n4b(spark, sf):
    """Probabilities sum to 1 and the largest is that of the predicted class, on every test row."""
    model = fit_classifier(_rows(spark, sf, "train"), "random_forest", FOREST)
    both = model.predict_proba(model.predict(_rows(spark, sf, "test")))
    total = F.aggregate("proba", F.lit(0.0), lambda s, p: s + p)
    holds = (F.abs(total - 1) < 1e-9) & (F.get("proba", F.col("pred")) == F.array_max("proba"))
    return both.select("row_id", holds.cast("int").alias("holds"))


@query("n6b_stored_model_agrees", _EVERY_TEST_ROW)
def n6b(spark, sf):
    """A stored model predicts as it did before, on every test row."""
    path = work_dir(spark, "model")
    model = fit_classifier(_rows(spark, sf, "train"), "random_forest", FOREST)
    model.save(spark, path)
    again = FittedClassifier.load(spark, path).predict(model.predict(_rows(spark, sf, "test")), "again")
    return again.select("row_id", (F.col("pred") == F.col("again")).cast("int").alias("holds"))


@query("n1c_metrics_of_predictions", _EVERY_TEST_ROW)
def n1c(spark, sf):
    """The reported accuracy is the share of test rows predicted right; one row per test row says so."""
    model = fit_classifier(_rows(spark, sf, "train"), "random_forest", FOREST)
    test = _rows(spark, sf, "test")
    told = model.evaluate(test).first().accuracy
    right = model.predict(test).withColumn("right", (F.col("y") == F.col("pred")).cast("double"))
    mine = right.agg(F.avg("right")).first()[0]
    return test.select("row_id", F.lit(int(abs(told - mine) < 1e-12)).alias("holds"))


@query("n3b_rate_matters", _EVERY_TEST_ROW)
def n3b(spark, sf):
    """Two learning rates give two models: some probability of each test row differs."""
    train, test = _rows(spark, sf, "train"), _rows(spark, sf, "test")
    slow, fast = (fit_classifier(train, "dnn", {"hidden_dims": [8], "epochs": 5, "learning_rate": r}) for r in (1e-4, 0.5))
    both = fast.predict_proba(slow.predict_proba(test, "a"), "b")
    return both.select("row_id", F.exists(F.zip_with("a", "b", lambda x, y: F.abs(x - y) > 1e-9), lambda d: d)
                       .cast("int").alias("holds"))


@query("n7_retrain_and_score")
def n7(spark, sf):
    found = retrain_and_score(
        _rows(spark, sf, "train"), _rows(spark, sf, "val"), _rows(spark, sf, "test"),
        {"random_forest": FOREST, "dnn": NETWORK},
    )
    return rounded(found, *METRICS)


def _history(spark, rows):
    return local_table(
        spark, [(h["epoch"], h["reconstruction"], h["contrastive"], h["loss"]) for h in rows],
        "epoch int, reconstruction double, contrastive double, loss double",
    )


@query("n8_contrastive_encoder")
def n8(spark, sf):
    net, history = fit_encoder(_rows(spark, sf, "train"))
    last = history[-1]["loss"]
    return encode(_rows(spark, sf, "test"), net).select("row_id", "y", "z").withColumn("loss", F.lit(last))


@query("n9_plain_encoder")
def n9(spark, sf):
    _, history = fit_encoder(_rows(spark, sf, "train"), lam=0.0)
    return _history(spark, history)


@query("n10_encoder_sweep")
def n10(spark, sf):
    # four of the drawn trials, trained at the default epochs; all default k
    return sweep_encoder(_rows(spark, sf, "train"), random_trials(4), validation=_rows(spark, sf, "val"))
