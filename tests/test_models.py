import random

from lattica.operators.models import fit_labels, out_of_fold, probabilities, select_features


def test_labels_folds_and_importances(spark):
    rng = random.Random(1)
    rows = [(k, a := rng.random(), rng.random() if k % 7 else None, int(a > 0.5), 0) for k in range(120)]
    df = spark.createDataFrame(rows, "id int, a double, b double, y int, never int")
    models = fit_labels(df, ["a", "b"], ["y", "never"], rounds=2, depth=2)
    assert set(models) == {"y"} and select_features(models, ["b", "a"][::-1], 1)[0][0] == "a"
    assert probabilities(models, df, "id").count() == 120
    held = {r.id: r.p for r in out_of_fold(df, "id", ["a", "b"], ["y"], folds=2, rounds=2, depth=2).collect()}
    assert len(held) == 120 and sum((p > 0.5) == (rows[k][1] > 0.5) for k, p in held.items()) > 105
