import numpy as np
import pytest

from gatherlens.operators import metrics as M

PRED = [(0, 0), (0, 0), (0, 1), (1, 1), (1, 0), (1, 1), (1, 1), (2, 1), (2, 2), (2, 2)]


def f1_weighted(y_true, y_pred, weights_from):
    classes = sorted(set(y_true) | set(y_pred))
    f1s, ws = [], []
    for c in classes:
        tp = sum(1 for a, b in zip(y_true, y_pred) if a == c and b == c)
        pa = sum(1 for a in y_true if a == c)
        pp = sum(1 for b in y_pred if b == c)
        f1s.append(2 * tp / (pa + pp) if pa + pp else 0.0)
        ws.append(sum(1 for v in weights_from if v == c))
    return float(np.dot(f1s, ws) / sum(ws))


def test_confusion_f1_accuracy(spark):
    df = spark.createDataFrame(PRED, "label int, prediction int")
    conf = {(r.label, r.prediction): (r.n, r.pct) for r in M.confusion(df).collect()}
    assert conf[(1, 1)] == (3, pytest.approx(75.0))
    cells = df.groupBy("label", "prediction").count().withColumnRenamed("count", "n")
    y, p = [a for a, _ in PRED], [b for _, b in PRED]
    assert M.weighted_f1(cells).first().f1 == pytest.approx(f1_weighted(y, p, y))
    assert M.weighted_f1(cells, weight_by="prediction").first().f1 == pytest.approx(f1_weighted(y, p, p))
    assert M.accuracy(cells).first().acc == pytest.approx(0.7)
    s = M.evaluate(df).first()
    assert (s.f1, s.f1_by_prediction, s.acc) == pytest.approx(
        (f1_weighted(y, p, y), f1_weighted(y, p, p), 0.7))
    with pytest.raises(ValueError):
        M.weighted_f1(cells, weight_by="x")


def test_sweep_pivot_rank(spark):
    rows = [(t, m, a, b) for t in ("x", "y") for m in ("m1", "m2") for a, b in PRED]
    rows += [("x", "m2", 0, 0)] * 5
    df = spark.createDataFrame(rows, "task string, model string, label int, prediction int")
    sweep = M.evaluate(df, ["task", "model"])
    assert sweep.count() == 4
    piv = {r.task: (r.m1, r.m2) for r in M.metric_pivot(sweep, "task", "model", "acc", ["m1", "m2"]).collect()}
    assert piv["y"] == pytest.approx((0.7, 0.7)) and piv["x"][1] == pytest.approx(12 / 15)
    ranked = [(r.model, r.rank) for r in M.rank_models(sweep, {"task": "x"}, "acc").orderBy("rank").collect()]
    assert ranked == [("m2", 1), ("m1", 2)]


def test_confusion_has_zero_cells(spark):
    df = spark.createDataFrame([("m", 0, 0), ("m", 0, 1), ("m", 2, 2), (None, 1, 0)], "model string, label int, prediction int")
    got = {(r.model, r.label, r.prediction): (r.n, r.pct) for r in M.confusion(df, ["model"]).collect()}
    assert len(got) == 9 + 4
    assert got["m", 0, 1] == (1, 50.0) and got["m", 2, 0] == (0, 0.0) and got["m", 1, 1] == (0, None)
    assert got[None, 1, 0] == (1, 100.0) and got[None, 0, 0] == (0, None)
