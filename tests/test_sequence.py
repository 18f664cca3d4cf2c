"""The recurrent scorer: gradients against slopes, sums over partitions, learning, the trained detector, bundles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from elsetspark import registry
from elsetspark.operators import features, sequence
from elsetspark.operators.sequence import Network, Training
from elsetspark.plans import adapters, partition_queries

DAY, START = 86_400_000_000, 1_704_067_200_000_000
SMALL = Network(n_channels=3, hidden_size=4, num_layers=2, dropout=0.0)
ROW = "norad_id long, window_id long, position array<int>, idx array<long>, valid array<boolean>, target array<double>, x array<float>"


@pytest.mark.parametrize("gamma", [0.0, 1.5])
def test_gradient_equals_slopes(gamma):
    """Backpropagation through time and layers against central differences of the masked loss."""
    rng, how = np.random.default_rng(3), Training(positive_weight=3.0, focal_gamma=gamma)
    weights = SMALL.start(1)
    x, target, valid = rng.normal(size=(5, 7, 3)), (rng.random((5, 7)) < 0.3).astype(float), rng.random((5, 7)) < 0.8

    def loss():
        return float((sequence.token_loss(sequence.forward(x, weights, SMALL)[0], target, how)[0] * valid).sum())

    logits, held = sequence.forward(x, weights, SMALL)
    got = sequence.backward(sequence.token_loss(logits, target, how)[1] * valid, held, weights, SMALL)
    for name, w in weights.items():
        for at in {tuple(rng.integers(0, s) for s in w.shape) for _ in range(6)}:
            keep = w[at]
            w[at] = keep + 1e-5
            more = loss()
            w[at] = keep - 1e-5
            less = loss()
            w[at] = keep
            assert got[name][at] == pytest.approx((more - less) / 2e-5, rel=1e-5, abs=1e-7), name


def test_dropout_keeps_its_draw_and_its_mean():
    net = Network(n_channels=3, hidden_size=4, num_layers=2, dropout=0.5)
    x, weights = np.random.default_rng(0).normal(size=(4, 6, 3)), net.start(0)
    first, again, other = (sequence.forward(x, weights, net, np.random.default_rng(s))[0] for s in (1, 1, 2))
    assert (first == again).all() and (first != other).any() and (sequence.forward(x, weights, net)[0] == sequence.forward(x, weights, net)[0]).all()


def made(rng, n, length=8):
    """Windows where a token is a manoeuvre if the first channel jumps up from the token before: no token alone tells."""
    rows = []
    for k in range(n):
        size = length - k % 3
        level = np.cumsum(rng.random(size) < 0.25) % 2
        x = rng.normal(scale=0.1, size=(size, 3))
        x[:, 0] += level
        up = np.concatenate([[0], np.diff(level) > 0]).astype(float)
        rows.append((k, 0, list(range(size)), list(range(size)), [bool(v) for v in rng.random(size) < 0.95], up.tolist(), [float(v) for v in x.ravel()]))
    return rows


def test_sums_over_partitions_equal_one_task(spark):
    rows = spark.createDataFrame(made(np.random.default_rng(1), 300), ROW)
    weights, how = SMALL.start(2), Training(positive_weight=2.0)
    x, valid, target = sequence._dense(rows.toPandas(), 8)
    logits, held = sequence.forward(x, weights, SMALL)
    loss, slope = sequence.token_loss(logits, target, how)
    want = sequence.packed(sequence.backward(slope * valid, held, weights, SMALL))
    for n in (1, 7, 40):
        got = sequence.sums(rows.repartition(n), weights, SMALL, how, 0, 8)
        assert got[0] == pytest.approx((loss * valid).sum()) and got[1] == valid.sum() and np.allclose(got[2], want)
    none = sequence.sums(rows.where("norad_id < 0"), weights, SMALL, how, 0, 8)
    assert none[:2] == (0.0, 0.0) and not none[2].any()
    quiet = rows.withColumn("valid", F.transform("valid", lambda _: F.lit(False)))
    assert not sequence.sums(quiet, weights, SMALL, how, 0, 8)[2].any()


def test_learns_what_no_token_alone_tells(spark):
    rows, other = (spark.createDataFrame(made(np.random.default_rng(s), 240), ROW) for s in (4, 5))
    net = Network(n_channels=3, hidden_size=8, num_layers=1, dropout=0.0)
    weights, history = sequence.train(rows.coalesce(2), net, Training(rate=0.2, positive_weight=2.0, epochs=12, batches=2, cosine=True, warm_up=0.1), other.coalesce(2), 8)
    assert len(history) == 12 and history[-1]["held_out"] < 0.3 * history[0]["held_out"]
    x, valid, target = sequence._dense(other.toPandas(), 8)
    p = sequence.sigmoid(sequence.forward(x, weights, net)[0])
    assert ((p > 0.5) == (target > 0))[valid].mean() > 0.95


def test_schedule_and_optimiser():
    how = Training(cosine=True, warm_up=0.5)
    assert [round(how.scale(k, 4), 3) for k in range(4)] == [0.333, 0.667, 1.0, 0.5] and Training().scale(3, 4) == 1.0
    assert how.scale(0, 1) == 1.0
    flat, gradient = np.array([1.0, -2.0]), np.array([0.5, 0.0])
    assert sequence.Adam(2, Training(rate=0.1)).moved(flat, gradient, 1.0) == pytest.approx([0.9, -2.0])
    assert sequence.Adam(2, Training(rate=0.1, weight_decay=0.1, decoupled=True)).moved(flat, gradient, 1.0) == pytest.approx([0.89, -1.98])
    assert sequence.Adam(2, Training(rate=0.1, weight_decay=0.1)).moved(flat, gradient, 1.0) == pytest.approx([0.9, -1.9])
    for wrong in ({"rate": 0.0}, {"positive_weight": 0.0}, {"weight_decay": -1.0}, {"warm_up": 1.0}, {"focal_gamma": -1.0}, {"epochs": 0}):
        with pytest.raises(ValueError, match="out of range"):
            Training(**wrong)
    with pytest.raises(ValueError, match="at least 1"):
        Network(num_layers=0)


def test_query_of_the_network_equals_plain_numpy(spark):
    """Every token of events: windows cut, padded, scored and averaged in one process."""
    sf = "/root/testdata/sf0.001"
    encoded = features.channels(adapters.series_ev(spark, sf))
    table = features.standardise(encoded, features.class_quartiles(encoded)).toPandas().sort_values(["norad_id", "idx"])
    net, weights, want = partition_queries.NETWORK, partition_queries.NETWORK.start(7), {}
    for norad, rows in table.groupby("norad_id"):
        x, valid = rows[list(features.CHANNELS)].to_numpy(dtype=float), rows["elset_valid"].to_numpy() > 0
        for start in range(0, len(x), 32):
            own = np.zeros((1, 64, x.shape[1]))
            part = x[start : start + 64]
            own[0, : len(part)] = part
            p = sequence.sigmoid(sequence.forward(own, weights, net)[0])[0]
            for k in range(len(part)):
                want.setdefault((norad, start + k), []).append(p[k] if valid[start + k] else 0.0)
    got = {(r["norad_id"], r["idx"]): r["p"] for r in partition_queries.net_bilstm(spark, sf).collect()}
    assert got.keys() == want.keys() and len(got) == adapters.series_ev(spark, sf).count()
    assert max(abs(got[k] - np.mean(v)) for k, v in want.items()) < 1e-5


def test_detector_from_training_to_bundle(spark, tmp_path):
    """Raised orbits at known days: the detector learned on some objects finds those of others, and is the same after a round trip."""
    rng = np.random.default_rng(8)
    rows, gaps = [], []
    for i in range(12):
        up = sorted({int(d) for d in rng.integers(12, 78, 2)})
        for d in range(90):
            rows.append((i, START + d * DAY, 6978.0 + 2.0 * sum(d >= u for u in up) + float(rng.normal(scale=0.005)), 0.001 + float(rng.normal(scale=1e-6)), 66.0 + float(rng.normal(scale=1e-4)), float(5 * d % 360), 90.0))
        gaps += [(i, START + u * DAY) for u in up]
    series = spark.createDataFrame(rows, "norad_id long, t long, a double, e double, inc double, raan double, argp double").coalesce(2)
    intervals = spark.createDataFrame(gaps, "norad_id long, t1 long")
    membership = spark.createDataFrame([(i, "train" if i < 8 else "val" if i < 10 else "test") for i in range(12)], "norad_id long, split string")
    how = Training(rate=0.1, positive_weight=10.0, epochs=20, batches=1)
    bundle = sequence.fit_detector(series, intervals, membership, Network(hidden_size=8, num_layers=1, dropout=0.0), how)
    own = features.class_quartiles(features.channels(series.where("norad_id < 8")))
    assert bundle.scaler == features.scaler_document(own)  # of the train split alone
    assert len(bundle.training["history"]) == 20
    bundle.save(f"{tmp_path}/bundle")
    back = sequence.Bundle.load(f"{tmp_path}/bundle")
    found = [sorted((r["norad_id"], r["t_after"]) for r in b.detect(series.where("norad_id >= 10")).collect()) for b in (bundle, back)]
    wanted = {(i, t) for i, t in gaps if i >= 10}
    assert found[0] == found[1] and len(wanted & set(found[0])) >= 0.75 * len(wanted) and len(found[0]) <= len(wanted) + 3
    with pytest.raises(RuntimeError, match="needs a trained scorer"):
        registry.detect(series, "bilstm-base")
    waiting = dict(registry._DETECTORS)
    try:
        registry.register_bundle("bilstm-base", f"{tmp_path}/bundle")
        assert sorted((r["norad_id"], r["t_after"]) for r in registry.detect(series.where("norad_id >= 10"), "bilstm-base").collect()) == found[0]
        with pytest.raises(ValueError, match="registered already"):
            registry.register_bundle("bilstm-base", f"{tmp_path}/bundle")
    finally:
        registry._DETECTORS.clear()
        registry._DETECTORS.update(waiting)
    doc = (tmp_path / "bundle" / "bundle.json").read_text()
    (tmp_path / "bundle" / "bundle.json").write_text(doc.replace('"hidden_size": 8', '"hidden_size": 9'))
    with pytest.raises(ValueError, match="do not fit"):
        sequence.Bundle.load(f"{tmp_path}/bundle")
    (tmp_path / "bundle" / "bundle.json").write_text(doc.replace('"kind": "bilstm"', '"kind": "transformer"'))
    with pytest.raises(ValueError, match="no recurrent network"):
        sequence.Bundle.load(f"{tmp_path}/bundle")
