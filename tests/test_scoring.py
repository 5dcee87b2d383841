from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from layerframe.operators import features, learning, nets
from layerframe.operators.metrics import evaluate, mse
from layerframe.operators.scoring import load_parameters, save_parameters, score, score_dense, score_profiles
from layerframe.operators.stats import Norm
from layerframe.plans.evaluation import report_models, score_samples
from layerframe.schema import LAYER_VARS, STAT_VARS
from tests.conftest import plan_of

LAYERS = 50
NETS = {
    "conv": nets.CONV_NET,
    "linear": nets.CONV_NET_LINEAR,
    "max": nets.MAX_POOL_NET,
    "initial": nets.INITIAL_NET,
    "flat": nets.FLAT_NET,
}


def act(x, kind):
    if kind == "relu":
        return x if x > 0 else 0.0
    return x if x > 0 else math.expm1(x)


def by_hand(net, parameters, snow, scalars):
    """One row, one number at a time, straight from the layer definitions."""
    queue = iter(parameters)
    x = snow.tolist() if snow is not None else None
    for stage in net.stages:
        if stage[0] == "conv":
            w, b = next(queue)
            length, stride = len(x[0]), stage[2]
            x = [
                [
                    b[o] + sum(
                        w[o, c, k] * x[c][q * stride + k - 1]
                        for c in range(len(x)) for k in range(3)
                        if 0 <= q * stride + k - 1 < length
                    )
                    for q in range(-(-length // stride))
                ]
                for o in range(len(b))
            ]
        elif stage[0] == "act":
            x = [[act(v, net.activation) for v in row] for row in x]
        elif stage[0] == "pool":
            k = stage[1]
            x = [[max(row[i * k:(i + 1) * k]) for i in range(len(row) // k)] for row in x]
        else:
            x = [[max(row)] for row in x]
    flat = [v for row in x for v in row] + list(scalars) if x is not None else list(scalars)
    for _ in net.dense:
        w, b = next(queue)
        flat = [act(b[o] + float(np.dot(w[o], flat)), net.activation) for o in range(len(b))]
    w, b = next(queue)
    out = b[0] + float(np.dot(w[0], flat))
    return 1 / (1 + math.exp(-out)) if net.output == "sigmoid" else out


def narrow(net):
    """The same stack with few channels, so the loop above finishes."""
    shrink = {32: 3, 64: 4, 128: 5, 256: 6}
    stages = tuple(("conv", shrink[s[1]], s[2]) if s[0] == "conv" else s for s in net.stages)
    return nets.Net(stages, tuple(min(d, 7) for d in net.dense), net.activation, net.channels,
                    net.scalars, net.output)


@pytest.mark.parametrize("name", sorted(NETS))
def test_forward_pass_equals_the_loop(spark, name):
    net = narrow(NETS[name])
    rng = np.random.default_rng(8)
    parameters = [
        (rng.normal(size=w) / np.sqrt(np.prod(w[1:])), rng.normal(size=b))
        for w, b in nets.parameter_shapes(net, LAYERS)
    ]
    snow, sun = rng.normal(size=(9, 6, LAYERS)), rng.normal(size=(9, 4))
    if net.stages:
        rows = [(i, s.tolist(), v.tolist()) for i, (s, v) in enumerate(zip(snow, sun))]
        df = spark.createDataFrame(rows, "i int, x_snow array<array<double>>, x_sun array<double>")
        got = score(df, net, parameters, LAYERS, dtype="float64")
        want = [by_hand(net, parameters, s, v[: net.scalars]) for s, v in zip(snow, sun)]
    else:
        flat = np.concatenate([snow.reshape(9, -1), sun[:, :3]], axis=1)
        df = spark.createDataFrame([(i, f.tolist()) for i, f in enumerate(flat)], "i int, x array<double>")
        got = score(df, net, parameters, LAYERS, scalars="x", dtype="float64")
        want = [by_hand(net, parameters, None, f) for f in flat]
    found = [r["yhat"] for r in got.orderBy("i").collect()]
    assert found == pytest.approx(want, rel=1e-9)


def shallow(rng, depths):
    """Stacks with that many layers and zeros behind; one has a gap at its top."""
    snow = np.zeros((len(depths), 6, LAYERS))
    for row, deep in enumerate(depths):
        snow[row, :, :deep] = rng.normal(size=(6, deep))
    snow[-1, :, 0] = 0.0
    return snow


@pytest.mark.parametrize("name", ["conv", "linear", "max", "initial"])
def test_shallow_and_deep_profiles_in_one_batch_equal_the_loop(name):
    net, rng = narrow(NETS[name]), np.random.default_rng(5)
    parameters = [
        (rng.normal(size=w) / np.sqrt(np.prod(w[1:])), rng.normal(size=b))
        for w, b in nets.parameter_shapes(net, LAYERS)
    ]
    depths = [50, 0, 3, 49, 1, 20, 48, 2, 7, 12, 0, 30, 4]
    snow, sun = shallow(rng, depths), rng.normal(size=(len(depths), net.scalars))
    snow[5, 2] = np.nan  # a variable without deviation is missing in every layer
    for rows in (1, 4, 128):
        slices, nets.SLICE_ROWS = nets.SLICE_ROWS, rows
        try:
            found = nets.predict(net, parameters, snow, sun)
        finally:
            nets.SLICE_ROWS = slices
        whole = [i for i in range(len(depths)) if i != 5]
        want = [by_hand(net, parameters, snow[i], sun[i]) for i in whole]
        assert found[whole] == pytest.approx(want, rel=1e-9) and np.isnan(found[5])


def test_positions_behind_a_profile_are_computed_once(monkeypatch):
    net, rng = narrow(nets.MAX_POOL_NET), np.random.default_rng(6)
    computed, inner = [], nets._convolve
    monkeypatch.setattr(nets, "_convolve", lambda *a: computed.append(out := inner(*a)) or out)
    nets.predict(net, nets.waves(net, LAYERS), shallow(rng, [4] * 200), rng.normal(size=(200, 4)))
    # six convolutions of profiles with 4 layers reach 5 to 10 positions
    assert sum(x.shape[0] * x.shape[1] for x in computed if len(x) > 1) == 200 * (5 + 6 + 7 + 8 + 9 + 10)


def test_flat_network_skips_layers_no_profile_has(monkeypatch):
    net = nets.Net((), (8, 4), "relu")
    parameters = nets.waves(net, LAYERS, "float64")
    stack = np.zeros((2500, 6, LAYERS))
    stack[:, :, :7] = np.random.default_rng(5).normal(size=(2500, 6, 7))
    stack[2400, 3, 40] = np.nan
    x = np.concatenate([stack.reshape(2500, -1), np.ones((2500, 3))], axis=1)
    widths, plain = [], nets.forward
    monkeypatch.setattr(nets, "forward", lambda net, dense, x: widths.append(x.shape) or plain(net, dense, x))
    found = nets.predict(net, parameters, None, x)
    assert widths == [(1024, 45), (1024, 45), (452, 46)]
    assert np.isnan(found[2400]) and np.isnan(found).sum() == 1
    for row in (0, 1023, 1024, 2399, 2499):
        assert found[row] == pytest.approx(by_hand(net, parameters, None, x[row]), abs=1e-12)
    parameters[0][0][2, 49] = np.inf
    assert np.isnan(nets.predict(net, parameters, None, x)).all()
    assert len(nets.predict(net, parameters, None, x[:0])) == 0


@pytest.mark.parametrize("name,inputs", [("conv", 64 * 7 + 4), ("max", 256 + 4), ("initial", 256 + 3), ("flat", 303)])
def test_published_sizes(name, inputs):
    net = NETS[name]
    shapes = nets.parameter_shapes(net, LAYERS)
    first_dense = shapes[len([s for s in net.stages if s[0] == "conv"])]
    assert first_dense[0][1] == inputs
    assert shapes[-1][0][0] == 1
    with pytest.raises(ValueError):
        nets.check_parameters(net, LAYERS, nets.waves(net, LAYERS)[:-1])


def test_stored_parameters(spark, tmp_path):
    net, path = narrow(nets.CONV_NET), str(tmp_path / "weights")
    made = nets.waves(net, LAYERS)
    save_parameters(spark, made, path)
    for (w, b), (x, y) in zip(made, load_parameters(spark, path, net, LAYERS)):
        assert np.array_equal(w, x) and np.array_equal(b, y)
    rows = nets.parameters_to_rows(made)
    for wrong in (rows[:-1], [*rows, rows[0]], [*rows[:-1], (99, "bias", 0, 1.0)]):
        with pytest.raises(ValueError):
            nets.parameters_from_rows(net, LAYERS, wrong)


def test_rows_without_a_feature_are_errors(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, None)], "a double, b double")
    with pytest.raises(Exception):
        learning.with_vector(df, ["a", "b"]).collect()


def test_single_and_double_precision_agree(spark):
    net, rng = nets.CONV_NET, np.random.default_rng(3)
    weights = nets.waves(net, LAYERS)
    snow, sun = rng.normal(size=(40, 6, LAYERS)), rng.normal(size=(40, 4))
    rows = [(i, s.tolist(), v.tolist()) for i, (s, v) in enumerate(zip(snow, sun))]
    df = spark.createDataFrame(rows, "i int, x_snow array<array<float>>, x_sun array<float>").repartition(3)
    single = score(df, net, weights, LAYERS).orderBy("i").collect()
    double = nets.predict(net, [(w.astype("f8"), b.astype("f8")) for w, b in weights], snow, sun)
    assert [r["yhat"] for r in single] == pytest.approx(double.tolist(), abs=1e-4)
    assert all(0 < r["yhat"] < 1 for r in single)


def test_missing_input_gives_a_missing_prediction(spark):
    net = narrow(nets.CONV_NET)
    df = spark.createDataFrame(
        [([[0.0] * LAYERS] * 6, [None, 1.0, 1.0, 1.0]), ([[0.0] * LAYERS] * 6, [0.0, 1.0, 1.0, 1.0])],
        "x_snow array<array<float>>, x_sun array<float>",
    )
    found = [r["yhat"] for r in score(df, net, nets.waves(net, LAYERS), LAYERS).collect()]
    assert sum(v is None for v in found) == 1


def test_dense_scoring_in_the_jvm(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([0.0, 0.0],)], "x array<double>")
    got = [r["yhat"] for r in score_dense(df, "x", [0.5, -1.0], 0.25).collect()]
    assert got == pytest.approx([1 / (1 + math.exp(1.25)), 1 / (1 + math.exp(-0.25))])
    linear = [r["yhat"] for r in score_dense(df, "x", [0.5, -1.0], 0.25, output="linear").collect()]
    assert linear == pytest.approx([-1.25, 0.25])


@pytest.mark.parametrize("kind,settings", [("linear", {}), ("gbt", {"maxIter": 5, "seed": 1})])
def test_regressors_beat_the_mean(spark, kind, settings):
    df = spark.range(800).select(
        (F.rand(1) * 2).alias("a"), F.rand(2).alias("b")
    ).withColumn("albedo", F.col("a") * 0.4 - F.col("b") * 0.2 + F.rand(3) * 0.05)
    model = learning.fit_regressor(df, ["a", "b"], kind=kind, **settings)
    scored = learning.predict_with(model, df, ["a", "b"])
    errors = scored.agg(mse().alias("fit"), F.var_pop("albedo").alias("mean")).first()
    assert errors["fit"] < 0.2 * errors["mean"]


def test_sweep_has_one_trial_per_grid_point(spark):
    df = spark.range(300).select(F.rand(1).alias("a"), F.array(F.rand(4)).alias("v"))
    df = df.withColumn("albedo", F.col("v")[0] * 0.5)
    trials = learning.sweep(df, df, "v", {"regParam": [0.0, 5.0], "elasticNetParam": [0.0, 1.0]})
    assert trials.count() == 4
    assert learning.best_trial(trials).first()["regParam"] == 0.0


@pytest.mark.parametrize("name", sorted(NETS))
def test_scoring_stored_profiles_equals_features_then_score(spark, name):
    net, rng = narrow(NETS[name]), np.random.default_rng(4)
    parameters = [(rng.normal(size=w) / np.sqrt(np.prod(w[1:])), rng.normal(size=b)) for w, b in nets.parameter_shapes(net, LAYERS)]
    norm = Norm({v: 0.3 for v in STAT_VARS}, {v: 0.7 for v in STAT_VARS})
    rows = []
    for i in range(30):
        deep = int(rng.integers(0, LAYERS + 1))
        stacks = [[None if rng.random() < 0.2 else float(x) for x in rng.random(deep)] for _ in LAYER_VARS]
        if i == 7:
            stacks = [None] * len(LAYER_VARS)
        if i == 8:
            stacks = [s + [None] * 70 for s in stacks]
        rows.append((i, *stacks, None if i == 9 else float(rng.random()), *[float(x) for x in rng.random(3)]))
    df = spark.createDataFrame(
        rows, "i int, " + ", ".join(f"{v} array<double>" for v in LAYER_VARS) + ", direct_sw double, diffuse_sw double, cos_sza double, albedo double"
    )
    if net.stages:
        want = score(features.build_features(df, norm, ("i",), LAYERS), net, parameters, LAYERS)
    else:
        want = score(features.build_flat_features(df, norm, ("i",), LAYERS), net, parameters, LAYERS, scalars="x")
    got = score_profiles(df, norm, net, parameters, LAYERS)
    pairs = zip(*[[r["yhat"] for r in d.orderBy("i").select("yhat").collect()] for d in (got, want)])
    for at, (a, b) in enumerate(pairs):
        assert (a is None) == (b is None) == (at == 9 and bool(net.stages))
        assert a is None or a == pytest.approx(b, abs=1e-6)
    with pytest.raises(Exception, match="beyond depth"):
        score_profiles(df, norm, net, nets.waves(net, 8), 8).collect()


def test_scoring_stored_profiles_builds_no_features_in_the_jvm(spark):
    df = spark.createDataFrame([], ", ".join(f"{v} array<double>" for v in LAYER_VARS) + ", direct_sw double, diffuse_sw double, cos_sza double, albedo double")
    norm = Norm({v: 0.0 for v in STAT_VARS}, {v: 1.0 for v in STAT_VARS})
    plan = plan_of(score_samples(df, norm, nets.waves(nets.CONV_NET, LAYERS), nets.CONV_NET))
    assert "ArrowEvalPython" in plan and "lambda" not in plan and "array_repeat" not in plan


def test_halving_keeps_the_better_half_on_more_seasons(spark):
    df = spark.range(800).select(
        F.lit("Alpes").alias("geo"), F.concat(F.lit("s"), F.col("id") % 8).alias("season"), F.rand(1).alias("a"),
    ).withColumn("albedo", F.col("a") * 0.5)
    grid = {"regParam": [5.0, 0.0, 0.1, 1.0], "elasticNetParam": [0.0]}
    trials = learning.halving(df, df, ["a"], grid, 3).collect()
    assert [(r["rung"], r["n_groups"]) for r in sorted(trials)] == [(0, 2)] * 4 + [(1, 4)] * 2 + [(2, 8)]
    by_rung = {k: {r["trial"] for r in trials if r["rung"] == k} for k in range(3)}
    assert by_rung[1] == {1, 2} and by_rung[2] == {1}
    last = [r for r in trials if r["rung"] == 2][0]
    assert (last["regParam"], last["value"]) == (0.0, pytest.approx(0.0, abs=1e-12))
    full = {r["trial"]: r["value"] for r in learning.sweep(df, df, ["a"], grid).collect()}
    assert last["value"] == pytest.approx(full[1], abs=1e-12)
    with pytest.raises(ValueError):
        learning.halving(df, df, ["a"], grid, 0)


def test_models_are_reported_over_the_same_rows(spark):
    rng = np.random.default_rng(9)
    rows = [("g", f"s{i % 3}", *[[float(x) for x in rng.random(i % 5)] for _ in LAYER_VARS], *[float(x) for x in rng.random(4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "geo string, season string, " + ", ".join(f"{v} array<double>" for v in LAYER_VARS) + ", direct_sw double, diffuse_sw double, cos_sza double, albedo double")
    plan = spark.createDataFrame([("g", "s0", "train"), ("g", "s1", "test")], "geo string, season string, split string")
    norm = Norm({v: 0.5 for v in STAT_VARS}, {v: 0.3 for v in STAT_VARS})
    models = {n: (narrow(NETS[n]), nets.waves(narrow(NETS[n]), LAYERS)) for n in ("conv", "flat", "max")}
    table = {(r["model"], r["split"]): r for r in report_models(df, plan, norm, models).collect()}
    assert len(table) == 6
    for name, (net, weights) in models.items():
        alone = evaluate(score_samples(df.join(plan, ["geo", "season"]), norm, weights, net, ("split",)))
        for r in alone.collect():
            mine = table[name, r["split"]]
            assert mine["n"] == r["n"] and [mine["mse"], mine["mae"]] == pytest.approx([r["mse"], r["mae"]])
