import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import lstm
from tidewatch.operators import detect as D
from tidewatch.operators.flows import FlowInputError
from tidewatch.operators.scorers import LinearScorer, lstm_scorer
from tidewatch.operators.scoring import top_features
from tidewatch.operators.sequences import TooFewWindowsError
from tidewatch.schemas import TACTIC_NAMES, VERDICT_ATTACK, VERDICT_CLEAR
from tidewatch.sources import scenario_store as store
from tidewatch.sources.bundle import (
    Bundle,
    BundleMissingError,
    load_bundle,
    save_bundle,
    seeded_lstm_weights,
)

FEATURES = ["Dst Port", "Protocol"]
WIDTH = 4 * len(FEATURES) + 4


def bundle(**changes):
    base = Bundle(
        feature_cols=FEATURES,
        scaler_mean=[0.5 * (d % 3) for d in range(WIDTH)],
        scaler_scale=[1.0 + 0.2 * d for d in range(WIDTH)],
        seq_len=3,
        k_steps=4,
        baseline={"mean": 0.5, "std": 0.2},
        hidden_size=16,
        weights=seeded_lstm_weights(WIDTH, hidden=16),
    )
    return replace(base, **changes)


def double(weights):
    return {k: v.astype(np.float64) for k, v in weights.items()}


def test_gradient_equals_finite_differences():
    w = double(seeded_lstm_weights(WIDTH, hidden=16))
    x = np.random.default_rng(1).normal(size=(3, 4, WIDTH))
    run = lstm.forward(w, 2, x)
    gradient = lstm.logit_gradient(w, 2, run, 4)
    step = 1e-6
    for t in range(4):
        for d in range(0, WIDTH, 3):
            moved = x.copy()
            moved[:, t, d] += step
            up = lstm.forward(w, 2, moved)["logit"]
            moved[:, t, d] -= 2 * step
            down = lstm.forward(w, 2, moved)["logit"]
            np.testing.assert_allclose(gradient[:, t, d], (up - down) / (2 * step), atol=1e-7)


def test_memory_carries_a_split_sequence():
    """Reading a sequence in two halves equals reading it at once."""
    w = double(seeded_lstm_weights(WIDTH, hidden=16))
    x = np.random.default_rng(2).normal(size=(2, 6, WIDTH))
    whole = lstm.forward(w, 2, x)
    half = lstm.forward(w, 2, x[:, :4])
    rest = lstm.forward(w, 2, x[:, 4:], half["memory"])
    np.testing.assert_allclose(whole["logit"], rest["logit"])
    np.testing.assert_allclose(whole["state"], rest["state"])


def plain_lstm(w, layers, x, memory=None):
    """The network written out gate by gate for one sequence."""
    size = w["ln.weight"].size
    sig = lambda v: 1 / (1 + np.exp(-v))
    memory = memory or [(np.zeros(size), np.zeros(size)) for _ in range(layers)]
    after, seq = [], list(x)
    for k in range(layers):
        h, c = memory[k]
        out = []
        for v in seq:
            z = (
                w[f"lstm.weight_ih_l{k}"] @ v + w[f"lstm.bias_ih_l{k}"]
                + w[f"lstm.weight_hh_l{k}"] @ h + w[f"lstm.bias_hh_l{k}"]
            )
            i, f, g, o = z[:size], z[size : 2 * size], z[2 * size : 3 * size], z[3 * size :]
            c = sig(f) * c + sig(i) * np.tanh(g)
            h = sig(o) * np.tanh(c)
            out.append(h)
        after.append((h, c))
        seq = out
    h = seq[-1]
    h = (h - h.mean()) / np.sqrt(h.var() + 1e-5) * w["ln.weight"] + w["ln.bias"]
    heads = []
    for name in ("state_head", "attack_head", "mitre_head"):
        z = np.maximum(w[f"{name}.0.weight"] @ h + w[f"{name}.0.bias"], 0)
        heads.append(w[f"{name}.3.weight"] @ z + w[f"{name}.3.bias"])
    return *heads, after


def test_batch_equals_one_by_one():
    w = double(seeded_lstm_weights(WIDTH, hidden=16))
    x = np.random.default_rng(3).normal(size=(5, 4, WIDTH))
    state, logits, classes, _ = lstm.score_batch(w, 2, 3, x)
    for n in range(5):
        s, a, m, memory = plain_lstm(w, 2, x[n])
        np.testing.assert_allclose(state[n], s)
        for k in range(3):
            np.testing.assert_allclose(logits[n, k], a[0])
            np.testing.assert_allclose(classes[n, k], m)
            s, a, m, memory = plain_lstm(w, 2, [s], memory)


def flows(spark, captures):
    rows = []
    for name, minutes in captures.items():
        for m in range(minutes):
            for j in range(1 + m % 3):
                rows.append((name, m * 60 + j, float(1000 + (m * 37 + j * 11) % 90), float((m + j) % 2 * 11 + 6)))
    df = spark.createDataFrame(rows, "capture_id string, s bigint, dst_port double, protocol double")
    return df.withColumn("timestamp", F.timestamp_seconds(F.lit(1704067200) + F.col("s"))).drop("s")


def expected(rows, b, w):
    """Scores of one capture, step by step as a single process would."""
    minutes = sorted({int(r[1].timestamp()) // 60 for r in rows})
    states = []
    for m in minutes:
        x = np.array([[r[2], r[3]] for r in rows if int(r[1].timestamp()) // 60 == m])
        states.append(
            np.concatenate(
                [x.mean(0), x.std(0), x.min(0), x.max(0),
                 [np.log1p(len(x)), np.log1p(len(set(x[:, 0]))), len(set(x[:, 1])), (x[:, 0] > 1024).mean()]]
            )
        )
    states = np.array(states)
    scaled = np.clip(
        (np.sign(states) * np.log1p(np.abs(states)) - b.scaler_mean) / b.scaler_scale, -3, 3
    )
    out = []
    for i in range(len(states) - b.seq_len):
        s, a, m, memory = plain_lstm(w, 2, scaled[i : i + b.seq_len].astype(np.float32).astype(float))
        prob = 1 / (1 + np.exp(-a[0]))
        mse = np.mean((s - scaled[i + b.seq_len]) ** 2)
        z = (mse - b.baseline["mean"]) / (b.baseline["std"] + 1e-8)
        risk = max(prob, 1 / (1 + np.exp(-(z - 3))))
        points = []
        for _ in range(b.k_steps):
            p = 1 / (1 + np.exp(-a[0]))
            points.append((p, TACTIC_NAMES[0 if p < b.threshold else int(np.argmax(m))]))
            s2, a, m2, memory = plain_lstm(w, 2, [s], memory)
            s, m = s2, m2
        out.append((prob, mse, risk, points))
    return out


def test_end_to_end_equals_single_process(spark):
    b = bundle()
    df = flows(spark, {"a": 12, "b": 9, "tiny": 3})
    w = double(b.weights)
    got = D.detect(df, b, lstm_scorer(spark, b.weights))
    for name in ("a", "b"):
        raw = [tuple(r) for r in df.filter(F.col("capture_id") == name).select("capture_id", "timestamp", "dst_port", "protocol").collect()]
        want = expected(raw, b, w)
        rows = got.windows.filter(F.col("capture_id") == name).orderBy("step_index").collect()
        assert len(rows) == len(want)
        for i, (r, (prob, mse, risk, points)) in enumerate(zip(rows, want)):
            assert r.step_index == i and r.timestamp == f"00:{i + b.seq_len:02d}:00"
            assert r.flow_count == 1 + (i + b.seq_len) % 3
            assert r._debug.attack_head_prob == pytest.approx(prob, abs=2e-4)
            assert r._debug.raw_mse == pytest.approx(mse, abs=1e-4)
            assert r.current_risk == pytest.approx(risk, abs=5e-4)
            assert [p.step_ahead for p in r.trajectory] == ["+1min", "+2min", "+3min", "+4min"]
            assert [p.stage for p in r.trajectory] == [s for _, s in points]
            for p, (q, _) in zip(r.trajectory, points):
                assert p.prob == pytest.approx(q, abs=2e-4)
            assert len(r.shap_features) == 3 and r.shap_features[0].importance == 1.0
    counts = {r.capture_id: r.total_windows_evaluated for r in got.summary.collect()}
    assert counts == {"a": 9, "b": 6}
    meta = {r.capture_id: r for r in got.metadata.collect()}
    assert meta["a"].rows_ingested == df.filter("capture_id = 'a'").count()
    assert meta["a"].detected_features == ["dst_port", "protocol", "timestamp"]


def test_wide_bundle_matches_whatever_the_batches(spark):
    b = bundle()
    df = flows(spark, {"a": 40})
    first = D.scored_windows(df, b, lstm_scorer(spark, b.weights)).orderBy("step_index").collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        second = D.scored_windows(df, b, lstm_scorer(spark, b.weights)).orderBy("step_index").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert [r.current_stage for r in first] == [r.current_stage for r in second]
    assert [r.current_risk for r in first] == pytest.approx([r.current_risk for r in second], abs=2e-4)


def test_strict_errors(spark):
    b = bundle()
    scorer = lstm_scorer(spark, b.weights)
    with pytest.raises(TooFewWindowsError, match="4"):
        D.scored_windows(flows(spark, {"a": 3}), b, scorer, strict=True)
    assert D.scored_windows(flows(spark, {"a": 4}), b, scorer, strict=True).count() == 1
    with pytest.raises(FlowInputError, match="no rows"):
        D.scored_windows(flows(spark, {"a": 4}).limit(0), b, scorer, strict=True)


def scored(spark, logit, classes, threshold=0.5, baseline=None, state=0.0):
    """One window from a scorer with constant outputs."""

    def constant(seq, k):
        step = F.struct(F.lit(logit).alias("logit"), F.array(*[F.lit(float(c)) for c in classes]).alias("class_logits"))
        return F.struct(
            F.array(*[F.lit(state)] * WIDTH).alias("pred_state"),
            F.array(*[step] * k).alias("steps"),
            F.array(*[F.lit(0.0)] * WIDTH).alias("importance"),
        )

    b = bundle(threshold=threshold, baseline=baseline)
    return D.scored_windows(flows(spark, {"a": 4}), b, constant)


def test_without_baseline(spark):
    row = scored(spark, 2.0, [0, 0, 5, 5]).first()
    assert row.current_risk == round(1 / (1 + math.exp(-2)), 4)
    assert row.current_stage == TACTIC_NAMES[2]
    assert row._debug.calibrated_mse is None and row._debug.raw_mse is None
    assert row._debug.benign_mse_baseline is None


def test_class_and_flag_use_different_roundings(spark):
    """The class is gated on the raw risk, the flag on the rounded one."""
    logit = math.log(0.49996 / 0.50004)  # rounds to 0.5, stays below it
    windows = scored(spark, logit, [0, 9], threshold=0.5)
    row = windows.first()
    assert row.current_risk == 0.5 and row.current_stage == "Benign"
    assert D.detection_log(windows, 0.5).first().is_attack


def test_hybrid_gate_and_own_gate(spark):
    """A large error lifts the current class, not the forecast's."""
    row = scored(spark, -4.0, [0, 0, 0, 9], baseline={"mean": 0.0, "std": 0.001}, state=50.0).first()
    assert row.current_risk == 1.0 and row.current_stage == TACTIC_NAMES[3]
    assert {p.stage for p in row.trajectory} == {"Benign"}


def test_unknown_class(spark):
    assert scored(spark, 4.0, [0] * 7 + [1]).first().current_stage == "Unknown"


def test_verdicts(spark):
    rows = spark.createDataFrame([("a", 0.5), ("a", 0.2), ("b", 0.4999)], "capture_id string, current_risk double")
    got = {r.capture_id: r for r in D.detection_summary(rows, 0.5).collect()}
    assert got["a"].verdict == VERDICT_ATTACK and got["a"].anomalous_windows_detected == 1
    assert got["b"].verdict == VERDICT_CLEAR and got["b"].total_windows_evaluated == 1


def test_top_features_ties_and_zero(one):
    names = [f"f{i}" for i in range(5)]
    got = one(
        "x array<double>, z array<double>",
        ([1.0, 4.0, 2.0, 4.0, 0.0], [0.0] * 5),
        x=top_features(F.col("x"), names),
        z=top_features(F.col("z"), names),
    )
    assert [tuple(r) for r in got["x"]] == [("f1", 1.0), ("f3", 1.0), ("f2", 0.5)]
    assert [tuple(r) for r in got["z"]] == [("f0", 0.0), ("f1", 0.0), ("f2", 0.0)]


def test_linear_scorer(spark):
    scorer = LinearScorer([1.0, -1.0], [[1.0, 0.0], [0.0, 1.0]], 0.5, 0.5, 0.1)
    df = spark.createDataFrame([([[9.0, 9.0], [2.0, 4.0]],)], "seq array<array<float>>")
    out = df.select(scorer(F.col("seq"), 3).alias("o")).first().o
    assert out.pred_state == pytest.approx([1.1, 2.1])
    assert [s.logit for s in out.steps] == pytest.approx([-1.5, -0.5, 0.0])
    assert out.steps[1].class_logits == pytest.approx([1.1, 2.1])
    assert out.importance == pytest.approx([1.0, 2.0])


def test_forecast_and_dashboard_rows(spark):
    windows = scored(spark, 2.0, [0, 5])
    points = D.forecast_points(windows).orderBy("point").collect()
    assert [p.time_key for p in points] == ["T_0 (Observed)", "+1min", "+2min", "+3min", "+4min"]
    assert points[0].probability == windows.first().current_risk
    row = D.dashboard_rows(windows, 0.5).first()
    assert (row.band, row.status, row.percent) == ("Critical Anomaly", "Flagged", "88.1%")


def test_bundle_round_trip(tmp_path):
    b = bundle()
    save_bundle(b, str(tmp_path / "b"))
    again = load_bundle(str(tmp_path / "b"))
    assert again.feature_cols == b.feature_cols and again.baseline == b.baseline
    np.testing.assert_array_equal(again.weights["ln.weight"], b.weights["ln.weight"])
    with pytest.raises(BundleMissingError):
        load_bundle(str(tmp_path / "absent"))
    with pytest.raises(ValueError, match="scale"):
        bundle(scaler_scale=[0.0] * WIDTH)
    assert bundle(window_size="1min").spark_window == "60000000 microseconds"


def test_scenarios(spark, tmp_path):
    folder = str(tmp_path / "store")
    assert store.list_scenarios(spark, folder).count() == 0
    with pytest.raises(store.ScenarioNotFoundError):
        store.scenario_step(spark, folder, "001", 0)
    found = D.detect(flows(spark, {"a": 6, "b": 5}), bundle(), lstm_scorer(spark, bundle().weights))
    name = F.when(F.col("capture_id") == "a", "001").otherwise("002")
    meta = found.metadata.withColumn("scenario_id", name).drop("capture_id")
    windows = found.windows.withColumn("scenario_id", name).drop("capture_id")
    store.save_scenarios(meta, windows, folder)
    store.save_scenarios(
        meta.filter("scenario_id = '002'").withColumn("name", F.lit("again")),
        windows.filter("scenario_id = '002'"),
        folder,
    )
    listed = {r.id: r.name for r in store.list_scenarios(spark, folder).collect()}
    assert listed == {"001": "Ingested Dataset: a", "002": "again"}
    step = store.scenario_step(spark, folder, "001", 2).first()
    assert step.total_steps == 3 and step.step_index == 2 and len(step.trajectory) == 4
    for bad in (-1, 3):
        with pytest.raises(store.StepOutOfRangeError):
            store.scenario_step(spark, folder, "001", bad)
    with pytest.raises(store.ScenarioNotFoundError):
        store.scenario_step(spark, folder, "003", 0)


def test_score_without_python_for_linear(spark):
    b = bundle()
    scorer = LinearScorer([0.1] * WIDTH, [[0.1] * WIDTH] * 7)
    windows = D.scored_windows(flows(spark, {"a": 6}), b, scorer)
    plan = windows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
    assert windows.count() == 3
