import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievecraft.functions.schedule import loss_weight, phase, total_loss
from sievecraft.operators import telemetry
from sievecraft.operators.telemetry import (
    any_rank,
    early_diagnostics,
    flush_every,
    gate,
    moving_average,
    rank_mean,
    telemetry_records,
)


def averages(values, decay):
    """Closed form: the first value fades as decay**n, value k counts (1 - decay) * decay**(n - k)."""
    x, n = np.array(values), np.arange(len(values))
    weights = np.where(n[:, None] >= n, decay ** np.maximum(n[:, None] - n, 0.0), 0.0)
    weights[:, 1:] *= 1 - decay
    return weights @ x


def gates(values, decay, mode, threshold, head):
    """Averages and decisions as whole arrays: only what came before a step decides on it."""
    ema, x = averages(values, decay), np.array(values)
    low = x[:-1] < threshold if mode == "static" else (x[:-1] < ema[:-1] / threshold) & (ema[:-1] >= 1e-10)
    return ema, np.append([False], low) & (np.arange(len(x)) >= head)


def runs_df(spark, runs):
    rows = [(run, step, x) for run, values in runs.items() for step, x in enumerate(values)]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, "run string, step bigint, loss double")


@pytest.mark.parametrize("decay", [0.0, 0.5, 0.9, 0.99, 0.9999, 1.0])
@pytest.mark.parametrize("stretch", [1, 7, 4096])
def test_average_and_gates_equal_the_loop(spark, monkeypatch, decay, stretch):
    monkeypatch.setattr(telemetry, "_MAX_STRETCH", stretch)
    rng = random.Random(4)
    runs = {
        "long": [rng.random() * (1 + i % 5) for i in range(900)],
        "one": [0.4],
        "zeros": [0.0] * 20,
        "falling": [0.97**i for i in range(60)],
    }
    df = moving_average(runs_df(spark, runs), "run", "step", "loss", decay)
    rows = {(r.run, r.step): r for r in gate(df, "step", "dynamic", 1.5, 0).collect()}
    fixed = {(r.run, r.step): r.gated for r in gate(df, "step", "static", 0.3, 10).collect()}
    for run, values in runs.items():
        want = averages(values, decay)
        for step in range(len(values)):
            row = rows[run, step]
            assert row.ema == pytest.approx(want[step], rel=1e-9, abs=1e-12)
            # what was known before the step decides, and nothing is known before the first
            ratio = values[step - 1] / want[step - 1] if step and want[step - 1] >= 1e-10 else math.inf
            if abs(ratio - 1 / 1.5) > 1e-9:
                assert row.gated == (ratio < 1 / 1.5), (run, step)
            assert fixed[run, step] == (step >= 10 and values[step - 1] < 0.3), (run, step)


def test_gapped_steps(spark):
    rows = [("r", s, float(s % 3)) for s in (5, 6, 9000, 9001, 20000)]
    df = moving_average(spark.createDataFrame(rows, "run string, step bigint, loss double"), "run", "step", "loss", 0.9)
    got = [r.ema for r in df.orderBy("step").collect()]
    assert got == pytest.approx(averages([r[2] for r in rows], 0.9))


# (schedule, head, warm, max_steps) -> weight by step, for a base of 0.3
WEIGHTS = {
    ("constant", 10, 20, 100): {0: 0.3, 9: 0.3, 10: 0.0, 15: 0.075, 29: 0.285, 30: 0.3, 129: 0.3},
    ("linear_decay", 0, 0, 100): {0: 0.3, 50: 0.15, 99: 0.003, 100: 0.0, 129: 0.0},
    ("linear_decay", 10, 20, 100): {9: 0.3, 20: 0.15, 30: 0.3, 65: 0.15, 100: 0.0, 120: 0.0},
    ("linear_decay", 10, 20, 30): {30: 0.3, 129: 0.3},
    ("linear_decay", 5, 5, 0): {4: 0.3, 5: 0.0, 10: 0.3, 129: 0.3},
    ("cosine_decay", 0, 20, 100): {0: 0.0, 10: 0.15, 20: 0.3, 60: 0.15, 100: 0.0},
    ("cosine_decay", 10, 0, 100): {9: 0.3, 10: 0.3, 40: 0.225, 70: 0.075, 100: 0.0},
}


@pytest.mark.parametrize("case", WEIGHTS)
def test_loss_weight(spark, case):
    schedule, head, warm, max_steps = case
    weight = loss_weight(F.col("id"), 0.3, head, warm, max_steps, schedule).alias("w")
    got = {r.id: r.w for r in spark.range(0, 130).select("id", weight).collect()}
    assert {s: got[s] for s in WEIGHTS[case]} == pytest.approx(WEIGHTS[case], abs=1e-12)
    falls = [got[s] for s in range(head + warm, 130)]
    assert falls == sorted(falls, reverse=True) and all(0 <= w <= 0.3 for w in got.values())


def test_unknown_names_are_refused(spark):
    with pytest.raises(ValueError):
        loss_weight(F.lit(1), 1.0, schedule="other")
    with pytest.raises(ValueError):
        gate(spark.range(1), "id", "other")


def test_phase_and_total(spark):
    df = spark.range(0, 4).withColumn("p", phase(F.col("id"), 2))
    got = df.select("p", total_loss(F.lit(10.0), F.lit(2.0), F.lit(0.5), F.col("p"))).collect()
    assert [tuple(r) for r in got] == [(0.0, 1.0), (0.0, 1.0), (1.0, 11.0), (1.0, 11.0)]


def test_ranks(spark):
    df = spark.createDataFrame([("r", 0, 1.0, False), ("r", 0, 3.0, True), ("r", 1, 5.0, False)], "run string, step int, l double, g boolean")
    assert {tuple(r) for r in rank_mean(df, ["run", "step"], "l").collect()} == {("r", 0, 2.0), ("r", 1, 5.0)}
    assert {tuple(r) for r in any_rank(df, ["run", "step"], "g").collect()} == {("r", 0, True), ("r", 1, False)}


def test_records_and_flush(spark):
    rows = [("r", s, 1.0, 0.5) for s in range(25)]
    df = spark.createDataFrame(rows, "run string, step bigint, ar_loss double, fm_loss double")
    plain = telemetry_records(df, "run", "step", 0.2, 5)
    assert plain.columns == ["run", "step", "ar_loss", "fm_loss", "fm_weight", "fm_phase", "total_loss"]
    gated = telemetry_records(df, "run", "step", 0.2, 5, gate_mode="static", threshold=0.6)
    assert gated.columns[-3:] == ["fm_grad_norm", "fm_grad_norm_ema", "fm_grad_gated"]
    assert {r.step for r in gated.where("fm_grad_gated = 1").collect()} == set(range(5, 25))
    assert sorted(r.step for r in flush_every(plain, "run", "step", 10).collect()) == [9, 19, 24]


def test_early_diagnostics(spark):
    df = spark.createDataFrame([(0, 1.0, [3.0, 4.0]), (4, 3.0, [0.0, 5.0]), (5, 100.0, [9.0, 9.0])], "step int, l double, v array<double>")
    r = early_diagnostics(df, [], "step", F.col("l"), F.col("v")).first()
    assert tuple(r) == (2.0, 3.0, 3.0, pytest.approx(math.sqrt(50)))
