"""Analysis of training logs: means over ranks, moving average, gate, records.

``step`` counts the loss evaluations of a run from 0, so it is dense.

A moving average looks sequential, but a stretch of steps acts on it as
``e -> c + d**n * e``. Runs are therefore cut into stretches of consecutive steps:
windows work inside a stretch, and only one summary row per stretch is folded in
order. No task ever holds a whole run.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievecraft.functions.schedule import loss_weight, phase, total_loss
from sievecraft.functions.vectors import doubles, dot, total

# Fixed values.
EARLY_STEPS = 5
EMA_FLOOR = 1e-10
EMA_DECAY = 0.99
GATE_THRESHOLD = 1.5
GATE_MODES = ("static", "dynamic")

_MAX_STRETCH = 4096
_LOG_LIMIT = 500.0  # natural log of the largest factor a stretch may scale by


def rank_mean(df: DataFrame, by: Sequence[str], *values: str) -> DataFrame:
    """Mean of each value over the ranks of a step."""
    return df.groupBy(*by).agg(*[F.avg(v).alias(v) for v in values])


def any_rank(df: DataFrame, by: Sequence[str], flag: str) -> DataFrame:
    """The flag of a step holds if it holds on any rank."""
    return df.groupBy(*by).agg(F.bool_or(flag).alias(flag))


def _stretch_width(decay: float) -> int:
    if decay <= 0 or decay >= 1:
        return _MAX_STRETCH
    return max(1, min(_MAX_STRETCH, int(_LOG_LIMIT / -math.log(decay))))


def _carry_fold(decay: float):
    """Average and last value before each stretch, from the stretch summaries of one run."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        import pandas as pd

        pdf = pdf.sort_values("_stretch")
        average, previous, rows = float(pdf["_first"].iloc[0]), None, []
        for s in pdf.itertuples(index=False):
            rows.append((average, previous))
            average, previous = s[4] + decay ** int(s[3]) * average, s[5]
        carried = pd.DataFrame(rows, columns=["_ema_before", "_value_before"])
        keys = pdf.iloc[:, [0, 1]].reset_index(drop=True)
        return pd.concat([keys, carried.astype("float64")], axis=1)

    return fold


def moving_average(df: DataFrame, run: str, step: str, value: str, decay: float = EMA_DECAY) -> DataFrame:
    """Adds ``ema`` (seeded with the first value) and what was known before each step.

    ``prev_value`` and ``prev_ema`` are null at the first step of a run. A row
    without run or step raises.
    """
    stretch = Window.partitionBy(run, "_stretch").orderBy(step)
    upto = stretch.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x, n, d = F.col(value).cast("double"), F.col("_n"), F.lit(float(decay))
    gone = F.col(run).isNull() | F.col(step).isNull()
    place = F.floor(F.col(step) / _stretch_width(decay))
    checked = F.when(gone, F.raise_error(F.lit("a row without run or step"))).otherwise(place)
    # Said here, so that both readers of the stretches below filter alike and share a shuffle.
    placed = df.withColumn("_stretch", checked).where("_stretch IS NOT NULL")
    counted = placed.withColumn("_n", F.row_number().over(stretch))
    if decay > 0:
        inside = F.sum(x * (1 - d) * F.pow(d, -n)).over(upto) * F.pow(d, n)
    else:
        inside = x
    local = counted.withColumn("_local", inside)
    summary = local.groupBy(run, "_stretch").agg(
        F.min_by(x, step).alias("_first"),
        F.max("_n").alias("_rows"),
        F.max_by("_local", step).alias("_end"),
        F.max_by(x, step).alias("_last"),
    )
    run_type = df.schema[run].dataType.simpleString()
    carried = summary.groupBy(run).applyInPandas(
        _carry_fold(decay),
        f"`{run}` {run_type}, _stretch bigint, _ema_before double, _value_before double",
    )
    at_start = F.col("_n") == 1
    first_ever = at_start & F.col("_value_before").isNull()
    ema = F.col("_local") + F.pow(d, n) * F.col("_ema_before")
    return (
        local.join(carried, [run, "_stretch"])
        .withColumn("ema", ema)
        .withColumn("prev_value", F.when(at_start, F.col("_value_before")).otherwise(F.lag(x).over(stretch)))
        .withColumn(
            "prev_ema",
            F.when(~first_ever, F.when(at_start, F.col("_ema_before")).otherwise(F.lag("ema").over(stretch))),
        )
        .drop("_stretch", "_n", "_local", "_ema_before", "_value_before")
    )


def gate(
    df: DataFrame, step: str, mode: str = "dynamic", threshold: float = GATE_THRESHOLD, head_warmup: int = 0
) -> DataFrame:
    """Adds ``gated``, decided from the state before the step.

    Expects the columns ``moving_average`` adds. Never gated at the first step of
    a run or while the head warms up.
    """
    if mode not in GATE_MODES:
        raise ValueError(f"unknown gate mode: {mode}")
    last, average = F.col("prev_value"), F.col("prev_ema")
    if mode == "static":
        low = last < threshold
    else:
        low = (average >= EMA_FLOOR) & (last < average / threshold)
    return df.withColumn("gated", F.coalesce(low, F.lit(False)) & (F.col(step) >= head_warmup))


def telemetry_records(
    df: DataFrame,
    run: str,
    step: str,
    base: float = 1.0,
    head_warmup: int = 0,
    loss_warmup: int = 0,
    max_steps: int = 0,
    schedule: str = "constant",
    gate_mode: str | None = None,
    threshold: float = GATE_THRESHOLD,
    decay: float = EMA_DECAY,
) -> DataFrame:
    """One metric record per step from ``ar_loss`` and ``fm_loss``.

    The three gate fields are present when ``gate_mode`` is given. ``fm_grad_norm``
    keeps its historical name; it holds the loss.
    """
    weight = loss_weight(F.col(step), base, head_warmup, loss_warmup, max_steps, schedule)
    if gate_mode:
        df = gate(moving_average(df, run, step, "fm_loss", decay), step, gate_mode, threshold, head_warmup)
    records = df.withColumn("fm_weight", weight).withColumn("fm_phase", phase(F.col(step), head_warmup))
    total_col = total_loss(F.col("ar_loss"), F.col("fm_loss"), F.col("fm_weight"), F.col("fm_phase"))
    gate_fields: list[Column] = []
    if gate_mode:
        gate_fields = [
            F.col("fm_loss").alias("fm_grad_norm"),
            F.col("ema").alias("fm_grad_norm_ema"),
            F.col("gated").cast("double").alias("fm_grad_gated"),
        ]
    return records.select(
        run, step, "ar_loss", "fm_loss", "fm_weight", "fm_phase", total_col.alias("total_loss"), *gate_fields
    )


def flush_every(df: DataFrame, run: str, step: str, n: int) -> DataFrame:
    """The last record of every ``n`` steps: what a logger that fires then would see."""
    bucket = F.floor(F.col(step) / n).alias("_bucket")
    last = F.max_by(F.struct(*df.columns), step).alias("_record")
    return df.groupBy(run, bucket).agg(last).select("_record.*")


def early_diagnostics(
    df: DataFrame, by: Sequence[str], step: str, loss: Column, target: Column, first: int = EARLY_STEPS
) -> DataFrame:
    """For the first steps: mean and maximum loss, mean and L2 norm of the targets."""
    v = doubles(target)
    early = df.where(F.col(step) < first)
    return early.groupBy(*by).agg(
        F.avg(loss).alias("loss_mean"),
        F.max(loss).alias("loss_max"),
        F.try_divide(F.sum(total(v)), F.sum(F.size(v))).alias("target_mean"),
        F.sqrt(F.sum(dot(v, v))).alias("target_norm"),
    )
