"""Loss weight, phase and total loss as functions of the step."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Schedules of the loss weight after both warm-ups.
SCHEDULES = ("constant", "linear_decay", "cosine_decay")


def loss_weight(
    step: Column,
    base: float,
    head_warmup: int = 0,
    loss_warmup: int = 0,
    max_steps: int = 0,
    schedule: str = "constant",
) -> Column:
    """Full weight while the head warms up, then a ramp from 0, then the schedule."""
    if schedule not in SCHEDULES:
        raise ValueError(f"unknown schedule: {schedule}")
    remaining = max_steps - head_warmup - loss_warmup
    full = F.lit(float(base))
    if schedule == "constant" or max_steps <= 0 or remaining <= 0:
        scheduled = full
    else:
        done = F.least(F.greatest((step - head_warmup - loss_warmup) / remaining, F.lit(0.0)), F.lit(1.0))
        share = 1 - done if schedule == "linear_decay" else (1 + F.cos(math.pi * done)) / 2
        scheduled = full * share
    weight = scheduled
    if loss_warmup > 0:
        joint = step - head_warmup
        weight = F.when(joint < loss_warmup, full * (joint / loss_warmup)).otherwise(weight)
    if head_warmup > 0:
        weight = F.when(step < head_warmup, full).otherwise(weight)
    return weight


def phase(step: Column, head_warmup: int = 0) -> Column:
    """0 while only the head is trained, 1 afterwards."""
    return F.when(step < head_warmup, F.lit(0.0)).otherwise(F.lit(1.0))


def total_loss(ar_loss: Column, fm_loss: Column, weight: Column, phase_flag: Column) -> Column:
    return F.when(phase_flag == 0, weight * fm_loss).otherwise(ar_loss + weight * fm_loss)
