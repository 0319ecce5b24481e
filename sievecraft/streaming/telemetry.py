"""Moving average and gate over a live training log."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sievecraft.operators.telemetry import EMA_DECAY, EMA_FLOOR, GATE_MODES, GATE_THRESHOLD

MAX_WAIT_MS = 10 * 60 * 1000
IDLE_MS = 7 * 24 * 3600 * 1000
BLOCK, GATHERED, OUT_ROWS = 1 << 12, 1 << 20, 1 << 16  # steps of a block; rows taken in, handed on at once
_NONE = np.zeros(0, np.int64), np.zeros(0)

Part = tuple[np.ndarray, np.ndarray, list[float] | None, list[bool] | None]  # steps, values, averages and gates; none of those if late


class GateProcessor(StatefulProcessor):
    """Puts the steps of one run into order and decides the gate of each.

    Steps count up from 0. A step that comes early waits in a buffer until those before
    it are there. What comes after its turn, a repeat or a step given up, is handed on as
    late, without average or decision. Runs that are not ``dense`` leave steps out:
    nothing waits, a batch is taken in order of step, and what a later batch brings of
    earlier steps is late.

    The buffer has one entry for each ``BLOCK`` steps, and many rows are put into it at
    once: a call of the state store costs more than hundreds of steps.

    With an event time, a step that stays away until the watermark is ``max_wait_ms``
    beyond the run's last record is taken for missing, and the buffered ones go on, as
    the batch job does where a step is missing; state and buffer of a run are dropped
    when the watermark is ``idle_ms`` beyond it. Without one they wait and stay.
    """

    def __init__(self, names: tuple[str, str, str, str | None], mode: str, threshold: float, decay: float, head_warmup: int, dense: bool, max_wait_ms: int, idle_ms: int):
        self.dense = dense
        self.names, self.mode, self.threshold, self.decay = names, mode, threshold, decay
        self.head_warmup, self.max_wait_ms, self.idle_ms, self.floor = head_warmup, max_wait_ms, idle_ms, EMA_FLOOR

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "next bigint, seen boolean, ema double, last double, waiting bigint, clock bigint, deadline bigint, idle bigint")
        self.early = handle.getMapState("blocks", "block bigint", "steps binary, values binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self._load()
        due = state["next"]
        take = self._absorb if self.dense else self._follow
        yield from self._frames(key, (part for steps, values in self._gathered(state, rows) for part in take(state, steps, values)))
        self._wait(state, due)
        self._store(state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, at = self._load(), expiredTimerInfo.getExpiryTimeInMs()
        if state["waiting"] and at == state["deadline"]:
            due, state["deadline"] = state["next"], 0
            block = min(k[0] for k in self.early.keys())
            state["next"] = int(self._held(block)[0][0])
            yield from self._frames(key, self._absorb(state, *_NONE))
            self._wait(state, due)
            self._store(state)
        elif at == state["idle"]:
            if state["deadline"]:
                self.handle.deleteTimer(state["deadline"])
            self.early.clear()
            self.known.clear()

    def _gathered(self, state: dict, rows: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Steps and values of a batch, many frames at once. Without a buffer for what comes early it has to be sorted as a whole."""
        _, step, value, time = self.names
        held, n = [], 0
        for frame in rows:
            if time:
                state["clock"] = max(state["clock"], int(frame[time].max().timestamp() * 1000))
            held.append((frame[step].to_numpy(np.int64), frame[value].to_numpy(np.float64)))
            n += len(frame)
            if self.dense and n >= GATHERED:
                yield tuple(np.concatenate(x) for x in zip(*held))
                held, n = [], 0
        if held:
            yield tuple(np.concatenate(x) for x in zip(*held))

    def _follow(self, state: dict, steps: np.ndarray, values: np.ndarray) -> Iterator[Part]:
        steps, values, late = self._sorted(state, steps, values)
        yield from late
        for i in range(0, len(steps), BLOCK):
            yield self._decided(state, steps[i : i + BLOCK], values[i : i + BLOCK])

    def _absorb(self, state: dict, steps: np.ndarray, values: np.ndarray) -> Iterator[Part]:
        steps, values, late = self._sorted(state, steps, values)
        yield from late
        number = steps // BLOCK
        cuts = np.flatnonzero(np.diff(number, prepend=-1)).tolist()
        new = dict(zip(number[cuts].tolist(), map(slice, cuts, [*cuts[1:], len(steps)])))
        block = state["next"] // BLOCK
        while block in new or state["waiting"]:  # blocks that are complete are taken one after the other
            mine = new.pop(block, slice(0, 0))
            yield from self._merge(state, block, steps[mine], values[mine])
            if state["next"] // BLOCK == block:
                break
            block += 1
        for block, mine in new.items():
            yield from self._merge(state, block, steps[mine], values[mine])

    def _sorted(self, state: dict, steps: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[Part]]:
        """Steps that are not past, each once, in order; the others as late."""
        order = np.argsort(steps, kind="stable")
        steps, values = steps[order], values[order]
        late = steps < state["next"]
        late[1:] |= steps[1:] == steps[:-1]
        return steps[~late], values[~late], self._late(steps[late], values[late])

    def _late(self, steps: np.ndarray, values: np.ndarray) -> list[Part]:
        return [(steps[i : i + BLOCK], values[i : i + BLOCK], None, None) for i in range(0, len(steps), BLOCK)]

    def _merge(self, state: dict, block: int, steps: np.ndarray, values: np.ndarray) -> Iterator[Part]:
        """Puts steps of a block, in order, to those that wait; takes what is due and leaves the rest."""
        held, kept = self._held(block) if state["waiting"] else _NONE
        if len(held) and len(steps):
            again = held[np.minimum(np.searchsorted(held, steps), len(held) - 1)] == steps
            yield from self._late(steps[again], values[again])
            every = np.concatenate((held, steps[~again]))
            order = np.argsort(every, kind="stable")
            steps, values = every[order], np.concatenate((kept, values[~again]))[order]
        elif len(held):
            steps, values = held, kept
        due = 0
        if len(steps) and steps[0] == state["next"]:
            due = int(np.argmin(np.append(steps - steps[0] == np.arange(len(steps)), False)))
            yield self._decided(state, steps[:due], values[:due])
            steps, values = steps[due:], values[due:]
        state["waiting"] += len(steps) - len(held)
        if len(steps) and (due or len(steps) > len(held)):
            self.early.updateValue((block,), ((steps - block * BLOCK).astype("<u2").tobytes(), values.astype("<f8").tobytes()))
        elif len(held) and not len(steps):
            self.early.removeKey((block,))

    def _held(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        if not self.early.containsKey((block,)):
            return _NONE
        steps, values = self.early.getValue((block,))
        return np.frombuffer(steps, "<u2").astype(np.int64) + block * BLOCK, np.frombuffer(values, "<f8")

    def _decided(self, state: dict, steps: np.ndarray, values: np.ndarray) -> Part:
        """The average and the gate of steps that follow each other."""
        seen, ema, last = state["seen"], state["ema"], state["last"]
        averages, gates = [], []
        for at, x in zip(steps.tolist(), values.tolist()):
            if not seen or at < self.head_warmup:
                gates.append(False)
            elif self.mode == "static":
                gates.append(last < self.threshold)
            else:
                gates.append(ema >= self.floor and last < ema / self.threshold)
            ema, last, seen = self.decay * ema + (1 - self.decay) * x if seen else x, x, True
            averages.append(ema)
        state |= {"next": int(steps[-1]) + 1, "seen": seen, "ema": ema, "last": last}
        return steps, values, averages, gates

    def _wait(self, state: dict, due: int) -> None:
        """A timer for the step that is missing now, none if nothing waits, and one for the end of the run."""
        if not self.names[3]:
            return
        if state["deadline"] and (not state["waiting"] or state["next"] != due):
            self.handle.deleteTimer(state["deadline"])
            state["deadline"] = 0
        if state["waiting"] and not state["deadline"]:
            state["deadline"] = state["clock"] + self.max_wait_ms
            self.handle.registerTimer(state["deadline"])
        if state["idle"] != state["clock"] + self.idle_ms:
            if state["idle"]:
                self.handle.deleteTimer(state["idle"])
            state["idle"] = state["clock"] + self.idle_ms
            self.handle.registerTimer(state["idle"])

    def _load(self) -> dict:
        names = ("next", "seen", "ema", "last", "waiting", "clock", "deadline", "idle")
        return dict(zip(names, self.known.get() if self.known.exists() else (0, False, 0.0, 0.0, 0, 0, 0, 0)))

    def _store(self, state: dict) -> None:
        self.known.update(tuple(state[c] for c in ("next", "seen", "ema", "last", "waiting", "clock", "deadline", "idle")))

    def _frames(self, key, parts: Iterator[Part]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for part in parts:
            held.append(part)
            n += len(part[0])
            if n >= OUT_ROWS:
                yield self._frame(key, held)
                held, n = [], 0
        if held:
            yield self._frame(key, held)

    def _frame(self, key, parts: list[Part]) -> pd.DataFrame:
        run, step, value, _ = self.names
        late = np.repeat([p[2] is None for p in parts], [len(p[0]) for p in parts])
        gated = np.concatenate([np.zeros(len(p[0]), np.bool_) if p[3] is None else np.array(p[3], np.bool_) for p in parts])
        return pd.DataFrame(
            {
                run: pd.Series([key[0]] * len(late), dtype=object),
                step: np.concatenate([p[0] for p in parts]),
                value: np.concatenate([p[1] for p in parts]),
                "ema": np.concatenate([np.full(len(p[0]), np.nan) if p[2] is None else np.array(p[2], np.float64) for p in parts]),
                "gated": pd.arrays.BooleanArray(gated, late.copy()),
                "late": late,
            }
        )

    def close(self) -> None:
        pass


def stream_gate(
    df: DataFrame,
    run: str,
    step: str,
    value: str,
    mode: str = "dynamic",
    threshold: float = GATE_THRESHOLD,
    decay: float = EMA_DECAY,
    head_warmup: int = 0,
    dense: bool = True,
    event_time: str | None = None,
    delay: str = "1 hour",
    max_wait_ms: int = MAX_WAIT_MS,
    idle_ms: int = IDLE_MS,
) -> DataFrame:
    """(run, step, value, ema, gated, late) of every record, the state kept per run.

    Records may come in any order, within a batch and from batch to batch; see
    ``GateProcessor`` for what waits, what is late, and how long a run is remembered.
    With ``event_time``, records more than ``delay`` behind the newest are dropped. Needs
    the RocksDB state store. A row without run or step raises.
    """
    if mode not in GATE_MODES:
        raise ValueError(f"unknown gate mode: {mode}")
    checked = [F.when(F.col(c).isNull(), F.raise_error(F.lit("a row without run or step"))).otherwise(F.col(c)) for c in (run, step)]
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    timed = df if event_time is None else df.withWatermark(event_time, delay)
    columns = [checked[0].alias(run), checked[1].cast("bigint").alias(step), F.col(value).cast("double").alias(value)]
    return (
        timed.select(*columns, *([event_time] if event_time else []))
        .groupBy(run)
        .transformWithStateInPandas(
            GateProcessor((run, step, value, event_time), mode, threshold, decay, head_warmup, dense, max_wait_ms, idle_ms),
            f"`{run}` {types[run]}, `{step}` bigint, `{value}` double, ema double, gated boolean, late boolean",
            "Append",
            "EventTime" if event_time else "None",
        )
    )
