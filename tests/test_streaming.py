import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievecraft.functions.text import strip_key
from sievecraft.operators.quality import keep_verified, passing_instructions
from sievecraft.operators.records import to_chat_records
from sievecraft.plans.instructions import best_rank, curate_instructions
from sievecraft.session import shared_path
from sievecraft.sources.commits import CommitLog
from sievecraft.streaming.curation import stream_corpus, stream_keep_first
from sievecraft.streaming.telemetry import GateProcessor, stream_gate
from sievecraft.streaming.winners import merge_winners, upsert_winners, winners
from tests.test_curation import REASONING, instruction_df
from tests.test_telemetry import gates
from workloads.streams import q_stream_gate, q_stream_gate_disordered


def drain(spark, df, name):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).collect()


def write_files(df, path, files):
    """``files`` files, written one after the other."""
    for i in range(files):
        df.where(F.col("seq") % files == i).coalesce(1).write.mode("append").parquet(path)


def test_stateless_stages_take_a_stream(spark, tmp_path):
    rows = [(i, f"q{i}", True, i % 2 == 0, f"question {i}", "r", None, None) for i in range(20)]
    df = spark.createDataFrame(rows, REASONING)
    write_files(df, str(tmp_path / "in"), 2)
    stream = stream_corpus(spark, str(tmp_path / "in"), df.schema, "*.parquet")
    got = drain(spark, to_chat_records(keep_verified(stream)), "stateless")
    assert sorted(r.id for r in got) == sorted(r.id for r in to_chat_records(keep_verified(df)).collect())


def test_a_stream_of_a_table_that_is_a_folder(spark, tmp_path):
    df = spark.range(30).select(F.col("id").alias("seq"), F.lit("t").alias("t"))
    write_files(df, str(tmp_path / "documents.parquet"), 3)
    stream = stream_corpus(spark, str(tmp_path), df.schema, "documents*.parquet", files_per_trigger=1)
    assert sorted(r.seq for r in drain(spark, stream, "foldered")) == list(range(30))


def test_the_gate_queries_need_no_setting_of_the_session(spark, tmp_path):
    """Without one Spark keeps state where the gate cannot."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    events = spark.range(64).selectExpr(
        "id AS event_id", "timestamp_seconds(id) AS ts", "id AS user_id", "if(id % 8 < 4, 'a', 'b') AS event_type", "id * 1.0 AS value", "'{\"k\": 1}' AS props"
    )
    events.write.parquet(str(tmp_path / "events.parquet"))
    spark.conf.unset(name)
    try:
        assert q_stream_gate(spark, str(tmp_path)).count() == 64
        assert q_stream_gate_disordered(spark, str(tmp_path)).count() == 64
        assert "HDFSBacked" in spark.conf.get(name)
    finally:
        spark.conf.set(name, before)


def test_keep_first_per_key_across_batches(spark, tmp_path):
    df = spark.range(60).select(F.col("id").alias("seq"), (F.col("id") % 7).cast("string").alias("t"))
    write_files(df, str(tmp_path / "in"), 4)
    stream = stream_corpus(spark, str(tmp_path / "in"), df.schema, "*.parquet", files_per_trigger=1)
    assert sorted(r.t for r in drain(spark, stream_keep_first(stream, F.col("t")), "firsts")) == list("0123456")


def test_keep_first_within_watermark(spark, tmp_path):
    df = spark.range(20).select(
        F.col("id").alias("seq"), (F.col("id") % 3).alias("k"), F.timestamp_seconds(F.col("id") * 60).alias("ts")
    )
    write_files(df, str(tmp_path / "in"), 1)
    stream = stream_corpus(spark, str(tmp_path / "in"), df.schema, "*.parquet")
    assert sorted(r.k for r in drain(spark, stream_keep_first(stream, F.col("k"), "ts", "1 day"), "marked")) == [0, 1, 2]


def _instructions(spark, seed, start=0, count=200):
    rng = random.Random(seed)
    rows = [(start + i, f"q{rng.randint(0, 9)}", "x" * rng.randint(0, 5), rng.choice([4, 5])) for i in range(count)]
    return instruction_df(spark, rows)


def _upsert(spark, path, table, state, schema, run=None):
    stream = stream_corpus(spark, path, schema, "*.parquet", files_per_trigger=1)
    key = strip_key(F.col("input"))
    upsert_winners(passing_instructions(stream, "seq"), key, best_rank(), ["seq"], table, state, run, buckets=4).awaitTermination()
    return {r.seq for r in winners(spark, table).collect()}


def test_keep_best_equals_the_batch_job(spark, tmp_path):
    """After every drain, over restarts; the table keeps one row a key however many batches came."""
    path, table, state = str(tmp_path / "in"), shared_path(spark, "best"), shared_path(spark, "state")
    first, second = _instructions(spark, 8), _instructions(spark, 9, 200, 100)
    write_files(first, path, 5)
    assert _upsert(spark, path, table, state, first.schema) == {r.seq for r in curate_instructions(first, ["seq"]).collect()}
    write_files(second, path, 3)
    both = first.unionByName(second)
    want = {r.seq for r in curate_instructions(both, ["seq"]).collect()}
    assert _upsert(spark, path, table, state, first.schema) == want
    assert len(want) <= 10 and winners(spark, table).count() == len(want)
    number, latest = CommitLog(spark, f"{table}/_commits").latest()
    assert number == 7 and len(latest["versions"]) <= 4
    # a drain without news, and one whose checkpoint was lost, change nothing
    assert _upsert(spark, path, table, state, first.schema) == want
    assert CommitLog(spark, f"{table}/_commits").latest()[0] == 7
    assert _upsert(spark, path, table, shared_path(spark, "state"), first.schema, "after the loss") == want


def test_a_replayed_batch_changes_nothing(spark):
    table, key = shared_path(spark, "best"), F.col("input")
    batch = passing_instructions(_instructions(spark, 3), "seq")
    for _ in range(2):
        merge_winners(batch, 0, "run", key, best_rank(), ["seq"], table, 4)
        assert CommitLog(spark, f"{table}/_commits").latest()[0] == 0
    merge_winners(batch.limit(0), 1, "run", key, best_rank(), ["seq"], table, 4)
    assert winners(spark, table).count() == batch.select("input").distinct().count()
    with pytest.raises(FileNotFoundError):
        winners(spark, shared_path(spark, "none"))


def test_two_queries_write_one_table(spark, monkeypatch):
    """The second writer commits between the first one's read and its commit."""
    table, key = shared_path(spark, "best"), F.col("input")
    one, two = (passing_instructions(_instructions(spark, seed, start), "seq") for seed, start in ((4, 0), (5, 1000)))
    merge_winners(one, 0, "one", key, best_rank(), ["seq"], table, 4)
    commit, calls = CommitLog.commit, []

    def raced(self, number, value):
        if not calls:
            calls.append(number)
            merge_winners(two, 0, "two", key, best_rank(), ["seq"], table, 4)
        return commit(self, number, value)

    monkeypatch.setattr(CommitLog, "commit", raced)
    three = passing_instructions(_instructions(spark, 6, 2000), "seq")
    merge_winners(three, 1, "one", key, best_rank(), ["seq"], table, 4)
    every = one.unionByName(two).unionByName(three)
    from sievecraft.operators.dedup import keep_best

    want = sorted(r.seq for r in keep_best(every, key, best_rank(), ["seq"]).collect())
    assert sorted(r.seq for r in winners(spark, table).collect()) == want
    assert CommitLog(spark, f"{table}/_commits").latest()[1]["runs"] == {"one": 1, "two": 0}


def test_a_number_is_taken_once(spark):
    log = CommitLog(spark, shared_path(spark, "log"))
    assert log.latest() == (-1, {}) and log.commit(0, {"a": "é"}) and not log.commit(0, {"a": 2})
    assert log.latest() == (0, {"a": "é"}) and log.commit(1, {}) and log.numbers() == [0, 1]


@pytest.mark.parametrize("mode,threshold", [("dynamic", 1.5), ("static", 0.4)])
def test_gate_carries_its_state(spark, tmp_path, mode, threshold):
    rng = random.Random(1)
    runs = {"a": [rng.random() for _ in range(90)], "b": [0.5] * 3}
    for part in range(3):
        rows = [(r, s, x) for r, v in runs.items() for s, x in enumerate(v) if s * 3 // len(v) == part]
        rng.shuffle(rows)
        spark.createDataFrame(rows, "run string, step bigint, loss double").coalesce(1).write.mode("append").parquet(
            str(tmp_path / "in")
        )
    got = _gates(spark, tmp_path, mode, threshold)
    for run, values in runs.items():
        for step, (ema, gated) in enumerate(zip(*gates(values, 0.9, mode, threshold, 5))):
            assert got[run, step] == (pytest.approx(ema), gated, False)


def _gates(spark, tmp_path, mode="dynamic", threshold=1.5):
    """Everything the query has written after one more drain."""
    stream = stream_corpus(spark, str(tmp_path / "in"), LOG, "*.parquet", 1)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    rows = stream_gate(stream, "run", "step", "loss", mode, threshold, 0.9, 5)
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return {(r.run, r.step): (r.ema, r.gated, r.late) for r in spark.read.parquet(out).where("NOT late").collect()}


LOG = "run string, step bigint, loss double"


def test_gate_puts_swapped_steps_in_order_across_batches_and_restarts(spark, tmp_path):
    rng = random.Random(2)
    values = [rng.random() for _ in range(120)]
    steps = list(range(120))
    for start in range(0, 120, 30):  # steps move by up to 30 places, over the borders of files
        rng.shuffle(steps[start : start + 30])
    steps = steps[60:90] + steps[:30] + steps[90:] + steps[30:60]
    want = list(zip(*gates(values, 0.9, "dynamic", 1.5, 5)))
    for part in range(4):
        mine = steps[part * 30 : part * 30 + 30]
        rows = [("r", s, values[s]) for s in mine] + ([("r", 0, 9.9)] if part == 3 else [])
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = _gates(spark, tmp_path)  # a new start of the query each time
        assert len(got) == (0, 30, 30, 120)[part] or part == 2 and len(got) == 30
    assert got == {("r", s): (pytest.approx(e), g, False) for s, (e, g) in enumerate(want)}
    late = spark.read.parquet(str(tmp_path / "out")).where("late").collect()
    assert [(r.step, r.loss, r.ema, r.gated) for r in late] == [(0, 9.9, None, None)]


class Store:
    """State of one key in memory, with the calls that the processor makes."""

    def __init__(self):
        self.value, self.map, self.timers = None, {}, set()

    def getValueState(self, *_):
        return self

    def getMapState(self, *_):
        return Entries(self.map)

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class Entries:
    def __init__(self, entries):
        self.entries = entries

    def containsKey(self, key):
        return key in self.entries

    def getValue(self, key):
        return self.entries[key]

    def updateValue(self, key, value):
        self.entries[key] = value

    def removeKey(self, key):
        del self.entries[key]

    def keys(self):
        return iter(list(self.entries))

    def clear(self):
        self.entries.clear()


class Clock:
    def __init__(self, now):
        self.now = now

    def getExpiryTimeInMs(self):
        return self.now


def test_a_missing_step_is_given_up_after_its_time():
    values = {0: 0.5, 1: 0.4, 3: 0.9, 4: 0.1, 7: 0.2}
    processor, store = GateProcessor(("run", "step", "loss", "ts"), "dynamic", 1.5, 0.9, 0, True, 1000, 50000), Store()
    processor.init(store)

    def feed(steps, now):
        frame = pd.DataFrame({"step": steps, "loss": [values.get(s, 7.0) for s in steps], "ts": [pd.Timestamp(now, unit="ms")] * len(steps)})
        return [tuple(r) for part in processor.handleInputRows(("r",), iter([frame]), None) for r in part[["step", "late"]].itertuples(index=False)]

    def expire(at):
        store.timers.discard(at)
        return [r for part in processor.handleExpiredTimer(("r",), None, Clock(at)) for r in part.itertuples(index=False)]

    assert feed([4, 0, 3], 100) == [(0, False)] and store.timers == {1100, 50100}
    assert feed([1], 600) == [(1, False)] and store.timers == {1600, 50600}  # the gap is another one now
    assert feed([7, 7], 700) == [(7, True)] and store.timers == {1600, 50700}
    rows = expire(1600)
    assert [r.step for r in rows] == [3, 4] and store.timers == {1700, 50700}  # and now 5 is missed
    assert feed([2], 800) == [(2, True)]
    rows += expire(1700)
    assert store.timers == {50800} and feed([8], 900) == [(8, False)]
    want = list(zip(*gates([values[s] for s in sorted(values)], 0.9, "dynamic", 1.5, 0)))[2:]
    assert [(r.ema, r.gated) for r in rows] == [(pytest.approx(e), g) for e, g in want]
    assert expire(50900) == [] and store.value is None and store.map == {}


class CountedEntries(Entries):
    calls = 0

    def containsKey(self, key):
        CountedEntries.calls += 1
        return super().containsKey(key)

    def updateValue(self, key, value):
        CountedEntries.calls += 1
        super().updateValue(key, value)


def test_steps_that_wait_take_few_calls_of_the_state_store():
    """Steps of a long run, dealt at random to three batches of several frames; one comes again each time."""
    rng, n = random.Random(3), 30000
    values, steps = [rng.random() for _ in range(n)], list(range(n))
    rng.shuffle(steps)
    store = Store()
    store.getMapState = lambda *_: CountedEntries(store.map)
    processor = GateProcessor(("run", "step", "loss", None), "dynamic", 1.5, 0.9, 5, True, 0, 0)
    processor.init(store)
    CountedEntries.calls, rows = 0, []
    for part in range(3):
        mine = [(s, values[s]) for s in steps[part::3]] + [(steps[0], 7.0)]
        frames = [pd.DataFrame(mine[i : i + 3000], columns=["step", "loss"]) for i in range(0, len(mine), 3000)]
        rows += [r for out in processor.handleInputRows(("r",), iter(frames), None) for r in out.itertuples(index=False)]
    want = list(zip(*gates(values, 0.9, "dynamic", 1.5, 5)))
    taken = [r for r in rows if not r.late]
    assert [r.step for r in taken] == list(range(n)) and [r.loss for r in taken] == values
    assert [(r.ema, r.gated) for r in taken] == [(pytest.approx(e), g) for e, g in want]
    assert [(r.step, r.loss) for r in rows if r.late] == [(steps[0], 7.0)] * 3 and store.map == {}
    assert CountedEntries.calls < n // 100


def test_a_step_that_waits_and_comes_again_with_its_turn():
    processor, store = GateProcessor(("run", "step", "loss", None), "dynamic", 1.5, 0.9, 0, True, 0, 0), Store()
    processor.init(store)
    rows = []
    for steps, losses in (([2], [0.2]), ([2, 0, 1], [9.0, 0.5, 0.4])):
        frame = pd.DataFrame({"step": steps, "loss": losses})
        rows += [(r.step, r.loss, r.late) for out in processor.handleInputRows(("r",), iter([frame]), None) for r in out.itertuples(index=False)]
    assert sorted(rows) == [(0, 0.5, False), (1, 0.4, False), (2, 0.2, False), (2, 9.0, True)] and store.map == {}


def test_runs_that_leave_steps_out_do_not_wait():
    values = {2: 0.5, 3: 0.1, 9: 0.9, 11: 0.2}
    processor = GateProcessor(("run", "step", "loss", None), "dynamic", 1.5, 0.9, 0, False, 0, 0)
    processor.init(Store())

    def feed(*frames):
        frames = [pd.DataFrame({"run": "r", "step": steps, "loss": [values.get(s, 7.0) for s in steps]}) for steps in frames]
        return [r for part in processor.handleInputRows(("r",), iter(frames), None) for r in part.itertuples(index=False)]

    rows = feed([9, 2], [3]) + feed([11])
    assert [r.step for r in rows] == [2, 3, 9, 11] and not any(r.late for r in rows)
    assert [(r.ema, r.gated) for r in rows] == [(pytest.approx(e), g) for e, g in zip(*gates([values[s] for s in sorted(values)], 0.9, "dynamic", 1.5, 0))]
    assert [(r.step, r.late) for r in feed([9, 12])] == [(9, True), (12, False)]


def test_gaps_close_with_the_watermark(spark, tmp_path):
    """Step 2 never comes; once later records of another run move the watermark, 3 and 4 are decided."""
    schema = "run string, step bigint, loss double, ts timestamp"
    for rows in ([("a", s, 0.5, f"2024-01-01 00:0{s}:00") for s in (0, 1, 4, 3)], [("b", 0, 0.5, "2024-01-01 05:00:00")], [("b", 1, 0.5, "2024-01-01 05:01:00")]):
        df = spark.createDataFrame(rows, "run string, step bigint, loss double, ts string").withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = stream_corpus(spark, str(tmp_path / "in"), schema, "*.parquet", 1)
    rows = drain(spark, stream_gate(stream, "run", "step", "loss", event_time="ts", delay="1 minute", max_wait_ms=60000), "gaps")
    assert sorted((r.run, r.step) for r in rows) == [("a", 0), ("a", 1), ("a", 3), ("a", 4), ("b", 0), ("b", 1)]
    assert not any(r.late for r in rows)


def test_gate_needs_run_and_step(spark, tmp_path):
    spark.createDataFrame([("r", None, 1.0)], LOG).write.parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="without run or step"):
        _gates(spark, tmp_path)
    with pytest.raises(ValueError, match="unknown gate mode"):
        stream_gate(spark.createDataFrame([], LOG), "run", "step", "loss", "other")
