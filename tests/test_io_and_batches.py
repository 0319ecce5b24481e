import collections
import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sievecraft.operators.ordering import holdout_split, number_rows, sample_cap, sample_order, sort_by_id
from sievecraft.operators.reshape import (
    assign_batches,
    flatten_assets,
    pad_batches,
    split_target_reference,
    unpivot_pairs,
)
from sievecraft.sources.corpus import SEQ, read_corpus, read_if_exists, read_jsonl, read_prompt
from sievecraft.sources.sinks import write_json_array, write_jsonl
from workloads.batches import q_corpus_scan, q_optional_column_scan


def test_corpus_scan(spark, tmp_path):
    for i, name in enumerate(["train-1", "train-0", "other"]):
        spark.range(i * 10, i * 10 + 5).coalesce(1).write.parquet(str(tmp_path / "raw" / name))
        part = [f for f in os.listdir(tmp_path / "raw" / name) if f.endswith(".parquet")][0]
        os.makedirs(tmp_path / "in", exist_ok=True)
        with open(tmp_path / "raw" / name / part, "rb") as src, open(tmp_path / "in" / f"{name}.parquet", "wb") as dst:
            dst.write(src.read())
    rows = read_corpus(spark, str(tmp_path / "in")).orderBy(*SEQ).collect()
    assert [r.id for r in rows] == [10, 11, 12, 13, 14, 0, 1, 2, 3, 4]
    assert [r.seq_row for r in rows] == [0, 1, 2, 3, 4] * 2
    extra = read_corpus(spark, str(tmp_path / "in"), "*.parquet", "id bigint, starter_code string")
    assert extra.count() == 15 and extra.where("starter_code IS NOT NULL").count() == 0


def test_a_corpus_file_may_be_a_folder_of_parts(spark, tmp_path):
    for i, n in enumerate((5, 3)):
        spark.range(i * 5, i * 5 + n).selectExpr("id AS doc_id", "repeat('x', cast(id AS int)) AS text").coalesce(1).write.mode("append").parquet(str(tmp_path / "documents.parquet"))
    rows = read_corpus(spark, str(tmp_path), "documents*.parquet")
    assert sorted((r.doc_id, r.file_name) for r in rows.collect()) == [(i, "documents.parquet") for i in range(8)]
    assert q_optional_column_scan(spark, str(tmp_path)).count() == 8
    scan = q_corpus_scan(spark, str(tmp_path)).collect()
    assert sorted(r.seq_row for r in scan) == list(range(8)) and {r.file_name for r in scan} == {"documents.parquet"}
    assert all(r.text_length == r.doc_id for r in scan)


def test_jsonl(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([("é漢", None), ("b\n", "x")], "a string, b string")
    write_jsonl(df, path)
    lines = [x for f in os.listdir(path) if f.startswith("part") for x in open(f"{path}/{f}", encoding="utf-8").read().splitlines()]
    assert any("é漢" in x for x in lines)
    assert sorted((json.loads(x)["a"], json.loads(x)["b"]) for x in lines if x.strip() and "null" in x) == [("é漢", None)]
    assert sorted(map(tuple, read_jsonl(spark, path, "a string, b string", ["a"]).collect())) == [("b\n", "x"), ("é漢", None)]
    with pytest.raises(PySparkException):
        read_jsonl(spark, path, "a string, b string", ["b"]).collect()


def test_jsonl_blank_and_bad_lines(spark, tmp_path):
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text('{"a": "1"}\n\n   \n{"a": "2"}\n', encoding="utf-8")
    bad.write_text('{"a": "1"}\n{oops\n', encoding="utf-8")
    assert read_jsonl(spark, str(good), "a string").count() == 2
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        read_jsonl(spark, str(bad), "a string").collect()


def test_prompt_and_missing_table(spark, tmp_path):
    f = tmp_path / "prompt.md"
    f.write_text("\n You are.\nTwo lines 　\n", encoding="utf-8")
    assert read_prompt(spark, str(f)) == "You are.\nTwo lines"
    assert read_if_exists(spark, str(tmp_path / "nothing")) is None


@pytest.mark.parametrize("rows", [0, 1, 2, 300])
def test_json_array_parts_concatenate(spark, tmp_path, rows):
    path = str(tmp_path / "array")
    df = spark.range(rows).select(
        F.concat(F.lit("q"), F.col("id") % 10).alias("id"), F.col("id").alias("seq"), F.lit(None).cast("string").alias("n"),
        F.array(F.struct(F.lit("é\n").alias("role"))).alias("m"),
    )
    write_json_array(df.repartition(5), path, ["id", "seq"])
    text = "".join(open(f"{path}/{f}", encoding="utf-8").read() for f in sorted(os.listdir(path)) if f.startswith("part"))
    got = json.loads(text)
    assert [(x["id"], x["seq"]) for x in got] == sorted((f"q{i % 10}", i) for i in range(rows))
    assert all(x["n"] is None and x["m"] == [{"role": "é\n"}] for x in got)


def test_orders(spark):
    df = spark.range(200).select(F.col("id").alias("seq"), (F.col("id") % 7).cast("string").alias("id"))
    got = [(r.id, r.seq) for r in sort_by_id(df.repartition(9), "id", ["seq"]).collect()]
    assert got == sorted(got)
    a = [r.seq for r in sample_order(df, "seq", 1).collect()]
    b = [r.seq for r in sample_order(df.repartition(3), "seq", 1).collect()]
    c = [r.seq for r in sample_order(df, "seq", 2).collect()]
    assert a == b != c and sorted(a) == sorted(c) == list(range(200))
    assert [r.seq for r in sample_order(df, "seq", 1, shuffled=False).collect()] == list(range(200))


def test_cap(spark):
    df = spark.range(100).select((F.col("id") % 10).alias("f"), F.floor(F.col("id") / 10).alias("r"))
    for n in (0, 1, 15, 100, 1000):
        got = sorted((r.f, r.r) for r in sample_cap(df, ["f", "r"], n).collect())
        assert got == sorted((i % 10, i // 10) for i in range(100))[:n]


def test_split(spark):
    df = holdout_split(spark.range(5000), "id", 0.1, 3)
    held = {r.id for r in df.where("split = 'validation'").collect()}
    assert 400 < len(held) < 600
    assert held == {r.id for r in holdout_split(spark.range(5000).repartition(7), "id", 0.1, 3).where("split = 'validation'").collect()}


def test_number_rows(spark):
    values = [x * x % 100003 for x in range(0, 400)]
    df = spark.createDataFrame([(v,) for v in set(values)], "seq bigint")
    got = {r.seq: r.row_number for r in number_rows(df, "seq").collect()}
    assert got == {v: i for i, v in enumerate(sorted(set(values)))}


def test_rows_are_numbered_by_file_and_row(spark):
    rows = [(f"file{f}", r, None if r % 3 else "x") for f in (2, 0, 1) for r in range(300 - 100 * f)]
    df = spark.createDataFrame(rows, "file string, row long, pay string").repartition(7)
    want = {key: i for i, key in enumerate(sorted((f, r) for f, r, _ in rows))}
    numbered = number_rows(df, ["file", "row"])
    assert numbered.columns == ["file", "row", "pay", "row_number"]
    assert {(r.file, r.row): r.row_number for r in numbered.collect()} == want
    batches = assign_batches(df, ["file", "row"], 64).collect()
    assert all(r.batch == want[r.file, r.row] // 64 for r in batches)
    for n in (0, 1, 299, 300, 301, 600, 1000):
        assert {(r.file, r.row) for r in sample_cap(df, ["file", "row"], n).collect()} == {k for k, i in want.items() if i < n}
    assert number_rows(df.limit(0), ["file", "row"]).count() == 0


def test_one_group_of_most_rows_is_numbered_over_many_ranges(spark):
    rows = [(g, v) for g in range(20) for v in range(3)] + [(7, v) for v in range(3, 5000)] + [(21, 5)] * 4
    df = spark.createDataFrame(rows, "g int, v int").repartition(5)
    numbered = number_rows(df, "v", "rank", by=["g"])
    got = collections.defaultdict(list)
    for r in numbered.collect():
        got[r.g].append((r.v, r.rank))
    assert sorted(got[7]) == [(v, v) for v in range(5000)]
    assert sorted(got[21]) == [(5, k) for k in range(4)]
    assert all(sorted(got[g]) == [(0, 0), (1, 1), (2, 2)] for g in range(20) if g != 7)
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "BroadcastHashJoin" in plan


TOKENS = "input_ids array<int>, attention_mask array<int>, labels array<int>"


def test_pairs_and_references(spark):
    pairs = spark.createDataFrame(
        [(0, [1], [1], [2], [3, 4], [1, 1], [5, 6], None)],
        "seq int, chosen_input_ids array<int>, chosen_attention_mask array<int>, chosen_labels array<int>, "
        "rejected_input_ids array<int>, rejected_attention_mask array<int>, rejected_labels array<int>, images array<string>",
    )
    both = unpivot_pairs(pairs.union(pairs.withColumn("seq", F.lit(1))), "seq").orderBy("side", "seq").collect()
    assert [(r.side, r.seq, r.labels) for r in both] == [(0, 0, [2]), (0, 1, [2]), (1, 0, [5, 6]), (1, 1, [5, 6])]
    refs = spark.createDataFrame(
        [([1], [1], [2], [3], [1], [4], ["i"], True)],
        TOKENS + ", kl_input_ids array<int>, kl_attention_mask array<int>, kl_labels array<int>, images array<string>, kto_tags boolean",
    )
    r = split_target_reference(refs).first()
    assert (r.target.labels, r.reference.labels, r.reference.images, r.kto_tags) == ([2], [4], ["i"], True)


def test_batches(spark):
    rows = [(i * 3, list(range(i)), [1] * i, [-100] * i, ["a"] * (i % 3) if i % 4 else None) for i in range(11)]
    df = spark.createDataFrame(rows, "seq bigint, " + TOKENS + ", images array<string>")
    batched = assign_batches(df, "seq", 4)
    padded = {r.seq: r for r in pad_batches(batched).collect()}
    for i, (seq, ids, mask, labels, _) in enumerate(rows):
        r = padded[seq]
        longest = max(len(x[1]) for x in rows[i // 4 * 4 : i // 4 * 4 + 4])
        size = -(-longest // 8) * 8
        assert r.batch == i // 4 and r.padded_length == size
        assert r.input_ids == ids + [0] * (size - i) and r.labels == labels + [-100] * (size - i)
        assert r.attention_mask == mask + [0] * (size - i)
    left = {r.seq: r.input_ids for r in pad_batches(batched, left=True).collect()}
    assert left[3] == [0] * 7 + [0]
    flat = {r.batch: r for r in flatten_assets(batched, "seq", ("images",)).collect()}
    for b in range(3):
        lists = [x[4] or [] for x in rows[b * 4 : b * 4 + 4]]
        assert flat[b].images == sum(lists, []) and flat[b].images_counts == [len(x) for x in lists]
