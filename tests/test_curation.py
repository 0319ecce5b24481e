import glob
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from sievecraft.functions.chat import assistant_content, user_content
from sievecraft.functions.judgement import all_tests_pass, judge_pass, judge_scores, scores_pass
from sievecraft.functions.text import ngram_fingerprint, strip_key
from sievecraft.operators.dedup import dedup_report, keep_best, keep_first, winners_by_rank
from sievecraft.operators.profile import length_profile, token_totals
from sievecraft.operators.quality import (
    file_report,
    fill_texts,
    filter_funnel,
    keep_verified,
    score_instructions,
    with_reject_reason,
)
from sievecraft.operators.records import to_messages
from sievecraft.plans.instructions import best_rank, curate_instructions, export_instructions
from sievecraft.plans.reasoning import curate_counted, curate_reasoning, export_reasoning, profile_records
from sievecraft.session import shared_path
from sievecraft.sources.corpus import SEQ, read_corpus
from workloads import curation


def judgement(req=5, logic=5, edge=4, **more):
    return json.dumps(
        {
            "requirement_conformance": {"score": req, "justification": "a {b} [c]"},
            "logical_correctness": {"score": logic},
            "edge_case_consideration": {"score": edge},
            **more,
        }
    )


GOOD = judgement()
JUDGE_CASES = [
    (GOOD, True),
    (judgement(5.5, 6, 4.5), True),
    (judgement(edge=3), False),
    (judgement(req=4), False),
    (judgement(logic=4.9), False),
    (judgement(edge="5"), False),
    (judgement(edge=None), False),
    (judgement(edge=True), False),
    (judgement(req=float("nan")), True),
    (judgement(logic=float("inf"), edge=float("inf")), True),
    (judgement(req=float("-inf")), False),
    (judgement(req="NaN"), False),
    (judgement(edge="Infinity"), False),
    (judgement(logic=float("nan"), edge="Infinity"), False),
    (GOOD + '],"v":[' + GOOD, False),
    (GOOD + "," + GOOD, False),
    (GOOD + "]}", False),
    (judgement(req=4) + '],"v":[{"_mark":"x"},' + GOOD + ',{"_mark":"x"}],"w":[', False),
    ('{"requirement_conformance": {"score": 5}, "logical_correctness": {"score": 5}}', False),
    ("not json", False),
    ("", False),
    (None, False),
    (GOOD + " junk", False),
    (GOOD + GOOD, False),
    (GOOD + "," + GOOD, False),
    (GOOD + "}", False),
    (GOOD + "]", False),
    (GOOD[:-1], False),
    ("[" + GOOD + "]", False),
    (GOOD.replace('"', "'"), False),
    (" " + GOOD + "\n", True),
    (GOOD.replace('"score": 4', '"score": 1, "score": 4'), True),
]
STATUS_CASES = [
    ('["pass", "pass"]', True),
    ("[]", True),
    (" [ ] ", True),
    ('["pass", "fail"]', False),
    ('["pass", null]', False),
    ("['pass']", False),
    ('["pass"] x', False),
    ('["pass"]]', False),
    ('["pass"], ["pass"]', False),
    ("{}", False),
    ('""', False),
    ("null", False),
    ("[1]", False),
    (None, False),
    ("[", False),
]


def test_judge_scores(spark):
    df = spark.createDataFrame([(j, i) for i, (j, _) in enumerate(JUDGE_CASES)], "j string, i int")
    got = {r.i: r.p for r in df.select("i", scores_pass(judge_scores(F.col("j"))).alias("p")).collect()}
    for i, (j, want) in enumerate(JUDGE_CASES):
        assert got[i] is want, j


def test_statuses(spark):
    df = spark.createDataFrame([(s, i) for i, (s, _) in enumerate(STATUS_CASES)], "s string, i int")
    got = {r.i: r.p for r in df.select("i", all_tests_pass(F.col("s")).alias("p")).collect()}
    for i, (s, want) in enumerate(STATUS_CASES):
        assert got[i] is want, s


def instruction_df(spark, rows):
    """rows: (id, input, output, edge)"""
    full = [(i, str(i), q, o, "d", "g", judgement(edge=e), '["pass"]') for i, q, o, e in rows]
    return spark.createDataFrame(
        full,
        "seq bigint, id string, input string, output string, domain string, generation_algorithm string, "
        "llm_judgement string, tests_execution_status string",
    )


def test_keep_best_golden(spark):
    rows = [
        (0, "q1", "long answer", 4), (1, "\tq1　", "longer answer", 5), (2, "q1 ", "short", 4),
        (3, "q2", "0123456789", 5), (4, "q2", "012345678", 5),
        (5, "q3", "abc", 4), (6, " q3", "xyz", 4),
        (7, "q4", "x", 3), (8, None, "x", 5),
    ]
    got = {r.seq for r in curate_instructions(instruction_df(spark, rows), ["seq"]).collect()}
    assert got == {1, 4, 5}


def check_winners(rows, kept):
    """One row per stripped input is kept; nothing of its group beats it or equals it earlier."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1].strip(), []).append(row)
    for members in groups.values():
        (winner,) = (m for m in members if m[0] in kept)
        top = [m for m in members if m[3] == max(x[3] for x in members)]
        shortest = min(len(m[2]) for m in top)
        assert winner[0] == min(m[0] for m in top if len(m[2]) == shortest)
    assert len(kept) == len(groups)


@pytest.mark.parametrize("partitions", [1, 7])
def test_keep_best_equals_sequential_model(spark, partitions):
    rng = random.Random(5)
    rows = [
        (i, rng.choice(["hot"] * 3 + ["a", "b ", " b", "c\n"]), "x" * rng.randint(0, 4), rng.choice([4, 5, 4.5]))
        for i in range(600)
    ]
    df = instruction_df(spark, rows).repartition(partitions)
    check_winners(rows, {r.seq for r in curate_instructions(df, ["seq"]).collect()})


def test_keep_best_is_idempotent(spark):
    rows = [(i, f"q{i % 7}", "x" * (i % 3), 4 + i % 2) for i in range(50)]
    df = score_instructions(instruction_df(spark, rows))
    once = keep_best(df, strip_key(F.col("input")), best_rank(), ["seq"])
    twice = keep_best(once, strip_key(F.col("input")), best_rank(), ["seq"])
    assert sorted(r.seq for r in once.collect()) == sorted(r.seq for r in twice.collect())


def test_keep_first_single_and_composite_position(spark):
    rows = [(f"f{i % 3}", i // 3, f"w{i % 11} a b c d e") for i in range(60)]
    df = spark.createDataFrame(rows, "file string, row int, t string")
    key = ngram_fingerprint(F.col("t"))
    first = {}
    for f, r, t in sorted(rows):
        first.setdefault(t, (f, r))
    got = {(r.file, r.row) for r in keep_first(df, key, ["file", "row"]).collect()}
    assert got == set(first.values())
    one = df.withColumn("pos", F.concat("file", F.lpad(F.col("row").cast("string"), 3, "0")))
    assert {(r.file, r.row) for r in keep_first(one, key, ["pos"]).collect()} == got


def test_dedup_reduces_before_the_shuffle(spark):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("k"), F.uuid().alias("payload"))
    plan = winners_by_rank(df, F.col("k"), [], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert "payload" not in plan


def test_dedup_report(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    assert tuple(dedup_report(df, F.col("k")).first()) == (3, 2, 1)
    assert tuple(dedup_report(df.limit(0), F.col("k")).first()) == (0, 0, 0)


REASONING = "seq bigint, question_id string, verified boolean, is_passed boolean, question string, response string, code string, starter_code string"


def test_reject_reasons_and_funnel(spark):
    rows = [
        (0, "a", None, True, "q", "r", None, None),
        (1, "b", False, False, "q", "r", None, None),
        (2, "c", True, None, "q", "r", None, None),
        (3, "d", True, True, "q", "x" * 64003, None, None),
        (4, "e", True, True, "q", "x" * 64004, None, None),
        (5, "f", True, True, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, REASONING)
    reasons = {r.seq: r.reason for r in with_reject_reason(df).collect()}
    assert reasons == {0: "not_verified", 1: "not_verified", 2: "not_passed", 3: None, 4: "cot_too_long", 5: None}
    assert {r.seq for r in keep_verified(df).collect()} == {3, 5}
    assert tuple(filter_funnel(df).first()) == (6, 2, 1, 1, 2)
    kept = keep_verified(df).where("seq = 5").first()
    assert (kept.question, kept.response, kept.code, kept.starter_code) == ("", "", "", "")


def test_flags_reach_the_reader(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.createDataFrame([(0, "a", True, True, "q", "r", "c", "s")], REASONING).write.parquet(path)
    plan = keep_verified(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("]")[0]
    assert "EqualTo(verified,true)" in pushed and "EqualTo(is_passed,true)" in pushed


def test_absent_starter_column_is_filled(spark):
    df = spark.createDataFrame([(1, None)], "a int, question string")
    assert fill_texts(df).first().starter_code == ""


def test_user_content_golden(spark):
    cases = {
        ("q", ""): "q", ("q", " \n　"): "q", ("", "s"): "\n\nStarter code:\n```python\ns\n```",
        ("q", " def g(): pass"): "q\n\nStarter code:\n```python\n def g(): pass\n```",
    }
    df = spark.createDataFrame(list(cases), "q string, s string")
    got = {(r.q, r.s): r.u for r in df.select("q", "s", user_content(F.col("q"), F.col("s")).alias("u")).collect()}
    assert got == cases


def test_code_is_appended_unless_its_head_is_near_the_end(spark):
    """The head may start up to 500 characters before the place where the code would just fit."""
    codes = ["print(1)", "  def f():\n  return 𝒳\n", "".join(f"x{i} = {i}\n" for i in range(40))]
    rows = [(body + code + "." * pad, code, pad) for body in ("", "é" * 17) for code in codes for pad in (0, 400, 500, 501, 502, 503, 700, 2000)]
    rows += [("no code", code, 10_000) for code in codes] + [("text", " \n", 0), ("text", "", 0)]
    df = spark.createDataFrame(rows, "r string, c string, pad int")
    for x in df.select("*", assistant_content(F.col("r"), F.col("c")).alias("a")).collect():
        indent = len(x.c) - len(x.c.lstrip())
        block = f"\n\n```python\n{x.c}\n```" if x.c.strip() and x.pad > 500 + indent else ""
        assert x.a == x.r + block


def test_records(spark):
    rows = [
        (0, "b", True, True, "Q  one", "resp", "code", "start"),
        (1, "a", True, True, "q One", "other", None, None),
        (2, "c", True, True, "  ", "x", None, None),
        (3, "d", True, True, None, "y", None, None),
    ]
    got = curate_reasoning(spark.createDataFrame(rows, REASONING), ["seq"]).orderBy("seq").collect()
    assert [r.id for r in got] == ["b", "c"]
    assert [m.role for m in got[0].conversations] == ["user", "assistant"]
    assert got[0].metadata.asDict() == {
        "question_length": 6, "response_length": 4, "code_length": 4, "cot_tokens": 1,
    }


def test_messages_strip_only_the_prompt(spark):
    df = spark.createDataFrame([(" in ", " out ")], "input string, output string")
    m = to_messages(df, "\n prompt　").first().messages
    assert [(x.role, x.content) for x in m] == [("system", "prompt"), ("user", " in "), ("assistant", " out ")]


def test_profile_takes_the_upper_median(spark):
    for n in [*range(1, 12), 100, 101]:
        values = [(i * 7919) % 97 for i in range(n)]
        df = spark.createDataFrame([(v,) for v in values], "v int")
        row = length_profile(df, {"v": F.col("v")}).first()
        assert (row.min_value, row.p50_value, row.max_value, row.entries) == (
            min(values), sorted(values)[n // 2], max(values), n,
        )


def test_token_totals(spark):
    df = spark.createDataFrame([(3, 4), (5, 6)], "q int, r int")
    assert tuple(token_totals(df, F.col("q"), F.col("r")).first()) == (2, 4, 2)
    assert tuple(token_totals(df.limit(0), F.col("q"), F.col("r")).first()) == (0, 0, None)


def test_file_report(spark):
    df = spark.createDataFrame([("a", True), ("a", False), ("a", False), ("b", True)], "f string, passed boolean")
    got = {r.f: (r.kept, r.total, r.kept_percent) for r in file_report(df, "f").collect()}
    assert got == {"a": (1, 3, 33.3), "b": (1, 1, 100.0)}


def test_judge_pass_combines_both(spark):
    df = spark.createDataFrame([(GOOD, '["pass"]'), (GOOD, '["fail"]'), ("x", "[]")], "j string, t string")
    assert [r[0] for r in df.select(judge_pass(F.col("j"), F.col("t"))).collect()] == [True, False, False]


def test_export_writes_the_same_records_twice(spark):
    rows = [(i, f"id{i % 9}", True, i % 5 > 0, f"question {i % 20} {'w ' * (i % 3)}", "é" * i, "c", None) for i in range(60)]
    out = shared_path(spark, "export")
    records = export_reasoning(spark.createDataFrame(rows, REASONING), ["seq"], out)

    def text(kind):
        return "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{out}/{kind}/part-*")))

    lines = [json.loads(x) for x in text("jsonl").splitlines()]
    assert lines == json.loads(text("json"))
    assert [x["id"] for x in lines] == sorted(x["id"] for x in lines)
    assert len(lines) == records.count() and set(lines[0]) == {"id", "conversations", "metadata"}
    profile, totals = profile_records(records)
    lengths = sorted(x["metadata"]["response_length"] for x in lines)
    got = profile.where("measure = 'response_length'").first()
    assert (got.min_value, got.p50_value, got.max_value) == (lengths[0], lengths[len(lengths) // 2], lengths[-1])
    chars = sum(x["metadata"]["response_length"] + x["metadata"]["question_length"] for x in lines)
    assert tuple(totals.first()) == (len(lines), chars // 4, chars // 4 // len(lines))


def test_messages_follow_the_cleaned_file(spark, tmp_path):
    """Several input files, split unevenly: both exports are in the order of the scan."""
    n = 4000
    rows = [(i, f"question {i}", "x" * (1 + i * 37 % 900), 5) for i in range(n)]
    for part in range(5):
        chunk = instruction_df(spark, [r for r in rows if r[0] * 5 // n == part]).coalesce(1)
        chunk.write.mode("append").parquet(str(tmp_path / "in" / f"train-{part}"))
    df = spark.read.parquet(*[str(tmp_path / "in" / f"train-{p}") for p in range(5)])
    export_instructions(df, ["seq"], str(tmp_path / "out"), "system")

    def lines(name):
        folder = tmp_path / "out" / name
        return [json.loads(x) for f in sorted(folder.glob("part-*")) for x in f.read_text().splitlines() if x]

    asked = [m["messages"][1]["content"] for m in lines("messages")]
    assert asked == [r["input"] for r in lines("cleaned")] == [f"question {i}" for i in range(n)]


def test_text_scores_and_escaped_wrappers_fail(spark):
    good = '{"requirement_conformance": {"score": 5}, "logical_correctness": {"score": 5}, "edge_case_consideration": {"score": %s}}'
    cases = [
        (good % "5", '["pass"]', True), (good % '"Infinity"', '["pass"]', False), (good % '"NaN"', '["pass"]', False),
        (good % "NaN", '["pass"]', True), (good % "5" + '],"x":[0', '["pass"]', False),
        (good % "5", '["pass"]],"x":[["a"', False), (good % "5" + '],"v":[0', '["pass"]', False),
    ]
    df = spark.createDataFrame(cases, "j string, t string, want boolean")
    for r in df.select("*", judge_pass(F.col("j"), F.col("t")).alias("got")).collect():
        assert r.got == r.want, r


def test_counters_are_taken_while_writing(spark, tmp_path):
    """Funnel and file report of several files, one of them without a kept row, in one scan."""
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for f in range(3):
        rows = [(100 * f + i, f"q{i}", None if i % 5 == 0 else f < 2, i % 3 > 0, f"question {i % 4}", "r" * (40 * i), None, None) for i in range(20)]
        spark.createDataFrame(rows, REASONING).coalesce(1).write.parquet(f"{path}/{f}")
        os.rename(next(str(p) for p in (tmp_path / "in" / str(f)).glob("part-*.parquet")), f"{path}/train-{f}.parquet")
    corpus = read_corpus(spark, path, "train-*.parquet")
    got = curate_counted(corpus, SEQ, out, max_tokens=150)
    kept = [[i for i in range(20) if i % 5 and f < 2 and i % 3 and 40 * i // 4 <= 150] for f in range(3)]
    assert {r.file_name: (r.kept, r.total, r.kept_percent) for r in got.files.collect()} == {
        f"train-{f}.parquet": (len(kept[f]), 20, round(len(kept[f]) * 5.0, 1)) for f in range(3)
    }
    assert got.funnel.first() == filter_funnel(corpus, 150).first() and got.funnel.first().passed_filter == sum(map(len, kept))
    assert got.records.count() == curate_reasoning(corpus, SEQ, 150).count() == len({i % 4 for i in kept[0]})
    totals = corpus.groupBy("file_name").count()._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in totals


def test_shards_of_the_corpus_are_written_by_all_tasks(spark, tmp_path, monkeypatch):
    """A shard is several files where the input is: no task holds a whole shard."""
    n = 64
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('text ', id) AS text").repartition(8)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(n).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic").write.parquet(str(tmp_path / "labels.parquet"))
    paths = []
    real = curation.shared_path
    monkeypatch.setattr(curation, "shared_path", lambda *a: paths.append(real(*a)) or paths[-1])
    rows = curation.q_corpus_of_files(spark, str(tmp_path)).collect()
    assert sum(r.kept for r in rows) == sum(r.records for r in rows) == n
    files = spark.read.parquet(paths[0]).select("shard", "_metadata.file_name").distinct().groupBy("shard").count().collect()
    assert len(files) == 4 and all(r["count"] > 1 for r in files)
