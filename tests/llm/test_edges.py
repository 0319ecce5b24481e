"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievecraft.llm import (
    bpe, compact_windows, dart_minhash, decontaminate, host_rules, pseudonyms, sharding, token_files, toxicity, warc,
)
from sievecraft.session import shared_path

LONG = " ".join(f"word{i % 977}x{i}" for i in range(20000))
ROWS = [
    (1, None, None, "a"), (2, "", "h", "b"), (3, " \n\t ", "h", None), (4, LONG, "h", "c"), (5, LONG, None, "c"),
    (6, "one two three", "g", "d"), (6, "one two three", "g", "d"), (None, "a row without id " * 20, "g", "e"),
    (None, None, None, None), (7, "card 4111111111111111 on 2023-02-28", "g", "f"), (8, "\x00 odd ퟿ ７ é", "g", "g"),
]
SCHEMA = "doc_id long, text string, source string, kept string"


@pytest.fixture(scope="module")
def docs(spark):
    # columns whose names the operators use as well
    extra = {c: F.lit("x") for c in ("label", "words", "hit", "shard", "n_words", "content", "block", "ids", "copy")}
    return spark.createDataFrame(ROWS, SCHEMA).withColumns(extra)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "two three"), (2, None), (3, "!!!"), (None, "one two")], "item_id long, text string")


def _words(text):
    return (text or "").split()


def test_host_rules(docs):
    out = host_rules.host_verdicts(docs).collect()
    assert len(out) == len(ROWS)
    by = {(r.doc_id, r.word_chars): r for r in out}
    assert by[4, len(LONG.replace(" ", ""))].n_words == 20000
    assert all(r.base_failed and not r.kept for r in out if r.doc_id in (1, 2, 3))
    assert host_rules.host_verdicts(docs.limit(0)).count() == 0


def test_bad_hosts(spark):
    """Failures of 40 hosts of 100 documents, two small bad hosts, a large bad one, and one-document hosts."""
    counts = {f"h{k}": (100, 5 + k % 7) for k in range(40)} | {"large": (400, 380), "small": (6, 6), "lone": (1, 1), "fine": (1, 0)}
    rows = [(host, k < failed) for host, (n, failed) in counts.items() for k in range(n)] + [(None, True)] * 50
    got = {r.host: r for r in host_rules.host_rates(spark.createDataFrame(rows, "host string, f boolean"), "host", "f").collect()}
    rates = np.array([f / n for n, f in counts.values()])
    m = rates.mean()
    v = rates.var() - m * (1 - m) * np.mean([1 / n for n, _ in counts.values()])
    strength, bar = m * (1 - m) / v - 1, m + 2 * v**0.5
    assert set(got) == set(counts) and v > 0
    for host, (n, failed) in counts.items():
        want = (failed + m * strength) / (n + strength)
        assert (got[host].n, got[host].n_failed) == (n, failed) and got[host].rate == pytest.approx(want, abs=1e-12)
        assert got[host].bad == (want > bar)
    assert {h for h, r in got.items() if r.bad} == {"large", "small"}


def test_hosts_that_differ_by_chance_alone_are_not_bad(spark):
    """The hosts' rates vary less than samples of 100 do; two one-document hosts don't make one of them bad."""
    rows = [(f"h{k}", bool(i < 20 + 3 * (k % 2))) for k in range(10) for i in range(100)]
    for more in ([], [("lone", True), ("other", False)]):
        got = host_rules.host_rates(spark.createDataFrame(rows + more, "host string, f boolean"), "host", "f").collect()
        assert len(got) == 10 + len(more) and not any(r.bad for r in got)
        assert more or {r.rate for r in got} == {0.215}


def test_documents_of_bad_hosts_go(spark):
    good, bad = "plain words here " + " ".join(f"w{i}" for i in range(60)), "# $ " * 40
    rows = [(k, good, f"h{k % 12}") for k in range(240)] + [(1000 + k, good if k < 3 else bad, "worst") for k in range(30)] + [(2000, good, None), (2001, bad, None)]
    out = {r.doc_id: r for r in host_rules.host_verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert len(out) == len(rows) and all(out[k].kept and not out[k].host_failed for k in range(240))
    assert all(out[1000 + k].host_failed and not out[1000 + k].kept for k in range(30)) and not out[1001].base_failed
    assert out[1000].host_n == 30 and out[1000].host_rate > 0.5
    assert out[2000].kept and out[2000].host_rate is None and not out[2001].host_failed


def test_pseudonyms(docs):
    out = pseudonyms.pseudonymise(docs, "k").collect()
    assert len(out) == len(ROWS) and out[0].text is None and out[0].n_pseudonyms == 0
    changed = next(r for r in out if r.doc_id == 7)
    assert changed.n_pseudonyms == 2 and "4111111111111111" not in changed.text and len(changed.text) == 35
    assert {r.text for r in out if r.doc_id in (4, 5)} == {LONG}
    assert pseudonyms.pseudonymise(docs.limit(0), "k").count() == 0


def test_sharding(docs):
    keys = ["doc_id", "text"]
    out = sharding.shuffle_to_shards(docs.select("doc_id", "text", "label", "block", "shard"), keys, shards=4).collect()
    assert sorted(str(r.text) for r in out) == sorted(str(r[1]) for r in ROWS)
    sizes = [sum(r.shard == s for r in out) for s in range(4)]
    assert sum(sizes) == len(ROWS) and max(sizes) - min(sizes) <= 1
    for s in range(4):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sizes[s]))
    assert sharding.shuffle_to_shards(docs.limit(0), ["doc_id"]).count() == 0


def test_decontamination(docs, benchmark):
    out = decontaminate.find_contamination(docs, benchmark).collect()
    assert len(out) == len(ROWS)
    three = next(r for r in out if r.doc_id == 6)
    # "one two" is hit by an item without an id
    assert (three.n_words, three.n_hit, three.item_ids, three.contaminated) == (3, 3, ["1"], True)
    assert [tuple(s) for s in three.hit_spans] == [(0, 13)]
    assert not any(r.contaminated for r in out if r.doc_id != 6)
    none = decontaminate.find_contamination(docs, benchmark.limit(0)).where("contaminated OR n_hit > 0")
    assert none.count() == 0 and decontaminate.find_contamination(docs.limit(0), benchmark).count() == 0
    blocks = decontaminate.find_contamination(docs, benchmark, block_bytes=100).where("doc_id = 6").first()
    assert (blocks.n_hit, blocks.item_ids) == (3, ["1"])


def test_warc(spark, docs):
    same = "<p>" + "x" * 200
    pages = [(3, "u", same), (1, None, same), (2, "a\r\nb", same), (4, "u", None), (5, "u", ""), (None, "u", same),
             (6, "u", "short"), (7, "u", "short"), (8, "u", "a\r\n\r\nWARC/1.1\r\n\r\nb é"), (9, "u", "y" * 300), (9, "u", "y" * 300)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("x"))
    path = shared_path(spark, "edge-archives")
    warc.write_archives(table, path)
    records = warc.read_archives(spark, path, with_payload=True)
    assert records.count() == 3 * len(pages)
    out = warc.assemble_captures(records).collect()
    assert len(out) == len(pages) and all(len(r.requests) == len(r.metadata) == 1 for r in out)
    kinds = {r.capture.split(":")[2]: r.response for r in out}
    assert kinds["1"].record_type == "response"
    for k in "23":
        assert kinds[k].record_type == "revisit" and kinds[k].refers_to == kinds["1"].record_id
        assert kinds[k].payload_bytes == len(same) and kinds[k].payload_digest == kinds["1"].payload_digest
    assert kinds["6"].record_type == kinds["7"].record_type == kinds["4"].record_type == "response"
    assert bytes(kinds["8"].payload).decode() == pages[8][2]
    empty = shared_path(spark, "no-archives")
    warc.write_archives(table.limit(0), empty)
    assert warc.assemble_captures(warc.read_archives(spark, empty)).count() == 0


def test_captures_by_any_link(spark):
    """A request may name the response, be named by it, or be named by metadata; others are alone."""
    rows = [("r1", "response", None), ("q1", "request", "r1"), ("m1", "metadata", "q1"), ("r2", "response", "q2"),
            ("q2", "request", None), ("m3", "metadata", "gone"), ("q4", "request", None)]
    nothing = ("refers_to", "target_uri", "date", "payload_digest")
    records = spark.createDataFrame(rows, "record_id string, record_type string, concurrent_to string").withColumns(
        {c: F.lit(None).cast("string") for c in nothing}
        | {"payload_bytes": F.lit(None).cast("long"), "digest_ok": F.lit(True), "payload": F.lit(None).cast("binary"),
           "fields": F.array().cast("array<struct<name:string,value:string>>")}
    )
    got = {r.capture: (r.response is not None, [x.record_id for x in r.requests], [x.record_id for x in r.metadata])
           for r in warc.assemble_captures(records).collect()}
    assert got == {"r1": (True, ["q1"], ["m1"]), "r2": (True, ["q2"], []), "gone": (False, [], ["m3"]), "q4": (False, ["q4"], [])}


def test_bpe(docs):
    path = bpe.tokenizer_path("word_bpe_49k.json")
    out = docs.select("doc_id", "text", bpe.encode("text", path).alias("code"))
    out = out.withColumn("back", bpe.decode("code", path)).collect()
    assert len(out) == len(ROWS)
    assert all(r.code == [] and r.back == "" for r in out if not _words(r.text))
    assert all(len(r.code) >= 20000 for r in out if r.doc_id in (4, 5))


def test_near_duplicates(docs):
    out = dart_minhash.near_duplicates(docs).collect()
    assert len(out) == len(ROWS)
    got = {(r.doc_id, r.class_id) for r in out}
    assert {(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 6), (7, 7), (None, None)} <= got
    assert dart_minhash.near_duplicates(docs.limit(0)).count() == 0


def test_repeated_passages(docs):
    out = compact_windows.repeated_passages(docs).collect()
    assert {(r.doc_id, r.start, r.end, r.other_id) for r in out} == {(4, 0, 20000, 5), (5, 0, 20000, 4)}
    assert compact_windows.repeated_passages(docs.limit(0)).count() == 0


def test_toxicity_without_labels(spark, docs):
    labels = spark.createDataFrame([(1, None), (None, 1), (4, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs.select("doc_id", "text"), labels)
    scores = docs.select(toxicity.toxicity(F.col("text"), model).alias("s")).collect()
    assert len(scores) == len(ROWS) and all(0 <= r.s < 0.3 for r in scores)


def test_token_files(spark, docs):
    path = "file://" + shared_path(spark, "edge-tokids").removeprefix("file:")
    files = token_files.write_token_files(docs, path, bpe.tokenizer_path("byte_bpe_50k.json"), part_bytes=1 << 16)
    out = token_files.read_token_files(files).orderBy("start").collect()
    assert len(out) == len(ROWS) and files.count() > 1
    assert [r.doc_id for r in out] == sorted((r[0] for r in ROWS), key=lambda x: (x is not None, x))
    assert all(b.start == a.start + a.n_tokens for a, b in zip(out, out[1:])) and out[0].start == 0
    assert all(r.n_tokens == 1 for r in out if r.doc_id in (1, 2))
    none = token_files.write_token_files(docs.limit(0), path, bpe.tokenizer_path("byte_bpe_50k.json"))
    assert token_files.read_token_files(none).count() == 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_toxicity_scores_training_texts_once(spark, monkeypatch):
    texts = [(i, f"you are a nasty moron number{i}" if i % 2 else f"what a fine morning number{i}") for i in range(40)]
    docs = spark.createDataFrame([*texts, (40, "..."), (41, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(42)], "doc_id long, toxic int")
    collect, plans, kept = type(docs).collect, [], toxicity.stored
    monkeypatch.setattr(type(docs), "collect", lambda df: (plans.append(_plan(df)), collect(df))[1])
    monkeypatch.setattr(toxicity, "stored", lambda df, name: (plans.append(_plan(df)) if name == "chosen" else None, kept(df, name))[1])
    model = toxicity.train(docs, labels)
    assert [p.count("ArrowEvalPython") for p in plans if "ArrowEvalPython" in p] == [1]
    assert any("TakeOrdered" in p for p in plans)  # the chosen ids stay in Spark
    scored = dict(collect(docs.select("doc_id", toxicity.toxicity(F.col("text"), model))))
    assert all((scored[i] >= toxicity.THRESHOLD) == (i % 2 == 1) for i in range(40)) and scored[40] == scored[41] == 0


def test_windows_of_one_document_are_not_kept(spark, monkeypatch):
    kept, rows = compact_windows.stored, {}

    def counted(df, name):
        out = kept(df, name)
        rows.setdefault(name, out.count())
        return out

    monkeypatch.setattr(compact_windows, "stored", counted)
    own = [" ".join(f"w{i}x{j}" for j in range(200)) for i in range(3)]
    alone = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    assert compact_windows.repeated_passages(alone).count() == 0 and rows["windows"] == 0
    rows.clear()
    shared = " ".join(f"s{j}" for j in range(60))
    both = spark.createDataFrame([(i, f"{t} {shared}" if i < 2 else t) for i, t in enumerate(own)], "doc_id long, text string")
    found = {(r.doc_id, r.start, r.end, r.other_id) for r in compact_windows.repeated_passages(both).collect()}
    assert found == {(0, 200, 260, 1), (1, 200, 260, 0)} and 0 < rows["windows"] < 50
