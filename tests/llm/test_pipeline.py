"""The stages of the pipeline on odd tables, and sharding over a whole table."""

import collections
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.01"
STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, content string, label int, row string, group string, rank int"

PROSE = " ".join(f"word{i} of the text number{i * 7}" for i in range(60))
OTHER = " ".join(f"quite different{i} things stand{i * 3} here" for i in range(60))


def _row(doc_id, text, lang="en", source="h", content="x"):
    return doc_id, text, lang, source, len(text or ""), content, 1, "r", "g", 3


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        _row(1, PROSE), _row(2, PROSE + " end"), _row(2, PROSE + " end"), _row(3, None), _row(3, None, "de"), _row(4, ""), _row(5, " \n "),
        _row(None, OTHER), _row(None, OTHER, "de"), _row(None, None), _row(6, PROSE, "zz"), _row(1, PROSE, None), _row(1, PROSE + " tail", "aa"),
        _row(7, OTHER + " " + "more and more words " * 3000), _row(8, "card 4111111111111111 of 2023-02-28", None, None),
        _row(9, "one " * 3), _row(9, "a text of its own, with no copy anywhere in the table " * 2),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows_and_empty_tables(spark, odd, name):
    out, empty = STAGES[name](spark, odd, SF), STAGES[name](spark, odd.limit(0), SF)
    assert empty.count() == 0 and empty.columns == out.columns
    if name != "bpe":
        assert out.schema.simpleString() == odd.schema.simpleString()
    kept = out.count()
    assert kept == odd.count() if name in ("pii", "bpe", "toxicity", "decontamination") else kept < odd.count()


def test_ties_among_near_duplicates(spark, odd):
    out = STAGES["near_dedup"](spark, odd, SF).collect()
    got = collections.Counter((r.doc_id, r.text, r.lang) for r in out)
    assert max(got.values()) == 1
    # of the class of PROSE one row: the smallest id, then the smallest text, then the smallest lang
    assert [(r.doc_id, r.text, r.lang) for r in out if (r.text or "").startswith("word0")] == [(1, PROSE, None)]
    # the long text is no near copy of OTHER; without an id one row stays for each text
    assert sorted((r.doc_id or 0, r.lang) for r in out if (r.text or "").startswith("quite")) == [(0, "de"), (7, "en")]
    # null and wordless texts are alone, one of each id
    assert [r.lang for r in out if r.doc_id == 3] == ["de"]
    assert sum(r.doc_id is None and r.text is None for r in out) == 1 and {4, 5, 8} <= {r.doc_id for r in out}
    # one id with two texts that have nothing in common keeps both
    assert sum(r.doc_id == 9 for r in out) == 2


def test_stages_leave_the_session_as_it_was(spark, odd):
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(n, None) for n in names]
    for stage in STAGES.values():
        stage(spark, odd, SF).count()
    assert [spark.conf.get(n, None) for n in names] == before


def test_stages_do_what_their_operators_say(spark):
    """Each stage against the query of its operator, over the whole table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    queries = registry.queries()
    every = ids(docs)
    toxic = ids(queries["op5_subsequence_toxicity"](spark, SF).where("predicted = 1"))
    assert ids(STAGES["toxicity"](spark, docs, SF)) == every - toxic
    hit = ids(queries["op9_benchmark_decontamination"](spark, SF).where("contaminated"))
    assert hit and ids(STAGES["decontamination"](spark, docs, SF)) == every - hit
    copies = ids(queries["op4_dart_minhash"](spark, SF).where("class_id <> doc_id"))
    assert copies and ids(STAGES["near_dedup"](spark, docs, SF)) == every - copies
    codes = {r.doc_id: r.n_tokens for r in queries["op6_streaming_bpe"](spark, SF).collect()}
    assert {r.doc_id: r.n_tokens for r in STAGES["bpe"](spark, docs, SF).select("doc_id", "n_tokens").collect()} == codes


def test_sharding_of_a_whole_table(spark):
    """Every document once with its own size and checksum, counts at most one apart, slots without a gap."""
    table = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")
    want = {r.doc_id: (len(r.text.encode()) + 1, zlib.crc32(r.text.encode())) for r in table.itertuples()}
    out = registry.queries()["op8_hypergeometric_sharding"](spark, SF).toPandas()
    assert len(out) == len(want) and {r.doc_id: (r.size_, r.text_crc32) for r in out.rename(columns={"size": "size_"}).itertuples()} == want
    assert set(out.law) == {"rows"} and out.grown_shard.isna().all()
    counts = out.shard.value_counts()
    assert set(counts.index) == set(range(16)) and counts.max() - counts.min() <= 1
    for _, part in out.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    # uniform: neighbours by id meet in a shard as often as chance has it, and slots know nothing of ids
    by_id = out.sort_values("doc_id")
    same = (by_id.shard.to_numpy()[1:] == by_id.shard.to_numpy()[:-1]).mean()
    assert 0.03 < same < 0.11 and abs(by_id.slot.corr(by_id.doc_id)) < 0.12
