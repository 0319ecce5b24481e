import collections
import json
import random

import pytest
from pyspark.sql import functions as F

from sievecraft.functions.dictionary import token_dictionary
from sievecraft.operators.labels import (
    decode_responses,
    distinct_windows,
    joined_pieces,
    keyed_windows,
    response_tokens,
    suffix_loads,
    suffix_sources,
    suffix_windows,
    weigh_positions,
    weighted_mean,
    with_pieces,
)

IGNORE = -100
BLANK = {7, 8}


def sequences(count=60, seed=2):
    rng = random.Random(seed)
    rows = [(0, []), (1, [IGNORE] * 5), (2, [1]), (3, [7, 8] * 30)]
    for i in range(4, count):
        labels = []
        for _ in range(rng.randint(1, 6)):
            labels += [IGNORE] * rng.randint(0, 12)
            labels += [rng.choice([1, 2, 3, 7, 8]) for _ in range(rng.randint(0, 25))]
        rows.append((i, labels))
    return rows


def model_anchors(labels, k, stride, min_len):
    resp = [p for p, x in enumerate(labels) if x != IGNORE]
    out = {}
    for p in resp[::stride]:
        suffix = [x for x in labels[p + 1 : p + 1 + k] if x != IGNORE]
        if len(suffix) >= min_len and any(x not in BLANK for x in suffix):
            out[p] = suffix
    return resp, out


def model_sources(labels, k, stride, min_len):
    resp, anchors = model_anchors(labels, k, stride, min_len)
    out = {}
    for p in resp:
        if p in anchors:
            out[p] = p
        elif stride > 1 and anchors:
            out[p] = min(anchors, key=lambda a: (abs(a - p), a))
        else:
            out[p] = None
    return out


def vocabulary(spark):
    rows = [(1, "one", False), (2, " two", False), (3, "x", False), (7, "<s>", True), (8, " \n", False)]
    return spark.createDataFrame(rows, "token_id int, piece string, is_special boolean")


@pytest.mark.parametrize("k,stride,min_len", [(20, 1, 16), (20, 4, 16), (8, 3, 4), (5, 32, 1), (3, 2, 3)])
def test_windows_and_sources_equal_brute_force(spark, k, stride, min_len):
    rows = sequences()
    df = with_pieces(spark.createDataFrame(rows, "id int, labels array<int>"), vocabulary(spark), ["id"])
    windows = {}
    for r in suffix_windows(df, ["id"], k, stride, min_len).collect():
        windows.setdefault(r.id, {})[r.pos] = list(r.suffix)
    sources = {}
    for r in suffix_sources(df, ["id"], k, stride, min_len).collect():
        sources.setdefault(r.id, {})[r.pos] = r.src_pos
        assert r.has_target == (r.src_pos is not None)
    for i, labels in rows:
        assert windows.get(i, {}) == model_anchors(labels, k, stride, min_len)[1]
        assert sources.get(i, {}) == model_sources(labels, k, stride, min_len)
    served = collections.Counter((i, src) for i, places in sources.items() for src in places.values() if src is not None)
    loads = {(r.id, r.src_pos): r.n for r in suffix_loads(df, ["id"], k, stride, min_len).collect()}
    assert loads == dict(served)


def test_ties_go_to_the_earlier_anchor(spark):
    df = spark.createDataFrame([(0, list(range(1, 9)))], "id int, labels array<int>")
    got = {r.pos: r.src_pos for r in suffix_sources(df, ["id"], 3, 4, 1).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 4, 4: 4, 5: 4, 6: 4, 7: 4}


def test_minimum_suffix_length(spark):
    df = spark.createDataFrame([(15, list(range(1, 17))), (16, list(range(1, 18)))], "id int, labels array<int>")
    got = {(r.id, r.pos) for r in suffix_windows(df, ["id"], 64, 1).collect()}
    assert got == {(16, 0)}


def test_position_weights(spark):
    df = spark.createDataFrame([(0, [IGNORE, 5, IGNORE, 6, 7, 8]), (1, [IGNORE]), (2, [])], "id int, labels array<int>")
    got = [(r.pos, r["rank"], r.weight) for r in weigh_positions(df, ["id"]).orderBy("pos").collect()]
    assert got == [(1, 1, 1.0), (3, 2, 0.75), (4, 3, 0.5), (5, 4, 0.25)]


def test_weighted_mean_floor(spark):
    df = spark.createDataFrame([("a", 2.0, 0.25), ("b", 2.0, 1.0), ("b", 4.0, 3.0)], "g string, l double, w double")
    got = {r.g: r.weighted_loss for r in weighted_mean(df, F.col("l"), F.col("w"), ["g"]).collect()}
    assert got == {"a": 0.5, "b": 3.5}


def test_decode_and_response_tokens(spark):
    rows = sequences()
    df = spark.createDataFrame(rows, "id int, labels array<int>")
    pieces = {1: "one", 2: " two", 3: "x", 8: " \n"}
    got = {r.id: r.text for r in decode_responses(df, vocabulary(spark), ["id"]).collect()}
    assert got == {i: "".join(pieces.get(x, "") for x in labels) for i, labels in rows}
    tokens = {(r.id, r.pos, r.token_id) for r in response_tokens(df, ["id"]).collect()}
    assert tokens == {(i, p, x) for i, labels in rows for p, x in enumerate(labels) if x != IGNORE}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_token_is_shuffled(spark):
    """Windows, sources, loads and texts stay in the row; so does the vocabulary."""
    df = spark.createDataFrame([(0, [1, 2])], "id int, labels array<int>")
    pieced = with_pieces(df, vocabulary(spark), ["id"])
    outs = [weigh_positions(df, ["id"]), decode_responses(df, vocabulary(spark), ["id"])]
    for rows in (df, pieced):
        outs += [f(rows, ["id"], 4, 2) for f in (suffix_windows, suffix_sources, suffix_loads)]
    for out in (*outs, keyed_windows(pieced, ["id"], 4, 2)):
        assert "Exchange" not in plan_of(out) and "Join" not in plan_of(out) and "from_json" not in plan_of(out)


@pytest.mark.parametrize("pieces_of", [with_pieces, joined_pieces])
def test_pieces_and_window_texts(spark, pieces_of):
    rows = sequences()
    pieces = {1: "one", 2: " two", 3: "x", 8: " \n"}
    df = pieces_of(spark.createDataFrame(rows, "id int, labels array<int>"), vocabulary(spark), ["id"])
    got = {r.id: (r.labels, r.pieces) for r in df.collect()}
    assert got == {i: (labels, [pieces.get(x) for x in labels]) for i, labels in rows}
    windows = keyed_windows(df, ["id"], 20, 4, 16)
    texts = distinct_windows(windows, sep="|")
    found = collections.defaultdict(dict)
    for r in windows.join(texts, "window_key").collect():
        found[r.id][r.pos] = r.text
    distinct = set()
    for i, labels in rows:
        anchors = model_anchors(labels, 20, 4, 16)[1]
        distinct |= {tuple(s) for s in anchors.values()}
        assert found.get(i, {}) == {p: "|".join(pieces[x] for x in s if x in pieces) for p, s in anchors.items()}
    assert texts.count() == len(distinct) > 3


def test_texts_are_built_once_for_each_window(spark):
    """Samples that repeat each other give one text a window, built behind the exchange."""
    labels = [1, 2, 3] * 10
    df = spark.createDataFrame([(i, labels) for i in range(50)], "id int, labels array<int>")
    windows = keyed_windows(with_pieces(df, vocabulary(spark), ["id"]), ["id"], 20, 1, 20)
    assert windows.count() == 50 * 10 and distinct_windows(windows).count() == 3
    below = plan_of(distinct_windows(windows, sep="~")).partition("Exchange")[2]
    assert below and ", ~" not in below


def test_vocabularies_of_any_ids_and_text(spark):
    rows = [(-5, 'q"\\', False), (0, "\x00\x1f", False), (1 << 60, "é\U0001f600", False), (7, "", False), (9, None, False), (11, "s", True)]
    vocab = spark.createDataFrame(rows, "token_id bigint, piece string, is_special boolean")
    labels = [-5, 1 << 60, 0, 7, 9, 11, 12345, IGNORE, None]
    df = spark.createDataFrame([(0, labels), (1, []), (2, None)], "id int, labels array<bigint>")
    for limit in (1 << 20, 10):
        got = {r.id: r.pieces for r in with_pieces(df, vocab, ["id"], limit).where("id = 0").collect()}
        assert got == {0: ['q"\\', "é\U0001f600", "\x00\x1f", "", None, None, None, None, None]}
    assert token_dictionary(vocab, 10) is None and token_dictionary(vocab.limit(0)).buckets == 1
    assert with_pieces(df, vocab.limit(0), ["id"]).where("id = 0").first().pieces == [None] * 9


def test_lookups_do_not_slow_down_with_the_vocabulary(spark):
    """Buckets hold few entries however many special or blank tokens there are."""
    vocab = spark.range(50000).select(F.col("id").alias("token_id"), F.lit(" ").alias("piece"), F.lit(False).alias("is_special"))
    slots = json.loads(token_dictionary(vocab).text)
    assert len(slots) == 65536 and max(len(s or []) for s in slots) < 12


def test_joined_pieces_are_exact_with_salted_hot_tokens(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        test_pieces_and_window_texts(spark, joined_pieces)
    finally:
        spark.conf.set(key, before)


def test_a_large_vocabulary_stays_out_of_the_plan(spark):
    """Beyond a size that a plan can carry it is joined, once, and rows that repeat stay as they are."""
    vocab = spark.range(60000).select(F.col("id").alias("token_id"), F.concat(F.lit("w"), "id").alias("piece"), F.lit(False).alias("is_special"))
    rows = [(1, [IGNORE, 5, IGNORE, IGNORE, 7, IGNORE]), (1, [9]), (1, [9]), (None, [3, 70000]), (2, [IGNORE, IGNORE]), (3, []), (4, None), (5, [None, 8])]
    pieced = with_pieces(spark.createDataFrame(rows, "id int, labels array<int>"), vocab, ["id"])
    assert "w59999" not in plan_of(pieced) and "Join" not in plan_of(pieced)
    expected = [(i, x, x and [None if t in (None, IGNORE, 70000) else f"w{t}" for t in x] if x else x) for i, x in rows]
    assert sorted(map(repr, ((r.id, r.labels, r.pieces) for r in pieced.collect()))) == sorted(map(repr, expected))
