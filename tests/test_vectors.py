import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievecraft.functions.vectors import cosine_distance, l2_normalize, mean_squared_difference, vector_metric
from sievecraft.operators.alignment import metric_loss
from sievecraft.operators.cka import linear_cka
from sievecraft.operators.embed import (
    attach_embeddings,
    budget_batches,
    content_key,
    embed_incremental,
    embed_samples,
    encode_new,
    encode_texts,
    interpolation_pairs,
    mean_over_positions,
    mean_pool,
    read_vectors,
    sample_vector_positions,
    table_encode,
)
from sievecraft.operators.skew import fits_broadcast, hot_keys, join_unique
from sievecraft.session import shared_path
from sievecraft.sources.commits import CommitLog
from workloads.vectors import q_embed_texts


def length_encoder(log=None):
    def make():
        def encode(texts, max_len):
            if log:
                with open(log, "a") as f:
                    f.writelines(t + "\n" for t in texts)
            return [[float(len(t[:max_len])), 1.0] for t in texts]

        return encode

    return make


def unit(*v):
    return [x / math.hypot(*v) for x in v]


def test_encode_honours_the_length_limit_and_blank_text(spark):
    df = spark.createDataFrame([("abcdef",), (" \t",), ("",), ("a",)], "t string")
    for limit, n in ((None, 6.0), (4, 4.0)):
        got = {r.t: r.v for r in df.select("t", encode_texts(F.col("t"), length_encoder(), 2, limit).alias("v")).collect()}
        assert got["abcdef"] == pytest.approx(unit(n, 1.0))
        assert got[" \t"] == got[""] == [0.0, 0.0]


def test_incremental_encodes_each_text_once(spark, tmp_path):
    log, path = str(tmp_path / "log"), shared_path(spark, "cache")
    first = spark.createDataFrame([("aa",), ("bbb",), ("aa",), ("",)], "t string")
    second = spark.createDataFrame([("aa",), ("cccc",)], "t string")
    embed_incremental(first, "t", length_encoder(log), "len", 2, path)
    table = embed_incremental(second, "t", length_encoder(log), "len", 2, path)
    assert sorted(open(log).read().split("\n")) == ["", "aa", "bbb", "cccc"]
    assert table.count() == 4
    other = encode_new(second, "t", length_encoder(), "other", 2, known=table)
    assert other.count() == 2  # another encoder's vectors are not reused
    rows = attach_embeddings(first.withColumn("i", F.monotonically_increasing_id()), table, "t", "len", ["i"]).collect()
    assert len(rows) == 4
    assert all(r.embedding == pytest.approx(unit(len(r.t), 1.0) if r.t else [0.0, 0.0]) for r in rows)


def test_two_jobs_append_to_one_table(spark, tmp_path, monkeypatch):
    """The second job encodes and commits while the first one has read the table and not yet committed."""
    log, path = str(tmp_path / "log"), shared_path(spark, "cache")
    texts = [spark.createDataFrame([(t,) for t in part], "t string") for part in (["a"], ["a", "bb", "ccc"], ["bb", "ccc", "dddd"])]

    def job(k):
        return embed_incremental(texts[k], "t", length_encoder(log), "len", 2, path)

    assert read_vectors(spark, path) is None and job(0).count() == 1
    commit, raced = CommitLog.commit, []

    def slow(self, number, value):
        if not raced:
            raced.append(number)
            assert job(2).count() == 4
        return commit(self, number, value)

    monkeypatch.setattr(CommitLog, "commit", slow)
    both = job(1)
    assert sorted(r.content_key for r in both.collect()) == sorted(r.content_key for r in read_vectors(spark, path).collect())
    assert both.count() == both.select("content_key").distinct().count() == 4
    assert sorted(open(log).read().split()) == ["a", "bb", "bb", "ccc", "ccc", "dddd"]
    assert job(1).count() == job(2).count() == 4 and len(open(log).read().split()) == 6


def test_known_keys_are_found_without_reading_vectors(spark):
    path = shared_path(spark, "cache")
    df = spark.createDataFrame([("a",), ("bb",)], "t string")
    embed_incremental(df, "t", length_encoder(), "len", 2, path)
    plan = encode_new(df, "t", length_encoder(), "len", 2, read_vectors(spark, path))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<content_key:string>" in plan


def test_content_key_depends_on_encoder_and_limit(spark):
    t = F.lit("x")
    r = spark.range(1).select(content_key(t, "a", 1), content_key(t, "b", 1), content_key(t, "a", None)).first()
    assert len(set(r)) == 3


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def test_small_sides_are_broadcast(spark):
    small, big = spark.range(10).select("id", "id"), spark.range(10_000_000)
    assert fits_broadcast(small) and not fits_broadcast(big)


def test_hot_keys_are_bounded_and_join_is_exact(spark, no_broadcast):
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"))
    right = spark.range(3000).select(F.concat(F.lit("k"), F.col("id")).alias("k"), (F.col("id") * 2).alias("v"))
    right = right.union(spark.createDataFrame([("hot", -1)], "k string, v bigint"))
    assert [r.k for r in hot_keys(left, "k", 0.1).collect()] == ["hot"]
    for how in ("left", "inner"):
        salted = join_unique(left, right, "k", ["id"], how, salts=8)
        assert "_salt" in salted._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(repr, salted.collect())) == sorted(map(repr, left.join(right, "k", how).select(*salted.columns).collect()))


def test_distances(spark):
    rows = [([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>")
    got = df.select(
        cosine_distance(F.col("a"), F.col("b")), mean_squared_difference(F.col("a"), F.col("b")), l2_normalize(F.col("a"))
    ).collect()
    assert [r[0] for r in got] == pytest.approx([1.0, 0.0, 1.0])
    assert [r[1] for r in got] == pytest.approx([2.5, 1.0, 1.0])
    assert got[2][2] == [0.0, 0.0] and got[1][2] == pytest.approx([0.5**0.5] * 2)


def test_pooling(spark):
    df = spark.createDataFrame(
        [("a", [1.0, 2.0], 1), ("a", [3.0, 4.0], 1), ("a", [9.0, 9.0], 0), ("b", [5.0, 5.0], 2)],
        "g string, v array<double>, m int",
    )
    got = {r.g: list(r.pooled) for r in mean_pool(df, ["g"], "v", "m").collect()}
    assert got == {"a": [2.0, 3.0], "b": [5.0, 5.0]}


def test_table_encode_and_zero_vectors(spark):
    table = spark.createDataFrame([(0, [3.0, 0.0]), (1, [0.0, 4.0])], "vec_id int, embedding array<float>")
    tokens = spark.createDataFrame([("a", 0), ("a", 0), ("a", 1), ("b", 1)], "s string, vec_id int")
    encoded = table_encode(tokens, table, ["s"], "vec_id")
    full = embed_samples(spark.createDataFrame([("a",), ("b",), ("c",)], "s string"), encoded, ["s"], 2)
    got = {r.s: list(r.embedding) for r in full.collect()}
    assert got["a"] == pytest.approx(unit(2.0, 4 / 3)) and got["b"] == [0.0, 1.0] and got["c"] == [0.0, 0.0]


def test_table_encode_in_blocks_equals_the_join(spark, monkeypatch):
    """Small blocks, repeated and unknown keys, keys the table repeats: no vector is moved for each token."""
    monkeypatch.setattr("sievecraft.operators.embed.BLOCK_TOKENS", 50)
    monkeypatch.setattr("sievecraft.operators.embed.POOL_ROWS", 7)
    rng = random.Random(3)
    table = [(k, [rng.gauss(0, 1) for _ in range(4)]) for k in [*range(40), 3, 3]]
    tokens = [(rng.choice([None, 0, 1]), s, rng.choice([None, *range(45)])) for s in range(60) for _ in range(rng.randint(1, 20))] + [(2, 1, 44)]
    frame = spark.createDataFrame(tokens, "a int, s int, vec_id bigint")
    encoded = table_encode(frame, spark.createDataFrame(table, "vec_id int, embedding array<float>"), ["a", "s"], "vec_id")
    sums = {}
    for a, s, k in tokens:
        for name, v in table:
            if name == k:
                sums.setdefault((a, s), []).append(v)
    expected = {x: unit(*(sum(c) / len(v) for c in zip(*v))) for x, v in sums.items()}
    got = {(r.a, r.s): list(r.embedding) for r in encoded.collect()}
    assert set(got) == set(expected) and (2, 1) not in got
    assert all(got[x] == pytest.approx(expected[x], abs=1e-6) for x in got)
    assert "Summarizer" not in encoded._jdf.queryExecution().executedPlan().toString()


def test_mean_over_positions_divides_by_the_full_length(spark):
    loads = spark.createDataFrame([("a", 1, 2), ("a", 4, 1), ("a", 7, 0)], "s string, src_pos int, n long")
    lengths = spark.createDataFrame([("a", 10), ("b", 3), ("c", 0)], "s string, length int")
    vectors = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("a", 4, [0.0, 5.0])], "s string, pos int, embedding array<double>")
    got = {r.s: list(r.pooled) for r in mean_over_positions(loads, lengths, vectors, ["s"], 2).collect()}
    assert got["a"] == pytest.approx([0.2, 0.5]) and got["b"] == got["c"] == [0.0, 0.0]


def test_sample_vector_positions(spark):
    samples = spark.createDataFrame([("a", "key", [1, 2]), ("b", "other", [])], "s string, content_key string, ps array<int>")
    out = sample_vector_positions(samples, F.col("ps"), ["s"])
    assert {tuple(r) for r in out.collect()} == {("a", "key", 1), ("a", "key", 2)}
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 600), max_size=200), st.integers(1, 40), st.sampled_from([None, 1, 100, 2000]))
def test_batches_keep_to_their_budget(lengths, size, budget):
    batches = list(budget_batches(lengths, size, budget))
    assert sorted(i for b in batches for i in b) == list(range(len(lengths)))
    for b in batches:
        assert len(b) <= size and (budget is None or len(b) == 1 or len(b) * max(lengths[i] for i in b) <= budget)


def test_little_of_a_batch_is_padding(spark, tmp_path):
    """Texts of very different lengths in random order: as they come, most of a batch is padding."""
    rng = random.Random(6)
    texts = [" ".join(["w"] * int(rng.paretovariate(0.8) * 5)) for _ in range(3000)]
    log = str(tmp_path / "batches")

    def make():
        def encode(batch, max_len):
            sizes = [min(max_len, len(t.split())) for t in batch]
            with open(log, "a") as f:
                f.write(f"{sum(sizes)} {max(sizes) * len(sizes)} {len(sizes)}\n")
            return [[float(n), 1.0] for n in sizes]

        return encode

    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    got = df.select("t", encode_texts(F.col("t"), make, 2, 512, 64, 4096).alias("v")).collect()
    assert all(r.v == pytest.approx(unit(float(min(512, len(r.t.split()))), 1.0)) for r in got)
    real, padded, count = (sum(x) for x in zip(*[map(int, line.split()) for line in open(log)]))
    cut = [min(512, len(t.split())) for t in texts]
    naive = sum(max(cut[i : i + 64]) * len(cut[i : i + 64]) for i in range(0, len(cut), 64))
    assert count == 3000 and real == sum(cut) and padded < 1.06 * real < naive / 5
    assert all(int(line.split()[1]) <= 4096 for line in open(log))


def test_metrics_by_name(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "ab"[i % 2] if i < 20 else "c", rng.random(3).tolist(), rng.random(3).tolist(), float(i % 4)) for i in range(22)]
    df = spark.createDataFrame(rows, "id int, g string, x array<double>, y array<double>, w double")
    x, y = F.col("x"), F.col("y")
    for name in ("mse", "flow_matching", "cosine"):
        for weight in (None, F.col("w")):
            got = {r.group: r for r in metric_loss(df, name, x, y, ["id"], F.col("g"), weight).collect()}
            for g in "abc":
                part = [(np.array(r[2]), np.array(r[3]), r[4] if weight is not None else 1.0) for r in rows if r[1] == g]
                each = [1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b) if name == "cosine" else ((a - b) ** 2).mean() for a, b, _ in part]
                total = max(1.0, sum(w for *_, w in part))
                assert got[g].n == len(part) and got[g].loss == pytest.approx(sum(e * w for e, (*_, w) in zip(each, part)) / total)
    cka = {r.group: r.loss for r in metric_loss(df, "cka", x, y, ["id"], F.col("g")).collect()}
    assert cka["c"] is None and cka["a"] == linear_cka(df.where("g = 'a'"), x, y, ["id"]).first().distance
    assert metric_loss(df, "mse", x, y, ["id"]).first().group == "all"
    for bad in ("cka", "euclid"):
        with pytest.raises(ValueError, match=bad):
            vector_metric(bad)
    with pytest.raises(ValueError, match="euclid"):
        metric_loss(df, "euclid", x, y, ["id"])


def test_interpolation_is_replayable_and_consistent(spark):
    df = spark.createDataFrame([(s, p, [float(s + p)] * 4) for s in range(5) for p in range(40)], "s int, p int, z array<double>")
    key = F.concat_ws("/", "s", "p")

    def run(frame):
        rows = interpolation_pairs(frame, "z", F.col("s"), key, 4, seed=1).collect()
        return {(r.s, r.p): (r.t, tuple(r.z_t), tuple(r.v)) for r in rows}

    a, b = run(df), run(df.repartition(5))
    assert a == b
    assert len({t for (s, _), (t, _, _) in a.items()}) == 5
    noise = []
    for (s, p), (t, z_t, v) in a.items():
        z0 = [s + p - x for x in v]
        assert z_t == pytest.approx([t * (s + p) + (1 - t) * x for x in z0])
        noise += z0
    assert abs(np.mean(noise)) < 0.15 and 0.85 < np.std(noise) < 1.15


def unbiased_cka(x, y):
    """Cosine of the unbiased dependence estimates: means over all ordered quadruples of distinct rows."""
    k, l = x @ x.T, y @ y.T
    i, j, q, r = np.array(list(itertools.permutations(range(len(x)), 4))).T

    def dependence(a, b):
        return np.mean(a[i, j] * (b[i, j] + b[q, r] - 2 * b[i, q]))

    return np.clip(dependence(k, l) / np.sqrt(dependence(k, k) * dependence(l, l)), 0, 1)


def test_cka_equals_the_mean_over_quadruples(spark):
    rng = np.random.default_rng(0)
    rows, want = [], {}
    for g, n in (("a", 4), ("b", 9), ("c", 3), ("d", 1), ("hot", 14)):
        x = rng.normal(size=(n, 5)) + 3
        y = x[:, :3] @ rng.normal(size=(3, 7)) + rng.normal(size=(n, 7))
        rows += [(len(rows) + i, g, x[i].tolist(), y[i].tolist()) for i in range(n)]
        want[g] = unbiased_cka(x, y) if n >= 4 else None
    df = spark.createDataFrame(rows, "id int, g string, x array<double>, y array<double>").repartition(6)
    got = {r.group: r for r in linear_cka(df, F.col("x"), F.col("y"), ["id"], F.col("g")).collect()}
    for g, value in want.items():
        assert got[g].n == sum(r[1] == g for r in rows)
        if value is None:
            assert got[g].cka is None and got[g].distance is None
        else:
            assert got[g].cka == pytest.approx(value, abs=1e-6)


def test_cka_of_rotated_vectors_is_one(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 6))
    q, _ = np.linalg.qr(rng.normal(size=(6, 6)))
    rows = [(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, x @ q))]
    df = spark.createDataFrame(rows, "id int, x array<double>, y array<double>")
    assert linear_cka(df, F.col("x"), F.col("y"), ["id"]).first().distance == pytest.approx(0, abs=1e-6)


def test_cka_counts_every_row(spark):
    v = F.array(*[F.rand(i) for i in range(3)])
    df = spark.range(0, 50_000, numPartitions=13).select("id", (F.col("id") % 37).alias("g"), v.alias("x"), v.alias("y"))
    rows = linear_cka(df, F.col("x"), F.col("y"), ["id"], F.col("g")).collect()
    assert {r.group: r.n for r in rows} == {str(g): len(range(g, 50_000, 37)) for g in range(37)}


def test_cka_of_many_groups(spark):
    v = F.array(*[F.rand(i) for i in range(2)])
    df = spark.range(0, 9000, numPartitions=3).select("id", (F.col("id") % 1500).alias("g"), v.alias("x"), v.alias("y"))
    rows = linear_cka(df, F.col("x"), F.col("y"), ["id"], F.col("g")).collect()
    assert len(rows) == 1500 and all(r.n == 6 and r.cka == pytest.approx(1, abs=1e-3) for r in rows if r.cka)


def test_cka_of_unequal_groups(spark):
    """One group of most rows in many pieces, a null one in few, small ones whole: all as the Gram form has it."""
    rng = np.random.default_rng(11)
    sizes = {"big": 700, None: 90, "null": 12, "=": 30, "four": 4, "three": 3}
    rows = [(f"{g}{k}", g, (10 + rng.standard_normal(9)).tolist(), rng.standard_normal(5).tolist()) for g, n in sizes.items() for k in range(n)]
    df = spark.createDataFrame(rows, "id string, g string, x array<double>, y array<double>")
    plans = {}
    for piece_bytes in (1 << 20, 14 * 8 * 40):
        out = linear_cka(df, F.col("x"), F.col("y"), ["id"], F.col("g"), piece_bytes=piece_bytes)
        plans[piece_bytes] = out._jdf.queryExecution().optimizedPlan().toString()
        got = {r.group: r for r in out.collect()}
        assert {g: r.n for g, r in got.items()} == sizes
        for g in sizes:
            part = [(r[2], r[3]) for r in rows if r[1] == g]
            if len(part) >= 4:
                assert got[g].cka == pytest.approx(max(0.0, min(1.0, gram_cka(*map(np.array, zip(*part))))), abs=1e-9)
            else:
                assert got[g].cka is None
    assert "piece" not in plans[1 << 20] and "piece" in plans[14 * 8 * 40]


def test_cka_of_wide_vectors_and_ten_thousand_groups(spark):
    """Matrices of 1024 x 1024 never leave a task for groups that fit."""
    df = spark.range(40000).select(
        "id", (F.col("id") % 10000).alias("g"), *[F.transform(F.sequence(F.lit(1), F.lit(n)), lambda j: F.sin(F.col("id") * j)).alias(c) for c, n in (("x", 24), ("y", 16))]
    )
    out = linear_cka(df, F.col("x"), F.col("y"), ["id"], F.col("g"))
    assert out.where("n = 4 AND cka BETWEEN 0 AND 1").count() == 10000
    wide = spark.range(120).select("id", (F.col("id") % 3).alias("g"), F.transform(F.sequence(F.lit(1), F.lit(1024)), lambda j: F.sin(F.col("id") * j)).alias("x"))
    for piece_bytes in (8 << 20, 2048 * 8 * 16):
        rows = linear_cka(wide, F.col("x"), F.col("x"), ["id"], F.col("g"), piece_bytes=piece_bytes).collect()
        assert len(rows) == 3 and all(r.n == 40 and r.cka == pytest.approx(1, abs=1e-6) for r in rows)


def gram_cka(x, y):
    """From the n x n matrices, by the published unbiased estimator."""
    n = len(x)

    def hsic(k, m):
        k, m = k - np.diag(np.diag(k)), m - np.diag(np.diag(m))
        one = np.ones(n)
        return (np.trace(k @ m) + (one @ k @ one) * (one @ m @ one) / ((n - 1) * (n - 2)) - 2 * (one @ k @ m @ one) / (n - 2)) / (n * (n - 3))

    x, y = x - x.mean(axis=0), y - y.mean(axis=0)
    k, m = x @ x.T, y @ y.T
    return hsic(k, m) / (np.sqrt(max(hsic(k, k) * hsic(m, m), 1e-8)) + 1e-8)


def test_embed_texts_reads_whole_texts(spark, tmp_path):
    """Two texts that differ in their last word only, far behind the first forty."""
    rows = [(0, 0, "user", "a " * 60 + "b"), (0, 1, "user", "a " * 60 + "c")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert len({r.vector for r in q_embed_texts(spark, str(tmp_path)).collect()}) == 2
