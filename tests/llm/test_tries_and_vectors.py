"""Prefix tries, whitening and near-duplicate vectors: edge cases and brute force."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as registry
from sievecraft.llm import embedding_dedup, prefix_trie, whitening

SF = "/root/testdata/sf0.01"
NAN, INF = float("nan"), float("inf")

# ---- prefix trie -------------------------------------------------------------


def _rebuilt(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    turns = {c: [(r, t) for *_, r, _, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = turns.get(c - c % 20, [])[:h] + mine[h:]
    return out


def _trie(convs):
    members = collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = collections.defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    words = lambda t: len([w for w in t.replace("\t", " ").replace("\n", " ").split(" ") if w])

    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[k] for k in below) if below else 1
        saved[node] = sum(saved[k] for k in below) + (len(members[node]) - 1) * (words(node[-1][1]) if node else 0)
    return {
        (
            min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), leaves[n], saved[n],
            hashlib.sha256(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(n)).encode()).hexdigest(),
        )
        for n, m in members.items()
    }


TURNS = "conv_id long, turn long, role string, text string"


def _built(spark, rows, **extra):
    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("x") for c in ("conv", "pos", "key", "depth", "comp", "n_words", *extra)})
    turns = prefix_trie.numbered_turns(df)
    heads = F.crc32(F.col("conv").cast("string").cast("binary")) % 4
    return [tuple(r) for r in prefix_trie.prefix_trie(*prefix_trie.with_shared_heads(turns, F.col("conv") - F.col("conv") % 20, heads)).collect()]


def test_trie_of_odd_conversations(spark):
    long_text = "long " * 30000
    rows = [(1, 0, "u", "a b"), (1, 1, None, None), (1, None, "u", "first"), (2, 0, "u", "a b"), (2, 0, "u", "tie"), (2, 0, "u", "tie"),
            (None, 0, "u", "a b"), (20, 0, "u", "head"), (20, 1, "s", "more \t words\n"), (25, 0, "u", "own"), (25, 3, "u", long_text),
            (39, 0, "u", "gone"), (45, 0, "u", "x"), (-3, 0, "u", "x"), (46, 5, "u", ""), (46, 6, "", "")]
    got = _built(spark, rows)
    assert len(got) == len(set(got)) and set(got) == _trie(_rebuilt(rows))
    assert _built(spark, rows[:0]) == [] and _built(spark, [(None, 1, "u", "x")]) == []


def test_trie_with_long_chains_and_repeats(spark, monkeypatch):
    """Small stretches and salts, so that a conversation spans several and components are dealt to many tasks."""
    monkeypatch.setattr(prefix_trie, "STRETCH", 7)
    monkeypatch.setattr(prefix_trie, "NODES_A_SALT", 9)
    monkeypatch.setattr(prefix_trie, "IDS_A_PIECE", 5)
    monkeypatch.setattr(prefix_trie, "LOCAL_NODES", 12)
    rng = random.Random(4)
    rows = [(400, t, "u", f"w{t % 3} w") for t in range(90)] + [(c, t, "u", f"same {t}") for c in range(500, 540) for t in range(4)]
    rows += [(c, t, rng.choice("us"), rng.choice(["a", "b c", ""])) for c in range(600, 660) for t in range(rng.randrange(1, 9))]
    rows += [(401, t, "u", f"w{t % 3} w") for t in range(60)]
    got = _built(spark, rows)
    assert len(got) == len(set(got)) and set(got) == _trie(_rebuilt(rows))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 120), st.sampled_from([1, 3, 1000]))
def test_splitting_in_memory_sums_subtrees(seed, n, reach):
    """Forests from stars to chains: the parent is one of the last ``reach`` nodes, or none."""
    rng = random.Random(seed)
    parents = [-1 if i == 0 or rng.random() < 0.03 else rng.randrange(max(0, i - reach), i) for i in range(n)]
    values = [[rng.randrange(-5, 100) for _ in range(n)] for _ in range(2)]
    weights = [rng.randrange(1, 9) for _ in range(n)]
    want = [list(v) for v in (weights, *values)]
    for i in range(n - 1, 0, -1):
        for v in want:
            if parents[i] >= 0:
                v[parents[i]] += v[i]
    assert prefix_trie.split_in_memory(parents, list(want[0]), values) == want[1:]


# ---- whitening -----------------------------------------------------------------


def _symmetric(rng, values):
    q, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
    a = (q * np.array(values)) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize(
    "values", [np.geomspace(1, 1e-9, 40), [5, 5, 5, 1] + [1e-3] * 26, [3] * 20, [1] + [0] * 9, [2], np.linspace(1, 1.1, 64), [1, 1 - 1e-10, 0.5, 0.2, 0]]
)
def test_contour_integration_finds_what_inertia_counts(values):
    a = _symmetric(np.random.default_rng(1), values)
    true = np.sort(np.linalg.eigvalsh(a))[::-1]
    for cut in (1.05, 0.7, 1e-4):
        assert whitening.count_below(a, cut) == (true < cut).sum()
    found, axes = [], []
    for low, high, n in whitening.cut_spectrum(a, 16):
        e, x = whitening.feast(a, low, high, n)
        assert len(e) == n and np.abs(a @ x - x * e).max() < 1e-12
        found += list(e)
        axes += list(x.T)
    k = min(16, (true > 1e-14).sum())
    assert len(found) >= k and np.abs(np.sort(found)[::-1][:k] - true[:k]).max() < 1e-13
    assert np.abs(np.array(axes) @ np.array(axes).T - np.eye(len(axes))).max() < 1e-7


def test_a_wrong_count_is_an_error():
    with pytest.raises(ArithmeticError):
        whitening.feast(_symmetric(np.random.default_rng(2), [1, 0.9, 0.5, 0.1]), 0.8, 1.2, 1, rounds=6)


def test_whitening_equals_a_dense_solution(spark):
    out = registry.queries()["op12_feast_whitening"](spark, SF).toPandas().sort_values(["vec_id", "component"])
    table = pd.read_parquet(f"{SF}/embeddings.parquet").sort_values("vec_id")
    x = np.floor(64 * np.stack(table.embedding).astype(float)).astype(np.int64) + 1000000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    y = fit - s / n
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1], v[:, ::-1]
    assert (out.n == n).all() and out.component.tolist() == list(range(1, 17)) * len(table)
    assert (out.deviation.to_numpy()[::16] == ((n * x - s) ** 2).sum(axis=1)).all()
    got, want = out.whitened.to_numpy().reshape(-1, 16), (x - s / n) @ v[:, :16] / np.sqrt(e[:16])
    assert np.abs(got - want * np.sign((got * want).sum(axis=0))).max() < 1e-8
    assert np.abs(out.explained.to_numpy()[:16] / (e[:16] / e.sum()) - 1).max() < 1e-10 and out.identity_error.max() < 1e-10


VECTORS = "vec_id long, embedding array<float>, label int, extra string"


def test_odd_vectors_are_left_out_of_whitening(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [3.0, 2.5]), (None, [0.0, 0.0]), (5, None), (6, [1.0, None]), (7, [NAN, 1.0]), (8, [1.0, INF]),
            (9, []), (10, [1.0]), (3, [3.0, 2.5]), (11, [1e30, 0.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], VECTORS).withColumns({c: F.lit("x") for c in ("n", "component", "x", "vec", "id")})
    out = whitening.whitened_rows(df).collect()
    assert sorted((r.vec_id or 0, r.component) for r in out) == sorted((i or 0, c) for i in (1, 2, 3, None, 3) for c in (1, 2))
    assert {r.n for r in out} == {3} and all(r.identity_error < 1e-9 for r in out)
    one = whitening.whitened_rows(df.where("vec_id IN (1, 2)"))
    assert one.count() == 0 and one.columns == whitening.whitened_rows(df).columns
    assert whitening.whitened_rows(df.limit(0)).count() == 0 and whitening.whitened_rows(df.where("vec_id = 5")).count() == 0
    flat = whitening.whitened_rows(df.where("vec_id IN (1, 3)").withColumn("embedding", F.expr("array(get(embedding, 0), 1f)"))).collect()
    assert {r.component for r in flat} == {1} and all(abs(abs(r.whitened) - 1) < 1e-12 and r.explained == pytest.approx(1) for r in flat)


def test_deviations_are_exact():
    x = np.array([[1 << 44, 0, 7], [0, 1 << 44, -7]])
    n, sums = 1 << 20, [(1 << 62) + 3, -5, 11]
    want = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    assert whitening.deviations(x, n, sums) == [w if w < 1 << 63 else None for w in want]
    near = np.array([[1000001, 1000002], [1000003, 999999]])
    assert whitening.deviations(near, 2, [2000004, 2000001]) == [4 + 9, 4 + 9]


# ---- near-duplicate vectors ------------------------------------------------------


def _linked(rows, similarity=0.93):
    """(links, component) of each row, all rows against all."""
    def usable(label, v):
        return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    ok = [usable(label, v) for _, v, label in rows]
    near = [[j for j in range(len(rows)) if i != j and ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1])
             and np.dot(rows[i][1], rows[j][1]) / np.linalg.norm(rows[i][1]) / np.linalg.norm(rows[j][1]) >= similarity] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            todo += [j for j in near[todo.pop()] if j not in seen and not seen.add(j)]
        out.append((rows[i][0], len(near[i]), min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)))
    return out


def _found(spark, rows, **sizes):
    df = spark.createDataFrame([(i, v, label, "x") for i, v, label in rows], VECTORS).withColumns({c: F.lit("x") for c in ("node", "n", "cell", "grp", "id")})
    return [tuple(r) for r in embedding_dedup.near_duplicate_vectors(df, **sizes).collect()]


def _key(t):
    return tuple((x is not None, x or 0) for x in t)


def test_odd_vectors_have_no_links(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.1], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1), (8, [NAN, 1.0], 1),
            (9, [1.0, None], 1), (10, [INF, 0.0], 1), (None, [1.0, 0.0], 1), (11, [1.0], 1), (1, [1.0, 0.0], 1), (12, [-1.0, 0.0], 1), (None, None, 1),
            (13, [3e38, 3e37], 1), (14, [1e-44, 0.0], 1), (None, [0.0, 1.0], 3), (None, [0.0, 1.0], 3), (15, [0.0, -0.0, 1.0], 1), (16, [-0.0, 0.0, 2.0], 1)]
    want = [(i, n, c, i == c) for i, n, c in _linked(rows)]
    assert sorted(_found(spark, rows), key=_key) == sorted(want, key=_key)
    assert _found(spark, rows[:0]) == []


def test_no_link_is_lost_between_cells(spark):
    """Chains of vectors at the very bound, loose and tight clusters, in cells and blocks of few vectors."""
    rng = np.random.default_rng(7)
    step, d = np.arccos(0.9301), 6
    rows = []
    for label in (1, 2):
        for _ in range(6):
            a, b = np.linalg.qr(rng.standard_normal((d, 2)))[0].T
            rows += [(a * np.cos(k * step) + b * np.sin(k * step), label) for k in range(12)]
        rows += [(rng.standard_normal(d), label) for _ in range(250)]
    centre = rng.standard_normal(d)
    rows += [(centre / np.linalg.norm(centre) + rng.standard_normal(d) * 0.06, 1) for _ in range(300)]
    rows = [(1000 - k, [float(np.float32(x)) for x in v], label) for k, (v, label) in enumerate(rows)]
    want = sorted((i, n, c, i == c) for i, n, c in _linked(rows))
    for sizes in ({"cell_rows": 40, "block_rows": 16}, {"cell_rows": 150, "block_rows": 64, "sample_rows": 8}, {}):
        assert sorted(_found(spark, rows, **sizes)) == want


@settings(max_examples=30, deadline=None)
@given(st.integers(2, 40), st.floats(0.5, 0.99), st.integers(0, 1000))
def test_the_midpoint_of_a_pair_is_in_a_cell_of_both(k, similarity, seed):
    rng = np.random.default_rng(seed)
    units = embedding_dedup.unit_rows(rng.standard_normal((60, 5)))
    turned = units + embedding_dedup.unit_rows(rng.standard_normal((60, 5))) * np.sqrt(2 - 2 * similarity) * rng.random((60, 1))
    centres = embedding_dedup.fit_centres(units, k)
    apart = np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T))
    both = [list(embedding_dedup.cells_of(embedding_dedup.unit_rows(x), centres, apart, np.sqrt(2 - 2 * similarity) / 2)) for x in (units, turned)]
    other = embedding_dedup.unit_rows(turned)
    for i in range(60):
        if units[i] @ other[i] >= similarity:
            assert set(both[0][i][2]) & set(both[1][i][2])
